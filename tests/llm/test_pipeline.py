import hashlib
import math
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402

from kinelake.llm import toxicity as T  # noqa: E402

from .helpers import docs, lower, sha  # noqa: E402
from .test_minhash import brute  # noqa: E402


def plainly_clean(d, labels):
    """Documents under the threshold, scored token by token without memory."""
    model = T.fit_on(d, labels)
    parts = T.split_words([f for f in model.weights if not f.endswith("*")])
    for r in d.select("doc_id", "text").collect():
        found = {f for t in T.tokens(r["text"] or "") for f in T.features(T.restored(t, model.lm))} | {f for w in T.joined_pairs(r["text"] or "", parts, model.lm) for f in T.features([w])}
        if model.bias + math.fsum(model.weights[f] for f in found if f in model.weights) < 0:
            yield r["doc_id"]


def plainly_mixed(rows):
    """Identifiers as often as the inverted Poisson distribution of their source says."""
    n = Counter(s for _, s in rows)
    total = sum(math.sqrt(k) for k in n.values())
    out = []
    for doc, source in rows:
        rate = round(math.sqrt(n[source]) * len(rows) / (total * n[source]), 9)
        u = int(hashlib.md5(f"17|{doc}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        out += [doc] * k
    return sorted(out)


def test_each_stage_does_its_work_on_what_came_before(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels to learn from
    from tokenizers import Tokenizer

    from kinelake.llm.bpe import vocabulary_path
    from kinelake.llm.shared import table

    d = table(spark, sf_dir, "documents")
    names = d.columns
    toxic = P.toxicity(spark, d, sf_dir).cache()
    assert toxic.columns == names and 0 < toxic.count() < d.count()
    assert sorted(r["doc_id"] for r in toxic.collect()) == sorted(plainly_clean(d, table(spark, sf_dir, "labels")))
    exact = P.exact_dedup(spark, toxic, sf_dir).cache()
    before = toxic.collect()
    keep = {}
    for r in before:
        keep[lower(r["text"])] = max(keep.get(lower(r["text"]), -1), r["doc_id"])
    assert exact.columns == names and sorted(r["doc_id"] for r in exact.collect()) == sorted(keep.values())
    near = P.near_dedup(spark, exact, sf_dir).cache()
    rows = [(r["doc_id"], r["text"]) for r in exact.collect()]
    assert near.columns == names and {r["doc_id"] for r in near.collect()} == {x[2] for x in brute(rows)}
    mixed = P.mix(spark, near, sf_dir).cache()
    assert mixed.columns == names and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}
    assert sorted(r["doc_id"] for r in mixed.collect()) == plainly_mixed([(r["doc_id"], r["source"]) for r in near.collect()])
    out = P.bpe(spark, mixed, sf_dir).collect()
    assert len(out) == mixed.count()
    library = Tokenizer.from_file(vocabulary_path(None))
    library.no_truncation()
    text = {r["doc_id"]: r["text"] for r in near.collect()}
    for r in out:
        ids = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_run_is_its_stages(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"] and out.count() > 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "bpe"]


def test_stages_on_an_empty_table(spark, sf_dir):
    empty = docs(spark, [])
    for name, stage in P.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.count() == 0, name
        assert np.array_equal(out.columns, empty.columns) or name == "bpe"
