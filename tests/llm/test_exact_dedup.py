from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kinelake.llm import exact_dedup as E
from kinelake.llm.exact_dedup import drop_copies, exact_groups
from kinelake.llm.shared import filter_slots

from .helpers import awkward, docs, lower, prose, sha


def brute(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lower(text)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), sha(text)) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_against_brute_force_even_where_digests_collide(spark, bits):
    rows = awkward() + [(100 + i, f"Text {i % 7}") for i in range(40)] + [(200 + i, prose(20, i)) for i in range(20)]
    got = exact_groups(docs(spark, rows), keep="max", digest_bits=bits).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == brute(rows)
    kept = defaultdict(int)
    for r in got:
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}


def test_smallest_identifier(spark):
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_groups(docs(spark, [(3, "A"), (1, "a"), (2, "b")]), keep="min").collect()}
    assert got == {3: (1, False), 1: (1, True), 2: (2, True)}


def test_one_row_of_each_text_stays_with_all_columns(spark):
    rows = awkward()
    df = docs(spark, rows).withColumnRenamed("lang", "text_digest").withColumnRenamed("source", "gone_id")
    out = drop_copies(df)
    assert out.columns == df.columns
    texts = [lower(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({lower(t) for _, t in rows})
    assert {r["doc_id"] for r in out.collect() if lower(r["text"]) == "same text"} == {5}


def test_empty_table(spark):
    assert exact_groups(docs(spark, [])).count() == 0 and drop_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize("largest", [True, False])
def test_compaction_merges_runs_over_batch_edges(monkeypatch, largest):
    monkeypatch.setattr(E, "RUN_ENTRIES", 7)
    rng = np.random.default_rng(4)
    pool = rng.integers(-(1 << 63), 1 << 63, 60, dtype=np.int64)
    digests = np.sort(np.concatenate([rng.choice(pool, 300), pool[:1].repeat(90), pool[1:2] // 2**53 * 2**53 + np.arange(30)]))
    ids = [None if rng.random() < 0.2 else int(rng.integers(0, 1000)) for _ in digests]
    n = rng.integers(1, 3, len(digests))
    truth = defaultdict(lambda: [[], 0])
    for d, i, k in zip(digests.tolist(), ids, n.tolist(), strict=True):
        truth[d][0].append(i)
        truth[d][1] += k
    cuts = [0, *np.sort(rng.integers(0, len(digests), 25)).tolist(), len(digests)]
    batches = [pa.RecordBatch.from_arrays([pa.array(digests[a:b]), pa.array(ids[a:b], pa.int64()), pa.array(n[a:b])], ["digest", "id", "n"]) for a, b in zip(cuts, cuts[1:], strict=False)]
    got, before = {}, None
    for run in E._compact(largest)(iter(batches)):
        first, hits, d, i, k, bloom = (run.column(j)[0].as_py() for j in range(6))
        d, i, k = (np.frombuffer(x, np.int64) for x in (d, i, k))
        assert len(d) <= 7 and d[0] == first and (before is None or before < first) and (np.diff(d.astype(object)) > 0).all()
        before = int(d[-1])
        assert hits == (k > 1).sum()
        got |= {a: (b, c) for a, b, c in zip(d.tolist(), i.tolist(), k.tolist(), strict=True)}
        for times in (0, 1, 3):
            bits = np.unpackbits(np.frombuffer(E.folded(bloom, times), np.uint8), bitorder="little")
            assert all(bits[s].all() for s in filter_slots(d[k > 1], len(bits)))
    worst = -(1 << 63) if largest else (1 << 63) - 1
    pick = max if largest else min
    assert got == {d: (pick([x for x in i if x is not None], default=worst), k) for d, (i, k) in truth.items()}


def test_many_runs_and_filters_small_enough_to_let_strangers_pass(spark, monkeypatch):
    monkeypatch.setattr(E, "FILTER_BYTES", 64)
    rows = [(i, f"text {i % 900}") for i in range(1200)]
    got = exact_groups(docs(spark, rows), keep="max").collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=repr) == brute(rows)
