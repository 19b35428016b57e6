import itertools
import random

import numpy as np
import pytest

from kinelake.llm import quality as Q
from kinelake.llm import toxicity as T
from kinelake.llm.textvec import doc_words

from .helpers import awkward, docs, prose, words


def sample(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_descent_reaches_the_optimum():
    """The dual's conditions hold: no document could lower the loss by moving its multiplier alone."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    values = [np.full(6, 1 / np.sqrt(6)) for _ in rows]
    y = np.where([2 * (r < 12).sum() + rng.integers(0, 3) > 5 for r in rows], 1.0, -1.0)
    cost = np.ones(80)
    w = Q.dual_coordinate_descent(rows, values, y, 30, cost, epochs=3000, tolerance=1e-6)
    dense = np.zeros((80, 31))
    for i, r in enumerate(rows):
        dense[i, r], dense[i, 30] = values[i], 1.0
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (dense @ v)).sum()
    best = loss(w)
    for _ in range(300):
        assert loss(w + rng.normal(0, 0.02, 31)) >= best - 1e-4


def test_ratios_and_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng.randrange(20, 120), i) + (" ### !! buy now" if i % 3 == 0 else " and so on"), int(i % 3 > 0)) for i in range(400)]
    model = Q.QualityModel.fit(sample(spark, rows[:300]))
    scores = {r["doc_id"]: r["score"] for r in model.score(docs(spark, [(i, t) for i, t, _ in rows[300:]])).collect()}
    assert np.mean([(scores[i] >= 0.5) == (y == 1) for i, _, y in rows[300:]]) > 0.97


@pytest.mark.parametrize("rows,expected", [([], 0.0), ([(1, "a b c", 1)], 1.0), ([(1, "a b c", 0), (2, "d", 0)], 0.0)])
def test_without_both_classes(spark, rows, expected):
    got = Q.QualityModel.fit(sample(spark, rows)).score(docs(spark, awkward())).collect()
    assert len(got) == len(awkward()) and all(abs(r["score"] - expected) < 1e-9 for r in got)
    toxic = T.ToxicityModel.fit(docs(spark, awkward()), sample(spark, rows)).score(docs(spark, awkward())).collect()
    assert len(toxic) == len(awkward()) and all(0 <= r["score"] <= 1 for r in toxic)


def test_runs_of_one_word_are_seen():
    assert Q._runs_of_one_word(np.array([1, 2, 2, 2, 3], np.uint64)) == [2, 3]
    assert Q._runs_of_one_word(np.array([1], np.uint64)) == []


def test_quality_query_never_learns_from_held_out_rows(spark, sf_dir):
    from kinelake.llm.shared import table

    full = Q.query(spark, sf_dir).toPandas().sort_values("doc_id")
    labels = table(spark, sf_dir, "labels").toPandas()
    import zlib

    held = full["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert (full["held_out"] == held).all() and full["score"].between(0, 1).all()
    both = full.merge(labels, on="doc_id")
    assert ((both["predicted"] == both["quality"])[both["held_out"]]).mean() > 0.85


def lm(spark, texts):
    return T.language_model(T.count_trigrams(docs(spark, list(enumerate(texts)))))


def test_viterbi_restores_disguised_words(spark):
    model = lm(spark, ["what a stupid idiot you are, pathetic and worthless, the idiot said stupid things to the loser"] * 40 + [prose(50, 1)])
    for token, word in (("1d10t", "idiot"), ("stup1d", "stupid"), ("stuuuupid", "stupid"), ("p@thet1c", "pathetic"), ("w0rthl3ss", "worthless"), ("i.d.i.o.t", "idiot"), ("l0$er", "loser")):
        assert word in T.restored(token, model), token
    assert T.restored("plain", model) == ["plain"] and T.restored("...", model) == []
    assert "idiot" in T.tokens("you i d i o t !") and "idiot" in T.tokens("i-d-i-o-t")


def test_spaced_neighbours_doubled_letters_and_spaced_signs_are_restored(spark):
    model = lm(spark, ["what a stupid idiot you are, pathetic and worthless, the idiot said stupid things to the loser and a man"] * 40 + [prose(50, 1)])
    for text, word in (("he is a s t u p i d man", "stupid"), ("y o u i d i o t", "idiot"), ("iddiot", "idiot"), ("stuupid", "stupid"), ("iidiioott", "idiot"), ("a l o $ e r", "loser"), ("$ t u p ! d", "stupid"), ("l o $ e r", "loser"), ("you i d i o t !", "idiot")):
        assert word in {w for t in T.tokens(text) for w in T.restored(t, model)}, text
    assert "good" in T.restored("good", model) and T.restored("plain", model) == ["plain"]


def test_toxic_documents_go_and_clean_ones_stay(spark):
    rng = random.Random(3)
    bad = ["moronic", "scumbag", "vileness"]
    rows = []
    for i in range(300):
        words = prose(rng.randrange(10, 60), i).split()
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), bad[i // 4 % 3])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    disguised = [(900, prose(20, 5) + " m0ronic " + prose(9, 6)), (901, prose(20, 7) + " s c u m b a g " + prose(9, 8)), (902, prose(30, 9))]
    corpus = docs(spark, [(i, t) for i, t, _ in rows] + disguised)
    model = T.ToxicityModel.fit(corpus, sample(spark, rows[:240]))
    scores = {r["doc_id"]: r["score"] for r in model.score(corpus).collect()}
    assert np.mean([(scores[i] >= 0.5) == bool(y) for i, _, y in rows[240:]]) > 0.95
    assert scores[900] >= 0.5 and scores[901] >= 0.5 and scores[902] < 0.5
    odd = [(r["doc_id"], r["score"]) for r in model.score(docs(spark, awkward())).collect()]
    assert len(odd) == len(awkward()) and all(0 <= s < 0.5 for _, s in odd) and len({s for i, s in odd if i in (1, 2)}) == 1 == len({s for i, s in odd if i == 5})
    df = corpus.withColumnRenamed("lang", "toxic_score")
    scored = model.with_score(df)
    assert scored.columns == [*df.columns, "toxic_score_1"]


def all_readings(token, model, joined):
    """Every path of the lattice with its score, written plainly."""
    for choice in itertools.product(*(T._options(token, i) for i in range(len(token)))):
        free = [i for i, (o, _) in enumerate(choice) if o not in ("", " ")] if joined else []
        for breaks in itertools.product([False, True], repeat=len(free)):
            out, score, allowed = "", 0.0, True
            for i, (option, cost) in enumerate(choice):
                score += cost
                if i in free and breaks[free.index(i)]:
                    if not out or out[-1] == " ":
                        allowed = False
                        break
                    out, score = out + " ", score + T.PARTS
                if option == " " and (not out or out[-1] == " "):
                    continue  # nothing to part
                out += option
            if not allowed:
                continue
            a = b = 0
            for c in out:
                code = 0 if c == " " else T.CODE.get(c, T.OTHER)
                score += float(model[a, b, code])
                a, b = b, code
            yield out, score + (float(model[a, b, 0]) if b else 0.0)


@pytest.mark.parametrize("joined", [False, True])
def test_viterbi_finds_the_best_of_all_paths(joined):
    rng = random.Random(6)
    counts = np.random.default_rng(2).integers(0, 40, T.SIZE**3) * (np.random.default_rng(3).random(T.SIZE**3) < 0.02)
    model = T.language_model(counts)
    for _ in range(60):
        token = "".join(rng.choice("aabbst1$!0. x" if not joined else "aabst1$") for _ in range(rng.randrange(1, 7 if not joined else 6))).strip() or "a"
        readings = list(all_readings(token, model, joined))
        best = max(score for _, score in readings)
        got = T.viterbi(token, model, joined)
        assert max(score for out, score in readings if out.split() == got.split()) == pytest.approx(best, abs=1e-4), token


def test_words_parted_by_a_space_are_joined_where_that_reads_better(spark):
    model = lm(spark, ["what a stupid idiot you are, pathetic and worthless, the idiot said stupid things to the loser and a man"] * 40 + [prose(50, 1)])
    parts = T.split_words(["stupid", "idiot", "aman"])
    assert T.joined_pairs("you st upid idi ot!", parts, model) == {"stupid", "idiot"}
    assert T.joined_pairs("he is a man", parts, model) == set()


def test_held_out_rows_of_the_real_labels(spark, sf_dir):
    from kinelake.llm.shared import table

    labels = table(spark, sf_dir, "labels").toPandas()
    both = T.query(spark, sf_dir).toPandas().merge(labels, on="doc_id")
    held = both[both["held_out"] & both["toxic"].isin([0, 1])]
    assert len(held) and (held["predicted"] == held["toxic"]).mean() > 0.9


def test_a_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    from kinelake.llm import labels as L

    corpus = docs(spark, [(i % 50, "x" * 1000) for i in range(2000)] + [(60, "y" * 40_000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(70)], "doc_id long, toxic int")
    got = L.labelled_sample(corpus, labels, "toxic", 5, lambda r: r >= 0, rows=30).collect()
    assert len(got) == len({r["doc_id"] for r in got}) <= 30 and len(got) > 10
    monkeypatch.setattr(L, "FIT_BYTES", 9_500)
    small = L.labelled_sample(corpus, labels, "toxic", 5, lambda r: r >= 0, rows=30).collect()
    assert 1 <= len(small) <= 9 and {r["doc_id"] for r in small} < {r["doc_id"] for r in got}


def plain_slots(text):
    """Slots of a text's n-grams, one n-gram at a time."""
    raw, out = text.encode(), set()
    for k in (2, 3, 4):
        for i in range(len(raw) - k + 1):
            h = k
            for b in raw[i : i + k]:
                h = (h << 8 | b) & (1 << 64) - 1
            out.add(int(Q._slot(Q.mix(np.array([h], np.uint64)))[0]))
    one = [word_hash(w) for w in words(text)]
    out |= {int(Q._slot(Q.mix(np.array([h], np.uint64) + np.uint64(1)))[0]) for h in one}
    out |= {int(Q._slot(Q.mix(np.array([a], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(b)))[0]) for a, b in zip(one, one[1:], strict=False)}
    longest = max([len(list(g)) for _, g in itertools.groupby(words(text))], default=0)
    return out | {int(Q._slot(Q.mix(np.array([n + 7], np.uint64)))[0]) for n in Q.RUN_LENGTHS if longest >= n}


def word_hash(word):
    return int(doc_words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))[0][0])


def test_ratios_and_scores_are_the_plainly_computed_ones(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng.randrange(5, 25), i, 60) + (" buy buy now" if i % 3 == 0 else " and so on é"), int(i % 3 > 0)) for i in range(60)]
    model = Q.QualityModel.fit(sample(spark, rows))
    having = {}
    for _, text, label in rows:
        for s in plain_slots(text):
            having.setdefault(s, [0, 0])[label] += 1
    n = [sum(y == c for *_, y in rows) for c in (0, 1)]
    ratio = {s: np.float32(np.log(((p + 1) / (n[1] + 2)) / ((q + 1) / (n[0] + 2)))) for s, (q, p) in having.items() if p + q >= Q.LEAST_DOCS}
    assert {s for s in np.flatnonzero(model.ratio).tolist()} == {s for s, r in ratio.items() if r}
    assert all(model.ratio[s] == pytest.approx(r, abs=1e-6) for s, r in ratio.items())
    fresh = [(100 + i, prose(15, 900 + i, 60) + (" buy buy" if i % 2 else "")) for i in range(10)] + [(200, "")]
    odd = [(r["doc_id"], r["score"]) for r in model.score(docs(spark, awkward())).collect()]
    assert len(odd) == len(awkward()) and all(0 <= s <= 1 for _, s in odd) and len({s for i, s in odd if i in (1, 2)}) == 1 == len({s for i, s in odd if i == 5})
    got = {r["doc_id"]: r["score"] for r in model.score(docs(spark, fresh)).collect()}
    for doc, text in fresh:
        own = {s: float(ratio[s]) for s in plain_slots(text) if s in ratio}
        length = np.sqrt(sum(r * r for r in own.values())) or 1.0
        margin = sum(r * float(model.weights[s]) for s, r in own.items()) / length + model.bias
        assert got[doc] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), abs=1e-9)
