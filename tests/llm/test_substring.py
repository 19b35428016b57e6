import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from kinelake.llm import substring as S

from .helpers import awkward, docs, edited, prose, words


def exact_truth(rows, k):
    seen = {}
    for i, (_, text) in enumerate(rows):
        w = words(text)
        for j in range(len(w) - k + 1):
            seen.setdefault(tuple(w[j : j + k]), set()).add(i)
    return {i for owners in seen.values() if len(owners) > 1 for i in owners}


def planted(seed):
    rng = random.Random(seed)
    rows = [(i, prose(rng.randrange(5, 400), seed * 100 + i)) for i in range(60)]
    for p in range(6):
        passage = prose(rng.randrange(48, 150), seed * 1000 + p)
        for i in rng.sample(range(60), rng.choice([2, 3, 12])):
            w = rows[i][1].split()
            at = rng.randrange(len(w) + 1)
            rows[i] = (i, " ".join(w[:at] + passage.split() + w[at:]))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_long_exact_passage_is_found(spark, seed):
    rows = planted(seed)
    got = S.repeated_passages(docs(spark, rows)).collect()
    truth = exact_truth(rows, 28)
    assert truth <= {r["doc_id"] for r in got}
    text = {i: words(t) for i, t in rows}
    for r in got:  # whatever is reported lies in other documents, and a passage of it in the one named
        own = text[r["doc_id"]][r["start_word"] : r["end_word"]]
        other = text[r["other_doc_id"]]
        assert r["n_words"] == len(own) >= S.MIN_WORDS and r["identity"] >= S.IDENTITY
        assert sum(w in set(other) for w in own) >= S.IDENTITY * S.MIN_WORDS
        elsewhere = set().union(*(t for i, t in text.items() if i != r["doc_id"]))
        assert sum(w in elsewhere for w in own) >= 0.75 * len(own)
    assert {r["doc_id"] for r in got} <= exact_truth(rows, 6)


def test_fuzzy_passages_with_changed_lost_and_added_words(spark):
    passage = prose(120, 4).split()
    changed = edited(" ".join(passage), 0.06, 1).split()
    lost = [w for i, w in enumerate(passage) if i % 25 != 24]
    added = [x for i, w in enumerate(passage) for x in ((w, f"new{i}") if i % 30 == 29 else (w,))]
    rows = [(i, " ".join(prose(80, 50 + i).split() + p + prose(80, 90 + i).split())) for i, p in enumerate((passage, changed, lost, added))]
    got = S.repeated_passages(docs(spark, rows + [(9, prose(300, 7))])).collect()
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3}
    assert all(abs(r["start_word"] - 80) <= 8 and r["n_words"] >= 90 for r in got)


def test_copies_one_word_runs_and_awkward_rows(spark):
    copy = prose(60, 3)
    rows = awkward() + [(20, copy), (21, copy), (22, copy), (30, "the " * 90), (31, "the " * 100 + prose(30, 1))]
    got = {}
    for r in S.repeated_passages(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {8, 9, 20, 21, 22, 30, 31} == set(got)
    assert [r["repeat"] for r in got[20]] == [False] and [r["other_doc_id"] for r in got[22]] == [20]
    assert S.repeated_passages(docs(spark, [])).count() == 0


def test_cutting_leaves_the_hub_and_other_columns(spark):
    passage = prose(70, 1)
    rows = [(i, f"{prose(20, 10 + i)}\n{passage}\n{prose(20, 30 + i)}") for i in range(4)] + [(9, None)]
    df = docs(spark, rows).withColumnRenamed("lang", "spans").withColumnRenamed("source", "spans_of")
    out = S.cut_repeats(df)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert sum(passage in (t or "") for t in texts.values()) == 1 and texts[9] is None
    assert all(prose(20, 10 + i) in texts[i] for i in range(4))


def test_the_whole_of_long_periodic_passages_is_reported(spark):
    for k, (period, times) in enumerate(((1, 700), (10, 100), (19, 40), (30, 40))):
        run = (prose(period, 60 + k) + " ") * times
        rows = [(i, f"{prose(40, 70 + i)} {run} {prose(40, 80 + i)}") for i in range(3)]
        covered = {i: set() for i in range(3)}
        for r in S.repeated_passages(docs(spark, rows)).collect():
            covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        for i in covered:
            assert set(range(40, 40 + period * times)) <= covered[i], (period, i)


def test_every_28_words_hold_a_long_key_of_the_text():
    rng = np.random.default_rng(8)
    for period in (1, 3, 10, 19, 40):
        run = np.tile(rng.integers(1, 2**60, period), 300 // period + 1)
        own = np.concatenate([rng.integers(1, 2**60, 30), run, rng.integers(1, 2**60, 60), run, run[:5]]).astype(np.uint64)
        _, (places, keys) = S.keyed_places(own)
        every = S.mix(S.runs(own, S.LONG) + np.uint64(S.LONG))
        assert (every[places] == keys).all()
        for at in range(len(own) - 27):
            assert np.isin(every[at : at + 7], keys).any()


def test_chains_are_the_best_collinear_ones():
    rng = np.random.default_rng(3)
    for _ in range(60):
        parts = sorted({(int(a), int(a + n), int(b), 1, False) for a, b, n in zip(rng.integers(0, 60, 9), rng.integers(0, 60, 9), rng.integers(6, 12, 9), strict=True)})
        best = S.chains(parts)[0]

        def value(chain, parts=parts):
            total = 0.0
            for i, j in zip([None, *chain], chain, strict=False):
                a = parts[j]
                if i is None:
                    total = a[1] - a[0]
                    continue
                b = parts[i]
                end = b[2] + b[1] - b[0]
                if b[1] > a[0] or end > a[2]:
                    return float("-inf")
                total = a[1] - a[0] + max(0.0, total - S.GAP_COST * (a[0] - b[1] + a[2] - end))
            return total

        def all_chains(i, parts=parts):
            yield [i]
            for j in range(len(parts)):
                if j != i and parts[i][1] <= parts[j][0] and parts[i][2] + parts[i][1] - parts[i][0] <= parts[j][2]:
                    for rest in all_chains(j):
                        yield [i, *rest]

        assert value(best) == pytest.approx(max(value(c) for i in range(len(parts)) for c in all_chains(i)))


def test_common_words_is_the_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 4, rng.integers(0, 30)), rng.integers(0, 4, rng.integers(0, 30))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert S.common_words(a, b) == best[-1, -1]


def pairs_of_edited_passages(length, share, seed, n=80):
    """Documents 2p and 2p + 1 hold a passage and its edited form; ids of those whose forms are alike by the operator's own measure."""
    rng = random.Random(seed)
    rows, due = [], set()
    for p in range(n):
        own = prose(length, seed * 10_000 + p).split()
        other = [f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in own]
        for k, q in enumerate((own, other)):
            rows.append((2 * p + k, " ".join(prose(60, seed * 777 + 4 * p + k).split() + q + prose(60, seed * 999 + 4 * p + k + 2).split())))
        same = sum(b.size for b in SequenceMatcher(None, own, other, False).get_matching_blocks())
        if same >= S.IDENTITY * length:
            due |= {2 * p, 2 * p + 1}
    return rows, due


@pytest.mark.parametrize(("length", "share", "least"), [(28, 0.0, 1.0), (34, 0.0, 1.0), (100, 0.08, 0.95), (100, 0.1, 0.9), (100, 0.15, 0.9)])
def test_recall_of_exact_and_edited_passages(spark, length, share, least):
    rows, due = pairs_of_edited_passages(length, share, 5)
    # Unrelated texts that share phrases with the passages must not take their place.
    phrases = [(1000 + i, " ".join(x for j in range(8) for x in (*rows[(i * 8 + j) % len(rows)][1].split()[62:70], *prose(9, 40_000 + 10 * i + j).split()))) for i in range(60)]
    got = {r["doc_id"] for r in S.repeated_passages(docs(spark, rows + phrases)).collect()}
    assert len(got & due) >= least * len(due), len(got & due) / len(due)
    assert not {d for d in got if d >= 1000}


def with_stock_phrase(length, stock, seed, n=100):
    """Documents 2p and 2p + 1 share ``length`` words, of which ``stock`` in a row are said by all documents."""
    rng = random.Random(seed)
    phrase, rows = prose(stock, seed).split(), []
    for p in range(n):
        left = rng.randrange(length - stock + 1)
        own = prose(length - stock, seed * 10_000 + p).split()
        passage = own[:left] + phrase + own[left:]
        rows += [(2 * p + k, " ".join(prose(60, seed * 777 + 4 * p + k).split() + passage + prose(60, seed * 999 + 4 * p + k + 2).split())) for k in (0, 1)]
    return rows


@pytest.mark.parametrize(("length", "stock", "least"), [(28, 0, 1.0), (28, 20, 1.0), (30, 20, 1.0), (30, 21, 1.0), (30, 26, 0.5), (34, 26, 0.9), (60, 26, 1.0)])
def test_recall_of_exact_passages_around_a_phrase_that_all_say(spark, length, stock, least):
    rows = with_stock_phrase(length, stock, 6)
    got = {r["doc_id"] for r in S.repeated_passages(docs(spark, rows)).collect()}
    assert len(got) >= least * len(rows), len(got) / len(rows)


def test_rows_that_share_an_identifier_or_have_none(spark):
    copy, passage = prose(60, 3), prose(70, 21)
    rows = [(1, copy), (1, copy), (None, copy), (2, f"{prose(30, 5)} {passage}"), (2, f"{passage} {prose(40, 6)}"), (None, prose(50, 8)), (None, prose(50, 8)), (3, "short")]
    got = S.repeated_passages(docs(spark, rows)).collect()
    whole = [r for r in got if r["n_words"] == 60]
    assert sorted((r["doc_id"] is None, r["repeat"]) for r in whole) in ([(False, False), (False, True), (True, True)],)
    assert sorted(r["repeat"] for r in got if r["n_words"] == 50) == [False, True]
    texts = sorted(r["text"] for r in S.cut_repeats(docs(spark, rows)).collect())
    assert texts.count(copy) == 1 and texts.count(prose(50, 8)) == 1 and sum(passage in t for t in texts) == 1 and "short" in texts
    assert len(texts) == len(rows)


def test_passages_said_again_within_a_text(spark):
    passage = prose(60, 31)
    rows = [(1, f"{prose(30, 1)} {passage} {prose(30, 2)} {passage} {prose(30, 3)}"), (2, prose(200, 4))]
    assert S.repeated_passages(docs(spark, rows)).count() == 0
    got = S.repeated_passages(docs(spark, rows), within=True).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["repeat"]) for r in got) == [(1, 30, 90, False), (1, 120, 180, True)]
    assert [r["text"].count(passage) for r in S.cut_repeats(docs(spark, rows), within=True).orderBy("doc_id").collect()] == [1, 0]


def test_unequal_texts_with_one_number(monkeypatch):
    a, b = prose(80, 41), prose(80, 42)
    monkeypatch.setattr(S, "text_ids", lambda words, first: np.full(len(first) - 1, 7))
    batch = pa.RecordBatch.from_pydict({"uid": [0, 1, 2], "doc_id": [1, 2, 3], "text": [a, a, b]})
    out = next(S._members(iter([batch]))).to_pydict()
    assert out["sid"] == [7, 7, 7] and out["digest"][0] == out["digest"][1] != out["digest"][2]
    sids = S._texts(batch, 2, frozenset([7]))[0].tolist()
    assert sids == out["digest2"] and sids[0] == sids[1] != sids[2]
