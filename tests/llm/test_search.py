import math
import re
from collections import Counter

import pytest

from kinelake.llm import search as S
from kinelake.llm.search import search

from .helpers import awkward, docs, lower, prose

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(text))


def plain(rows, items, k=10):
    """Every document's score for every item, straight from the definition."""
    found = [(d, Counter(terms(t))) for d, t, *_ in rows]
    found = [(d, c) for d, c in found if c]
    n_docs, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = set()
    for item, own in asked.items():
        scored = []
        for d, c in found:
            m = 10 + (90 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out |= {(item, r + 1, None if nameless else d, -s) for r, (s, nameless, d) in enumerate(sorted(scored)[:k])}
    return out


def rows_of(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


def test_equals_the_definition_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_DOCS", 7)
    monkeypatch.setattr(S, "FIRST_DEPTH", 1)
    rows = [(i, prose(20 + i % 13, i, 60)) for i in range(200)] + [(1000 + i, prose(30, 5, 60)) for i in range(25)] + [(i, t) for i, t in awkward() if i != 5]
    items = [(i, prose(8, 900 + i, 70)) for i in range(12)] + [(50, ""), (51, None), (52, "nothing like it"), (None, prose(4, 3, 60)), (3, "w1 w2 w1")]
    got = rows_of(search(docs(spark, rows), spark.createDataFrame(items, ITEMS)))
    assert len(got) == len(set(got)) and set(got) == plain(rows, items)


def test_blocks_of_items_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_PAIRS", 10)
    rows = [(i % 30, prose(25, i % 30, 40)) for i in range(60)] + [(None, prose(25, 3, 40))] * 3
    items = [(i, prose(6, 70 + i, 40)) for i in range(9)] + [(99, prose(40, 1, 40))]
    got = rows_of(search(docs(spark, rows), spark.createDataFrame(items, ITEMS), k=4))
    expected = plain(rows, items, 4)
    assert {(i, r, s) for i, r, _, s in got} == {(i, r, s) for i, r, _, s in expected} and set(got) == expected


def test_stops_early_and_never_on_a_tie():
    import numpy as np

    n = 400
    arrays = {"docs": np.arange(n), "lengths": np.full(n, 10), "sizes": np.full(n, 1, np.int32), "codes": np.zeros(n, np.int32), "counts": np.array([50] * 5 + [3] * (n - 5), np.int32), "nameless": np.zeros(n, bool)}
    shard = S.Shard({k: v.tobytes() for k, v in arrays.items()}, np.array([100]), n, 10 * n)
    looked = []
    plain_scores = shard.scores
    shard.scores = lambda d, a: looked.append(len(d)) or plain_scores(d, a)
    found, _ = shard.top(np.array([0]), np.array([True]), 5)
    assert found.tolist() == [0, 1, 2, 3, 4] and sum(looked) < n  # the next impact is below the fifth score
    looked.clear()
    found, _ = shard.top(np.array([0]), np.array([True]), 8)
    assert found.tolist() == list(range(8)) and sum(looked) == n  # all others tie


def test_empty_tables_and_clashing_columns(spark):
    some = docs(spark, [(1, "one two"), (2, "two")]).withColumnRenamed("source", "score").withColumnRenamed("lang", "rank")
    items = spark.createDataFrame([(7, "two")], ITEMS)
    assert {r[2] for r in rows_of(search(some, items))} == {1, 2}
    assert rows_of(search(docs(spark, [(1, "x")]).limit(0), items)) == []
    assert rows_of(search(some, items.limit(0))) == []


@pytest.mark.parametrize("text", ["", "A-b_c9", "ñ É\x00x", "a b 日本"])
def test_terms(text):
    assert [t.decode() for t in S.terms(text.encode())] == terms(text)
