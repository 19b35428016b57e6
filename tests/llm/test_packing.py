import random
import zlib

import numpy as np
import pytest

from kinelake.llm import packing as P
from kinelake.llm.bpe import vocabulary_path
from kinelake.llm.packing import best_fit, cut_pieces, pack_documents, pack_pieces
from kinelake.tables import written

from .helpers import awkward, docs, prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary_path(None))
    made.no_truncation()
    made.no_padding()
    return made


def sound(rows, capacity):
    """Sequences filled from 0 without a gap, none above the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def plain_bins(lengths, capacity):
    """Best fit, longest first, by looking at every bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((i for i, r in enumerate(rooms) if r >= n), key=lambda i: rooms[i], default=None)
        if fit is None:
            rooms.append(capacity)
            fit = len(rooms) - 1
        rooms[fit] -= n
    return len(rooms)


def test_best_fit_is_the_plain_one():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randrange(1, 51) for _ in range(rng.randrange(0, 80))]
        of, place, room = best_fit(np.array(lengths, np.int64), 50)
        assert len(room) == plain_bins(lengths, 50)
        assert (room >= 0).all() and sum(lengths) == (50 - room).sum() and len({*zip(of.tolist(), place.tolist(), strict=True)}) == len(lengths)


@pytest.mark.parametrize("shape", ["small", "halves", "mixed"])
def test_tree_loses_nothing_and_packs_well(spark, shape):
    rng = random.Random(4)
    pick = {"small": lambda: rng.randrange(1, 30), "halves": lambda: rng.choice([51, 52, 60]), "mixed": lambda: rng.choice([3, 20, 49, 60, 70, 100])}[shape]
    lengths = [pick() for _ in range(3000)]
    pieces = written(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "uid long, length long").repartition(5), "test-pieces")
    rows = pack_pieces(pieces, capacity=100, slack=2, at_once=64, residue=8, fan_in=3).collect()
    assert sorted((r["uid"], r["length"]) for r in rows) == sorted(enumerate(lengths))
    bins = sound(rows, 100)
    best = max(-(-sum(lengths) // 100), plain_bins(lengths, 100))
    assert bins <= best * 1.04 + 1
    assert {(r["uid"], r["sequence_id"], r["offset"]) for r in rows} == {(r["uid"], r["sequence_id"], r["offset"]) for r in pack_pieces(pieces, capacity=100, slack=2, at_once=64, residue=8, fan_in=3).collect()}


def test_broadcast_bound_changes_nothing(spark, monkeypatch):
    pieces = written(spark.range(900).selectExpr("id AS uid", "id % 37 + 1 AS length"), "test-pieces")
    a = {tuple(r) for r in pack_pieces(pieces, capacity=100, at_once=50).collect()}
    monkeypatch.setattr(P, "BROADCAST_BINS", 0)
    assert {tuple(r) for r in pack_pieces(pieces, capacity=100, at_once=50).collect()} == a


def test_pieces_are_the_librarys(spark, library):
    rows = awkward() + [(30 + i, prose(40 + 9 * i, i)) for i in range(40)]
    got = pack_documents(docs(spark, rows), capacity=128).collect()
    sound(got, 128)
    want = []
    for doc, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(doc, i, s, len(ids[s : s + 128]), zlib.crc32(ids[s : s + 128].tobytes())) for i, s in enumerate(range(0, len(ids), 128))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4])
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=key) == sorted(want, key=key)


def test_whole_table_needs_the_least(spark, sf_dir):
    rows = P.query(spark, sf_dir).collect()
    assert sound(rows, 2048) <= -(-sum(r["length"] for r in rows) // 2048) * 1.01 + 1
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_empty_table(spark):
    none = docs(spark, [(1, "x")]).limit(0)
    assert pack_documents(none).collect() == [] and cut_pieces(none).collect() == []
