"""Best-fit packing of token sequences, hierarchically.

A document is its ids and one end id; only a document longer than a sequence is cut,
into full pieces and a rest. Pieces are dealt to partitions by a hash of their place,
so that every partition holds the same mix of lengths, whatever source or length is
frequent. Each partition packs its pieces by best fit, longest first: a bin with
little room left is a finished sequence, and the others are passed on as items.
Groups of FAN_IN partitions meet at the next node of a tree, where their underfull bins
are packed whole, by best fit again, and so on up to the root, which finishes what is left.

What a node gets is bounded, however many pieces there are: of its underfull bins it
passes on the RESIDUE emptiest, and the others are finished. (After best fit all bins
of a node but one are more than half full, so what is held back could take up next to nothing.)
Placements are rows of a bin and its parent; only the bins that were passed on have
them. No piece, bin or count goes to the driver but the number of pieces.

Defined cases: null text counts as empty and is one end id; a very long text is many
pieces; repeated rows and rows without an identifier are pieces of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, small_batches, table
from .token_shards import encode_batch

END_ID, CAPACITY = 0, 2048
#: Pieces that one task packs, about; bins that a node passes on, at most; nodes that meet at the next.
PIECES_AT_ONCE, RESIDUE, FAN_IN = 16_384, 1024, 16
#: A bin with no more room than this is finished.
SLACK = 8
#: Rows of placements that are broadcast, at most (24 bytes each).
BROADCAST_BINS = 500_000

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: uid (its own), doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession, 500)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def task(batches):
        number = 0
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, part, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encode_batch([t or "" for t in batch.column(1).to_pylist()], vocab), strict=True):
                whole = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(whole), capacity)):
                    own = whole[start : start + capacity]
                    for column, value in zip(out, (part << 40 | number, doc, piece, start, len(own), zlib.crc32(own.tobytes())), strict=True):
                        column.append(value)
                    number += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(task, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, place in it, room of each bin): longest first, each into the bin that it leaves the least room in.

    Bins wait by their room; the bits of one number tell which rooms there are.
    """
    of, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    waiting: dict[int, list[int]] = {}
    there = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = there >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            own = waiting[r].pop()
            if not waiting[r]:
                there ^= 1 << r
        else:
            own, r = len(room), capacity
            room.append(r)
        of[i], place[i] = own, capacity - r
        r -= n
        room[own] = r
        if r:
            waiting.setdefault(r, []).append(own)
            there |= 1 << r
    return of, place, np.array(room, np.int64)


def _passed_on(room: np.ndarray, slack: int, residue: int) -> np.ndarray:
    """Which bins are items of the next node: the emptiest ``residue`` of those with more than ``slack`` room."""
    open_bins = np.flatnonzero(room > slack)
    out = np.zeros(len(room), bool)
    out[open_bins[np.argsort(-room[open_bins], kind="stable")[:residue]]] = True
    return out


def _merger(base: int, capacity: int, slack: int, residue: int):
    """Packs a node's bins as items."""

    def merge(key, bins):
        bins = bins.sort_by([("level", "descending"), ("bin", "ascending")])
        of, place, room = best_fit(bins["level"].to_numpy(), capacity)
        passed = _passed_on(room, slack, residue)
        into = base + (key[0].as_py() << 32) + of
        return pa.table({"bin": bins["bin"], "into": pa.array(into), "at": pa.array(place), "level": pa.array(capacity - room[of]), "open": pa.array(passed[of])})

    return merge


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, at_once: int = PIECES_AT_ONCE, residue: int = RESIDUE, fan_in: int = FAN_IN) -> DataFrame:
    """``pieces`` (a stored table with uid and length) with sequence_id and offset."""
    spark = pieces.sparkSession
    small_batches(spark)
    n = pieces.count()
    nodes = max(1, -(-n // at_once))
    others = [f for f in pieces.schema.fields if f.name not in ("uid", "length")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    columns = ["uid", "length", *[f.name for f in others]]

    def local(key, packed):
        # One node's pieces: a hash deals them out evenly, so there are about ``at_once``.
        packed = packed.sort_by([("length", "descending"), ("uid", "ascending")])
        of, place, room = best_fit(packed["length"].to_numpy(), capacity)
        passed = _passed_on(room, slack, residue)
        ids = (key[0].as_py() << 32) + of
        extra = [pa.array(ids), pa.array(place), pa.array(capacity - room[of]), pa.array(passed[of])]
        return pa.Table.from_arrays([*[packed[c] for c in columns], *extra], [*columns, "bin", "place", "level", "open"])

    dealt = pieces.select(F.pmod(F.xxhash64("uid"), F.lit(nodes)).alias("node"), *columns)
    first = materialise(dealt.groupBy("node").applyInArrow(local, f"uid long, length long, {kinds}{', ' if kinds else ''}bin long, place long, level long, open boolean"), "packed-pieces")

    # The tree: rows are (bin, level, node); what a bin became part of is (bin, into, at).
    items = first.where("open and place = 0").select("bin", "level", F.floor(F.shiftright("bin", 32) / fan_in).alias("node"))
    moves, depth = [], 0
    while nodes > 1:
        depth += 1
        nodes = -(-nodes // fan_in)
        merge = _merger(depth << 58, capacity, slack, residue if nodes > 1 else 0)
        step = materialise(items.groupBy("node").applyInArrow(merge, "bin long, into long, at long, level long, open boolean"), f"packed-bins-{depth}")
        moves.append(step.select("bin", "into", "at"))
        items = step.where("open and at = 0").select(F.col("into").alias("bin"), "level", F.floor(F.shiftright(F.col("into").bitwiseAND((1 << 58) - 1), 32) / fan_in).alias("node"))

    out = first.select("*", F.col("bin").alias("sequence_id"), F.col("place").alias("offset")).drop("bin", "place", "level", "open")
    if moves:
        # From the root down: where each bin of a level ended.
        ended = moves[-1]
        for step in reversed(moves[:-1]):
            up = ended.select(F.col("bin").alias("into"), F.col("into").alias("final"), F.col("at").alias("more"))
            joined = step.join(up, "into", "left").select("bin", F.coalesce("final", "into").alias("into"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at"))
            ended = joined
        ended = materialise(ended, "packed-ends")
        if ended.count() <= BROADCAST_BINS:
            ended = F.broadcast(ended)
        placed = ended.select(F.col("bin").alias("sequence_id"), "into", "at")
        out = out.join(placed, "sequence_id", "left").withColumns({"offset": F.col("offset") + F.coalesce("at", F.lit(0)), "sequence_id": F.coalesce("into", "sequence_id")}).drop("into", "at")
    return out.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = materialise(cut_pieces(docs, id_col, text_col, vocab, end_id, capacity), "pieces")
    return pack_pieces(pieces, capacity).drop("uid")


NAME = "op13_best_fit_packing"
SQL = None  # needs the tokenizers library and an order of placements; tests compare with the library and one plain best fit over all


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
