"""Shared-folder tables and Arrow helpers for the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..tables import shared_dir, written  # noqa: F401

#: Bytes of an Arrow batch: rows alone don't bound one, since texts may be very long.
BATCH_BYTES = 8 << 20


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: a table in the folder that driver and executors share."""
    return written(df, label)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Ready the session for Python stages: the package on the workers, and Arrow batches
    small enough for long texts (the default is 10,000 rows); a smaller setting stays."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, or the first of name_1, name_2, ... that no column has (Spark compares without case)."""
    have, out, i = {c.lower() for c in taken}, name, 0
    while out.lower() in have:
        i += 1
        out = f"{name}_{i}"
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty. No copy of the text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def binary(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary())


#: Bits of a Bloom filter: eight a key, within these bounds. Beyond the larger one (16 million keys, 16 MB)
#: more strangers pass; what follows a filter is exact, so that costs time and no result.
FILTER_LEAST, FILTER_MOST = 1 << 20, 1 << 27


def filter_bits(keys: float) -> int:
    """Bits (a power of two) for so many keys."""
    return min(FILTER_MOST, max(FILTER_LEAST, 1 << int(8 * keys).bit_length()))


def filter_slots(keys: np.ndarray, bits) -> list[np.ndarray]:
    """Three places of each 64-bit key in a Bloom filter of ``bits`` (powers of two, one or one each)."""
    d, last = keys.view(np.uint64), np.asarray(bits, np.uint64) - np.uint64(1)
    a, b = d * np.uint64(0x9E3779B97F4A7C15), (d ^ d >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return [((a + np.uint64(i) * b) >> np.uint64(20) & last).astype(np.int64) for i in range(3)]


def in_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (int64) the filter may hold."""
    out = np.ones(len(keys), bool)
    for s in filter_slots(keys, len(words) * 64):
        out &= words[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1) == 1
    return out


_PIECE = 1 << 13


def bloom_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter over the first column (long) as 64-bit words; the driver gets it in pieces of 64 KB."""

    def words(batches):
        for batch in batches:
            pos = np.unique(np.concatenate(filter_slots(np.asarray(batch.column(0)), bits)))
            at = np.flatnonzero(np.concatenate([[True], np.diff(pos >> 6) != 0])) if len(pos) else pos
            bit = np.bitwise_or.reduceat(np.uint64(1) << (pos & 63).astype(np.uint64), at) if len(pos) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(pos[at] >> 6), pa.array(bit.view(np.int64))], ["word", "bit"])

    def pieces(batches):
        number, own = -1, np.zeros(_PIECE, np.int64)

        def row():
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["piece", "data"])

        for batch in batches:
            word, bit = (np.asarray(batch.column(i)) for i in range(2))
            for a, b in zip(at := [0, *(np.flatnonzero(np.diff(word // _PIECE)) + 1).tolist(), len(word)], at[1:], strict=False):
                if a == b:
                    continue
                if word[a] // _PIECE != number:
                    if number >= 0:
                        yield row()
                    number, own = int(word[a] // _PIECE), np.zeros(_PIECE, np.int64)
                own[word[a:b] % _PIECE] = bit[a:b]
        if number >= 0:
            yield row()

    packed = keys.mapInArrow(words, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
    packed = packed.repartition(F.floor(F.col("word") / _PIECE)).sortWithinPartitions("word").mapInArrow(pieces, "piece long, data binary")
    out = np.zeros(bits // 64, np.uint64)
    for r in packed.collect():
        piece = np.frombuffer(r["data"], np.uint64)
        out[r["piece"] * _PIECE : (r["piece"] + 1) * _PIECE] = piece[: len(out) - r["piece"] * _PIECE]
    return out
