"""Exact dedup by a log-structured merge index.

Write path: every task keeps a memtable of the texts it has met, bounded in
bytes; equal texts meet there and are compared byte by byte. A flush leaves a
*run*: entries (digest, identifier to keep, rows) in the order of a 64-bit
digest. Compaction merges the runs of all tasks: they are dealt by the digest's
first bits, Spark's external sort merges what comes together, and one pass over
the merged order adds up equal digests, keeps the smallest (or largest)
identifier, and writes sorted compacted runs, each with a Bloom filter of its
digests that stand for more than one row.

Lookup: a second pass over the texts asks the filter of the run that its digest
falls in; texts it doesn't hold are alone and never leave their task. The others
are hits: one text a memtable is moved and all are grouped by digest and *bytes*.
Where one text stands behind a digest, the index's entry is the answer; where
several do, each group of equal bytes is answered by itself.

A group of copies of any size is reduced to one entry and one text a memtable
before it is shuffled. Filters have eight bits a hit and are folded in half until
all fit FILTER_BYTES; a folded filter lets more strangers pass, which costs time
and no result.

Defined cases: null text counts as empty, and empty texts equal each other; a very
long text fills a memtable by itself; a row without doc_id stays only if no row of
its group has one; of repeated rows (same doc_id, same text) exactly one stays; an
empty table gives an empty result; other columns, whatever their names, are left
alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filter_slots, free_name, materialise, small_batches, table

MEMTABLE_BYTES = 16 << 20
#: Compaction is dealt by so many first bits of a digest; a compacted run has so many entries at most.
SHARD_BITS = 12
RUN_ENTRIES = 1 << 20
#: All filters together, at most.
FILTER_BYTES = 16 << 20


def _bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text with A-Z lower-cased and nothing else changed."""
    return [(x or b"").lower() for x in column.cast(pa.binary()).to_pylist()]  # bytes.lower() is ASCII only


def _digest(data: bytes, bits: int) -> int:
    whole = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
    return whole if bits >= 64 else whole & ((1 << bits) - 1)


def _write_runs(digest_bits: int, largest: bool):
    """Runs of entries (digest, id, n), ascending within a flush; ``id`` is null where no row has one."""
    pick = max if largest else min

    def flush(memtable: dict[bytes, list]) -> pa.RecordBatch:
        run = sorted(((_digest(data, digest_bits), n, best) for data, (n, best) in memtable.items()), key=lambda entry: entry[0])
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in run], pa.int64()) for i in (0, 2, 1)], ["digest", "id", "n"])

    def task(batches):
        memtable: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1)), strict=True):
                entry = memtable.get(data)
                if entry is not None:
                    entry[0] += 1
                    if doc is not None:
                        entry[1] = doc if entry[1] is None else pick(entry[1], doc)
                    continue
                memtable[data] = [1, doc]
                held += len(data) + 200
                if held > MEMTABLE_BYTES:
                    yield flush(memtable)
                    memtable, held = {}, 0
        if memtable:
            yield flush(memtable)

    return task


def _run_filter(digests: np.ndarray) -> np.ndarray:
    bits = 1 << max(6, (8 * len(digests) - 1).bit_length())
    held = np.zeros(bits, bool)
    for s in filter_slots(digests, bits):
        held[s] = True
    return np.packbits(held, bitorder="little")


def _compact(largest: bool):
    """Merged entries in, compacted runs out; equal digests stand together, over batch edges too."""
    take = np.maximum if largest else np.minimum
    worst = np.int64(-(1 << 63)) if largest else np.int64((1 << 63) - 1)
    names = ["first", "n_hits", "digests", "ids", "counts", "filter"]

    def run(digests: np.ndarray, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        hits = n > 1
        row = (int(digests[0]), int(hits.sum()), digests.tobytes(), ids.tobytes(), n.tobytes(), _run_filter(digests[hits]).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(row)], names)

    def task(batches):
        kept = [np.zeros(0, np.int64)] * 3

        def cut(parts, last: bool):
            """Runs of whole shards; what may go on stays."""
            digests, ids, n = parts
            shard = digests >> np.int64(64 - SHARD_BITS)
            edges = np.flatnonzero(np.diff(shard)) + 1
            starts = [0, *edges.tolist(), len(digests)]
            for a, b in zip(starts, starts[1:], strict=False):
                more = a
                while b - more > RUN_ENTRIES:
                    yield run(*(x[more : more + RUN_ENTRIES] for x in parts)), None
                    more += RUN_ENTRIES
                if b < len(digests) or last:
                    if b > more:
                        yield run(*(x[more:b] for x in parts)), None
                else:
                    yield None, [x[more:b] for x in parts]

        for batch in batches:
            digests, n = (np.asarray(batch.column(i)) for i in (0, 2))
            ids = np.asarray(batch.column(1).fill_null(int(worst)))
            digests, ids, n = (np.concatenate([k, x]) for k, x in zip(kept, (digests, ids, n), strict=True))
            if not len(digests):
                continue
            start = np.flatnonzero(np.concatenate([[True], np.diff(digests) != 0]))
            parts = digests[start], take.reduceat(ids, start), np.add.reduceat(n, start)
            # The last entry may have equals in the next batch.
            for made, rest in cut([p[:-1] for p in parts], False) if len(start) > 1 else [(None, [p[:0] for p in parts])]:
                if made is not None:
                    yield made
                else:
                    kept = [np.concatenate([r, p[-1:]]) for r, p in zip(rest, parts, strict=True)]
        if len(kept[0]):
            for made, _ in cut(kept, True):
                yield made

    return task


_RUN = "first long, n_hits long, digests binary, ids binary, counts binary, filter binary"


def build_index(docs: DataFrame, digest_bits: int, largest: bool) -> DataFrame:
    """The compacted runs over ``docs`` (doc_id, text)."""
    runs = docs.mapInArrow(_write_runs(digest_bits, largest), "digest long, id long, n long")
    merged = runs.repartition(F.shiftright("digest", 64 - SHARD_BITS)).sortWithinPartitions("digest")
    return materialise(merged.mapInArrow(_compact(largest), _RUN), "exact-index")


def _hits(worst: int):
    """(digest, id, n) of the entries of compacted runs that stand for several rows."""

    def task(batches):
        for batch in batches:
            for digests, ids, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                digests, ids, n = (np.frombuffer(x, np.int64) for x in (digests, ids, n))
                hits = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(digests[hits]), pa.array(ids[hits], mask=ids[hits] == worst), pa.array(n[hits])], ["digest", "id", "n"])

    return task


def folded(data: bytes, times: int) -> bytes:
    """A filter of half the bits, so many times, as long as 64 stay: a key's place in it is its old place modulo the new size."""
    raw = np.frombuffer(data, np.uint8)
    for _ in range(times):
        if len(raw) <= 8:
            break
        raw = raw[: len(raw) // 2] | raw[len(raw) // 2 :]
    return raw.tobytes()


class Filters:
    """The filters of all compacted runs: which digests may be hits."""

    def __init__(self, index: DataFrame):
        some = index.where("n_hits > 0")
        # A filter has fewer than 16 bits a hit, and 8 bytes at least.
        most = some.agg(F.sum(2 * F.col("n_hits") + 8)).first()[0] or 0
        times = 0
        while most >> times > FILTER_BYTES:
            times += 1

        def small(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([folded(x, times) for x in batch.column(1).to_pylist()], pa.binary())], ["first", "filter"])

        found = some.select("first", "filter").mapInArrow(small, "first long, filter binary").orderBy("first").toPandas()
        self.first = found["first"].to_numpy(np.int64)
        size = np.array([len(x) for x in found["filter"]], np.int64)
        self.bits, self.base = (size * 8).astype(np.uint64), np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(found["filter"]), np.uint8)

    def hold(self, digests: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.first, digests, "right") - 1
        out = run >= 0
        if out.any():
            at = np.maximum(run, 0)
            for s in filter_slots(digests, self.bits[at]):
                out &= self.data[self.base[at] + (s >> 3)] >> (s & 7).astype(np.uint8) & 1 == 1
        return out


_MEMBER_COLUMNS = "doc_id long, uid long, head_uid long, digest long, text_sha256 string, n_here long, bytes binary"
_MEMBER_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())


def _read_members(shared, digest_bits: int, largest: bool):
    """Singles pass through; texts that a filter holds are gathered in a memtable.

    The best row of a text in a memtable is its head: it alone carries the bytes.
    """
    pick = max if largest else min
    worst = -(1 << 63) if largest else (1 << 63) - 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in _MEMBER_COLUMNS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_MEMBER_TYPES)], names)

    def flush(memtable: dict[bytes, list]) -> pa.RecordBatch:
        out = []
        for data, rows in memtable.items():
            head = pick(rows)[1]
            sha, digest = hashlib.sha256(data).hexdigest(), _digest(data, digest_bits)
            out += [(doc, uid, head, digest, sha, len(rows) if uid == head else None, data if uid == head else None) for _, uid, doc in rows]
        return batch_of(out)

    def task(batches):
        filters = shared.value
        memtable: dict[bytes, list] = {}
        held = 0
        for batch in batches:
            singles = []
            texts = _bytes_of(batch.column(2))
            hits = filters.hold(np.array([_digest(x, digest_bits) for x in texts], np.int64)).tolist()
            for doc, uid, data, hit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, hits, strict=True):
                if not hit:
                    singles.append((doc, uid, uid, None, hashlib.sha256(data).hexdigest(), 1, None))
                    continue
                if data not in memtable:
                    memtable[data] = []
                    held += len(data)
                memtable[data].append((worst if doc is None else doc, uid, doc))
                held += 120
                if held > MEMTABLE_BYTES:
                    yield flush(memtable)
                    memtable, held = {}, 0
            if singles:
                yield batch_of(singles)
        if memtable:
            yield flush(memtable)

    return task


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest_bits: int = 64, uid_col: str | None = None) -> DataFrame:
    """One row a document: doc_id, uid, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``min`` or ``max``. ``digest_bits`` below 64 makes the index
    collide on purpose; results do not change, since hits are verified by their
    bytes. ``uid`` tells repeated rows apart: ``uid_col`` or a number of this run.
    """
    spark = docs.sparkSession
    small_batches(spark)
    largest = keep == "max"
    text = F.col(text_col).cast("string").alias("text")
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    uid = F.col(uid_col) if uid_col else F.monotonically_increasing_id()
    index = build_index(docs.select(doc_id, text), digest_bits, largest)
    shared = spark.sparkContext.broadcast(Filters(index))
    rows = docs.select(doc_id, uid.alias("uid"), text)
    members = materialise(rows.mapInArrow(_read_members(shared, digest_bits, largest), _MEMBER_COLUMNS), "exact-members")
    heads = members.where("bytes is not null")
    worst = F.lit(-(1 << 63) if largest else (1 << 63) - 1)
    best = (F.max if largest else F.min)(F.struct(F.coalesce("doc_id", worst).alias("rank"), "uid", "doc_id"))
    # Grouped by the bytes themselves: this is the verification of a hit.
    classes = heads.groupBy("digest", "text_sha256", "bytes").agg(best.alias("best"), F.sum("n_here").alias("n_class")).drop("bytes")
    texts = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    entries = index.where("n_hits > 0").select("digests", "ids", "counts").mapInArrow(_hits(-(1 << 63) if largest else (1 << 63) - 1), "digest long, id long, n long")
    known = classes.join(texts, "digest").join(entries, "digest", "left")
    # The index's entry answers for a digest of one text; otherwise each text's own rows do.
    alone = (F.col("texts") == 1) & F.col("n").isNotNull()
    known = known.select("digest", "text_sha256", F.when(alone, F.col("id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.when(alone, F.col("n")).otherwise(F.col("n_class")).alias("group_size"), F.col("best.uid").alias("best_uid"))
    of_head = heads.select("digest", "text_sha256", F.col("uid").alias("head_uid")).join(known, ["digest", "text_sha256"]).select("head_uid", "keep_id", "group_size", "best_uid")
    merged = members.select("doc_id", "uid", "head_uid", "text_sha256").join(of_head, "head_uid", "left")
    return merged.select(
        "doc_id",
        "uid",
        F.when(F.col("best_uid").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("best_uid") == F.col("uid"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows that stay, with every column of ``docs``.

    Only the doomed (identifier, digest) pairs are joined back, so texts are not shuffled
    when those fit the broadcast limit; otherwise Spark sorts and merges. A pair that both
    stays and goes is a repeated row: one of its rows stays.
    """
    verdicts = materialise(exact_groups(docs, id_col, text_col, keep).select("doc_id", "text_sha256", "kept"), "exact-verdicts")
    gone = verdicts.where("not kept").select("doc_id", "text_sha256").distinct()
    stay = verdicts.where("kept").select("doc_id", "text_sha256")
    same = [gone["doc_id"].eqNullSafe(stay["doc_id"]), gone["text_sha256"] == stay["text_sha256"]]
    sha, of, doc = (free_name(x, docs.columns) for x in ("text_digest", "gone_digest", "gone_id"))
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = docs.withColumn(sha, F.sha2(lower, 256))

    def pick(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.toDF(doc, of)
        return rows.join(keys, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(sha) == F.col(of)), how)

    out = pick(keyed, gone.join(stay, same, "left_anti"), "left_anti")
    repeated = gone.join(stay, same, "left_semi")
    if repeated.take(1):
        out = pick(out, repeated, "left_anti").union(pick(out, repeated, "left_semi").dropDuplicates([id_col, sha]))
    return out.drop(sha)


NAME = "op5_exact_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"), keep="max")
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
