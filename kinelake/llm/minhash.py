"""MinHash near-dedup from bottom-k sketches.

1. One hash function gives every distinct 5-word shingle a 64-bit value. A set
   keeps its k smallest (all, when it has no more) as its sketch. Equal sets
   become one node, so copies cost one row each from here on.
2. Inverted lists of retained values generate the overlaps. A pair at or above
   the threshold shares at least t of its retained values (``shared_at_least``),
   so it must meet in the lists of the ``len - t + 1`` values that come first in
   *any* order all sets agree on, and at places that leave room for t. The order
   puts values that many sets hold last, the more the later; those are counted
   exactly and their levels kept in a table of fixed size.
3. Each list first links its members to its most typical member (a star, as
   many pairs as members). Pairs pass the union-sketch estimate, then exact
   Jaccard on the full sets. Links are merged into components. Lists that still
   hold several components pair their members *across* components, which is the
   exact way for whatever the stars did not reach. There the members outside the
   centre's component meet the others, so a list of one component costs nothing,
   and a pair is made in the first list that holds both, so once. It must first
   pass its sizes, its places in the list, and a parity bitmap: bits in which two
   bitmaps differ are no more than the values in which the sets differ, and those
   are bounded by the threshold.

No list, set or component is gathered in one task or on the driver; nothing is
capped.

With k = 128, sets of at most 128 shingles are held whole and all bounds are
certain; for larger ones t and the estimate's limit lie six standard deviations
below what a pair at the threshold has on average, the parity limit six above.

Defined cases: null or empty text, or text without words, has an empty set and
is linked with nothing; a text of fewer than five words has its whole sequence
as its only shingle; a very long text is one set of all its shingles; a null doc_id takes part but never names a component that
has another identifier; repeated rows are equal sets; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, joined_components
from .shared import bloom_filter, filter_bits, free_name, in_filter, materialise, small_batches, table, utf8
from .textvec import shingle_sets

SKETCH = 128
THRESHOLD = (75, 100)
COUNT_SLOTS = 1 << 20
#: A value in more sets than this is put behind all others.
HEAVY = 32
#: Standard deviations below the threshold at which the estimate still lets a pair through.
SLACK = 6.0
PARITY_WORDS = 8
#: Sets above this size are sampled by halves for their parity bitmap.
PARITY_SET = 512


def shared_at_least(a: int, b: int, k: int = SKETCH) -> int:
    """Retained values that sets of ``a`` and ``b`` shingles, a <= b, share if they are linked."""
    num, den = THRESHOLD
    both = ceil((a + b) * num / (num + den))
    if b <= k:
        return max(1, both)
    p = min(1.0, both / b)
    return max(1, int(k * p - 6 * sqrt(k * p * (1 - p) * (b - k) / (b - 1))))


def shared_with_any(n: int, k: int = SKETCH) -> int:
    """The least of that over all sizes that a linked set can have."""
    num, den = THRESHOLD
    low, high = -(-n * num // den), n * den // num
    sizes = {low + (high - low) * i // 8 for i in range(9)} | {n, min(max(k, low), high), min(max(k + 1, low), high)}
    return max(1, min(shared_at_least(min(n, m), max(n, m), k) for m in sizes) - 1)


def shared_sql(a: str, b: str, k: int) -> str:
    """``shared_at_least`` as an expression over two size columns."""
    num, den = THRESHOLD
    big, both = f"greatest({a}, {b})", f"ceil(({a} + {b}) * {num} / {num + den}D)"
    p = f"least(1D, {both} / {big})"
    return f"CASE WHEN {big} <= {k} THEN {both} ELSE floor({k} * {p} - 6 * sqrt({k} * {p} * (1 - {p}) * ({big} - {k}) / ({big} - 1))) END"


def parity_class(n: int) -> int:
    """How often a set of n is halved for its bitmap."""
    return max(0, (n - 1).bit_length() - PARITY_SET.bit_length() + 1) if n > PARITY_SET else 0


def parity(values: np.ndarray, halved: int) -> np.ndarray:
    """A bitmap of the values whose last ``halved`` bits are zero: each flips one bit."""
    if halved:
        values = values[values & np.uint64((1 << halved) - 1) == 0]
    bit = (values >> np.uint64(20)) & np.uint64(PARITY_WORDS * 64 - 1)
    flips = np.bincount(bit.astype(np.int64), minlength=PARITY_WORDS * 64) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def parity_sql(x: str, y: str) -> str:
    """Whether two sets' bitmaps allow a link: they are compared at the larger set's class, which is the other's or the next."""
    num, den = THRESHOLD

    def differ(of_x: str, of_y: str) -> str:
        return " + ".join(f"bit_count({x}.{of_x}{i} ^ {y}.{of_y}{i})" for i in range(PARITY_WORDS))

    most = f"({x}.n + {y}.n) * {(den - num) / (den + num)!r}D"
    # {x}.spare is 0 for a set that is held whole, else six deviations of what its class leaves.
    room = f"({most} / greatest({x}.halves, {y}.halves) + greatest({x}.spare, {y}.spare) + 1e-6D)"
    return (
        f"(({x}.halved = {y}.halved and {differ('p', 'p')} <= {room}) or ({x}.halved < {y}.halved and {differ('q', 'p')} <= {room})"
        f" or ({x}.halved > {y}.halved and {differ('p', 'q')} <= {room}))"
    )


def _slot(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(7)) & np.uint64(COUNT_SLOTS - 1)


_PARITY = [f"{c}{i}" for c in "pq" for i in range(PARITY_WORDS)]
_SKETCH_SCHEMA = "doc_id long, uid long, n long, key binary, sketch binary, halved int, " + ", ".join(f"{c} long" for c in _PARITY)


def _sketches(words_per_shingle: int, k: int):
    def task(batches):
        for batch in batches:
            data, offs = utf8(batch.column(2))
            n, keys, sketches, halved, maps = [], [], [], [], []
            for values in shingle_sets(data, offs, words_per_shingle):
                c = parity_class(len(values))
                n.append(len(values))
                keys.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                sketches.append(values[:k].tobytes() if len(values) else None)
                halved.append(c)
                maps.append(np.concatenate([parity(values, c), parity(values, c + 1)]))
            bits = np.array(maps, np.int64).reshape(-1, len(_PARITY)).T
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(halved, pa.int32()), *map(pa.array, np.ascontiguousarray(bits))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "uid", "n", "key", "sketch", "halved", *_PARITY])

    return task


def _value_counts(batches):
    """(value, n): retained values, counted as far as a batch goes."""
    for batch in batches:
        raw = [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
        if raw:
            values, n = np.unique(np.concatenate(raw), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["value", "n"])


def _levels(sets: DataFrame) -> np.ndarray:
    """For each slot the level (binary logarithm of the number of sets) of the heaviest value in it, 0 where all are light.

    All retained values are counted; of the heavy ones, the heaviest COUNT_SLOTS / 4 at most get a level.
    """
    counted = sets.select("sketch").mapInArrow(_value_counts, "value long, n long").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY)
    heavy = materialise(counted.select("value", F.floor(F.log2("n")).cast("int").alias("level")), "near-heavy")
    held, least = 0, 64
    for r in heavy.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():  # a row a level
        held += r["n"]
        if held > COUNT_SLOTS // 4:
            break
        least = r["level"]
    slot = F.shiftrightunsigned("value", 7).bitwiseAND(COUNT_SLOTS - 1)
    found = heavy.where(F.col("level") >= least).groupBy(slot.alias("slot")).agg(F.max("level").alias("level")).toPandas()
    out = np.zeros(COUNT_SLOTS, np.int8)
    out[found["slot"].to_numpy(np.int64)] = found["level"].to_numpy(np.int8)
    return out


_ENTRY = "value long, sid long, n long, held int, place int, typical double"


def _list_entries(levels, k: int):
    """The retained values of a set that come first, light ones and then heavy ones by level."""

    def task(batches):
        table = levels.value
        least: dict[int, int] = {}
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for sid, n, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = np.frombuffer(raw, np.uint64)
                level = table[_slot(values).astype(np.int64)]
                if n not in least:
                    least[n] = shared_with_any(n, k)
                first = np.lexsort((values, level))[: max(0, len(values) - least[n] + 1)]
                m = len(first)
                row = (values[first].view(np.int64), np.full(m, sid), np.full(m, n), np.full(m, len(values), np.int32), np.arange(m, dtype=np.int32), np.full(m, float(level.mean())))
                for col, v in zip(cols, row, strict=True):
                    col.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["value", "sid", "n", "held", "place", "typical"])

    return task


def _estimate(k: int):
    """Union-sketch estimate; pairs whose sketches are their whole sets are decided here, exactly."""
    num, den = THRESHOLD

    def task(batches):
        for batch in batches:
            a, b, verdict = [], [], []
            for x, y, nx, ny, sx, sy in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                p, q = np.frombuffer(sx, np.uint64), np.frombuffer(sy, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if nx <= k and ny <= k:
                    good, sure = both * den >= num * (nx + ny - both), True
                else:
                    bound = min([z[-1] for z, n in ((p, nx), (q, ny)) if n > k])
                    np_, nq = int(np.searchsorted(p, bound, "right")), int(np.searchsorted(q, bound, "right"))
                    both = len(np.intersect1d(p[:np_], q[:nq], assume_unique=True))
                    union = np_ + nq - both
                    share = num / den
                    good, sure = both >= (share - SLACK * sqrt(share * (1 - share) / union)) * union, False
                if good:
                    a.append(x)
                    b.append(y)
                    verdict.append(sure)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(verdict, pa.bool_())], ["a", "b", "sure"])

    return task


def _full_sets(wanted, words_per_shingle: int):
    """Full sets of the documents that the filter lets through; the others' texts stay where they are."""

    def task(batches):
        words = wanted.value
        for batch in batches:
            pick = np.flatnonzero(in_filter(words, np.asarray(batch.column(0).fill_null(-1))))
            if not len(pick):
                continue
            data, offs = utf8(batch.column(1).take(pa.array(pick)))
            sets = [v.tobytes() for v in shingle_sets(data, offs, words_per_shingle)]
            keys = [hashlib.blake2b(v, digest_size=16).digest() if v else None for v in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "members"])

    return task


def _exact(batches):
    num, den = THRESHOLD
    for batch in batches:
        a, b = [], []
        for x, y, sx, sy in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            p, q = np.frombuffer(sx, np.uint64), np.frombuffer(sy, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            if both * den >= num * (len(p) + len(q) - both):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Linker:
    """Turns candidate pairs of sets into confirmed links."""

    def __init__(self, docs: DataFrame, sets: DataFrame, k: int, words: int):
        self.docs, self.sets, self.k, self.words = docs, sets, k, words

    def links(self, pairs: DataFrame) -> DataFrame:
        s = self.sets
        left = s.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        right = s.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        rows = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
        passed = materialise(rows.mapInArrow(_estimate(self.k), "a long, b long, sure boolean"), "near-passed")
        open_pairs = passed.where("not sure").select("a", "b")
        if not open_pairs.take(1):
            return passed.select("a", "b")
        nodes = open_pairs.select(F.col("a").alias("sid")).union(open_pairs.select("b")).distinct()
        nodes = materialise(nodes.join(s.select("sid", "key", "doc_id"), "sid"), "near-open")
        spark = self.docs.sparkSession
        wanted = spark.sparkContext.broadcast(bloom_filter(nodes.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id")), filter_bits(nodes.count())))
        full = self.docs.select("doc_id", "text").mapInArrow(_full_sets(wanted, self.words), "key binary, members binary")
        full = full.join(nodes.select("key", "sid"), "key").dropDuplicates(["sid"]).select("sid", "members")
        full = materialise(full, "near-full")
        sides = open_pairs.join(full.toDF("a", "ma"), "a").join(full.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")
        sure = sides.mapInArrow(_exact, "a long, b long")
        return passed.where("sure").select("a", "b").union(sure)


def _room(n: str, held: str, place: str, n2: str, held2: str, place2: str, k: int) -> str:
    """Sizes that can link, and places from which as many values as a link shares can follow."""
    num, den = THRESHOLD
    t = shared_sql(n, n2, k)
    return f"{n} * {den} >= {n2} * {num} and {n2} * {den} >= {n} * {num} and {held} - {place} >= {t} and {held2} - {place2} >= {t}"


def _room_in_list(k: int) -> str:
    """Whether a member's place leaves room for a link with any size between the list's ``least`` and ``most``."""
    num, den = THRESHOLD
    low, high = f"greatest(least, ceil(n * {num} / {den}D))", f"least(most, floor(n * {den} / {num}D))"
    t = f"least({shared_sql('n', low, k)}, {shared_sql('n', high, k)})"
    return f"held - place >= {t} - 1"


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, k: int = SKETCH) -> DataFrame:
    """One row a document: doc_id, uid, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text")
    sketched = materialise(rows.mapInArrow(_sketches(words, k), _SKETCH_SCHEMA), "near-sketches")
    some = sketched.where("n > 0")
    sets = some.groupBy("key").agg(F.min("uid").alias("sid"), F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "sketch", "halved", *_PARITY)])
    sets = materialise(sets, "near-sets")
    linker = _Linker(docs, sets, k, words)

    levels = spark.sparkContext.broadcast(_levels(sets))
    entries = sets.select("sid", "n", "sketch").mapInArrow(_list_entries(levels, k), _ENTRY)
    heads = entries.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("typical", "sid", "n", "held", "place")).alias("c")).where("members > 1")
    heads = heads.select("value", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("sid", "n", "held", "place")])
    lists = materialise(entries.drop("typical").join(heads, "value"), "near-lists")
    stars = lists.where("sid <> c_sid").where(_room("n", "held", "place", "c_n", "c_held", "c_place", k)).select(F.least("sid", "c_sid").alias("a"), F.greatest("sid", "c_sid").alias("b")).distinct()
    links = materialise(linker.links(stars), "near-links")
    comps = materialise(connected_components(links), "near-components")

    # What the stars left: lists whose members are not all in one component, and of those the
    # members whose place leaves room for a link with the sizes that the list has.
    halves = F.pow(F.lit(2.0), F.col("halved"))
    spare = F.when(F.col("halved") == 0, 0.0).otherwise(6 * F.sqrt(F.col("n") * (8.0 / 21) / halves) + 6)
    bits = sets.select("sid", "halved", halves.alias("halves"), spare.alias("spare"), *_PARITY)
    placed = lists.join(comps.withColumnRenamed("node", "sid"), "sid", "left").select("value", "sid", "n", "held", "place", "c_sid", F.coalesce("component", "sid").alias("component"))
    of_centre = F.max(F.when(F.col("sid") == F.col("c_sid"), F.col("component"))).alias("main")
    split = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"), of_centre).where("lo <> hi")
    near = placed.where("sid <> c_sid").join(split, "value").where(_room_in_list(k)).select("sid", "n", "component", F.struct("place", "value", (F.col("component") != F.col("main")).alias("apart")).alias("at"))
    # A set's places in order, k at most, so that each carries the values before it.
    per_set = near.groupBy("sid").agg(F.first("n").alias("n"), F.first("component").alias("component"), F.array_sort(F.collect_list("at")).alias("at"))
    rest = per_set.join(bits, "sid").select("*", F.posexplode("at").alias("i", "here")).withColumns({"value": F.col("here.value"), "apart": F.col("here.apart"), "before": F.expr("transform(slice(at, 1, i), p -> p.value)")}).drop("at", "i", "here")
    rest = materialise(rest, "near-rest")
    num, den = THRESHOLD
    # Members of the centre's component meet only those outside; a pair counts in the first list that both are in.
    fits = f"x.value = y.value and x.component <> y.component and (not y.apart or x.sid < y.sid) and x.n * {den} >= y.n * {num} and y.n * {den} >= x.n * {num}"
    across = rest.where("apart").alias("x").join(rest.alias("y"), F.expr(f"{fits} and {parity_sql('x', 'y')} and not arrays_overlap(x.before, y.before)"))
    across = across.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))
    more = materialise(linker.links(materialise(across, "near-across")), "near-links")
    if more.take(1):
        comps = materialise(joined_components(comps, more), "near-components")

    mapped = sketched.select("doc_id", "uid", "n", "key").join(sets.select("key", "sid"), "key", "left").join(comps.withColumnRenamed("node", "sid"), "sid", "left")
    mapped = materialise(mapped.select("doc_id", "uid", "n", F.coalesce("component", "sid", "uid").alias("component"), F.coalesce("component", "sid").isNotNull().alias("linked")), "near-mapped")
    names = materialise(mapped.groupBy("component").agg(F.min("doc_id").alias("component_id")), "near-names")
    out = mapped.join(names, "component")
    return out.select("doc_id", "uid", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, all columns kept.

    Rows that share an identifier are one document; rows without one stay.
    """
    gone_id = free_name("gone_id", docs.columns)
    verdicts = near_groups(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = verdicts.where("not kept").select(F.col("doc_id").alias(gone_id))
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")


NAME = "op6_minhash_near_dedup"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS sh
  FROM w
), d AS (SELECT DISTINCT doc_id, sh FROM s),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM d x JOIN d y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT e.b, r.reach FROM r JOIN e ON e.a = r.node WHERE r.reach < e.b),
m AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w JOIN m ON m.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
