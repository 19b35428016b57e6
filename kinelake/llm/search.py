"""Ranked lexical search by Fagin's threshold algorithm, over shards of documents.

Each task turns its documents into shards. A shard holds, for the terms that are asked
for, inverted lists sorted by impact and a forward index (the terms and impacts of each
document). For an item, the lists of its terms are read round-robin from their tops;
each document met for the first time is looked up in the forward index and so gets its
whole score; once the sum of the impacts last read falls strictly below the k-th best
score, no document unread can reach the top or tie with it, and the search stops. The
tops of all shards are merged by one ranking per item.

Impacts need counts over all documents (documents, their lengths, documents a term),
so a first pass writes what the shards are made of, and the counts are summed from that;
texts are read once. Items come in blocks of bounded size, each searched in all
documents: what a task is sent is one block's terms, and the driver sees one number a
term of a block. No list of a frequent term is ever in one place.

Ties are ordered by doc_id, rows without one last.

Defined cases: a null or empty text has no terms and is found by nothing; an item
without terms finds nothing; a very long text is counted whole; repeated rows of
``docs`` are documents of their own; rows of ``items`` that share an identifier are one
item; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, small_batches, table

# The ranking's constants.
TOP, SCALE, GAIN, FLOOR, SHARE = 10, 1_000_000_000, 8, 10, 90
#: Documents and postings of a shard, about.
SHARD_DOCS, SHARD_POSTINGS = 4096, 2_000_000
#: Pairs of an item and a term in a block, at most (an item with more is a block of its own).
BLOCK_PAIRS = 500_000
#: What is read of each list before the threshold is looked at first; twice as much each time after.
FIRST_DEPTH = 16

#: Upper case to lower case and all that parts terms to a space, for bytes; bytes from 128 on belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Letters, digits and all that is not ASCII, in longest stretches; only A-Z are lower-cased."""
    return text.translate(_FOLD).split() if text else []


_SHARD = "docs binary, lengths binary, sizes binary, codes binary, counts binary, nameless binary"


def _shards(docs: DataFrame, id_col: str, text_col: str, code_of: dict[bytes, int]) -> DataFrame:
    """One row a shard: identifiers, terms of each document, and the asked terms that each holds with their counts."""
    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("text"), F.col(id_col).cast("long").alias("doc"))
    names = [f.split()[0] for f in _SHARD.split(", ")]
    find = code_of.get

    def task(batches):
        ids: list[int] = []
        nameless: list[bool] = []
        lengths: list[int] = []
        sizes: list[int] = []
        codes: list[int] = []
        counts: list[int] = []

        def row():
            columns = [(ids, np.int64), (lengths, np.int64), (sizes, np.int32), (codes, np.int32), (counts, np.int32), (nameless, np.bool_)]
            out = pa.RecordBatch.from_arrays([pa.array([np.array(c, k).tobytes()], pa.binary()) for c, k in columns], names)
            for c, _ in columns:
                c.clear()
            return out

        for batch in batches:
            for text, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = terms(text)
                if not own:
                    continue
                held = [(code, n) for code, n in ((find(t), n) for t, n in Counter(own).items()) if code is not None]
                ids.append(0 if doc is None else doc)
                nameless.append(doc is None)
                lengths.append(len(own))
                sizes.append(len(held))
                codes.extend(code for code, _ in held)
                counts.extend(n for _, n in held)
                if len(ids) >= SHARD_DOCS or len(codes) >= SHARD_POSTINGS:
                    yield row()
        if ids:
            yield row()

    return rows.mapInArrow(task, _SHARD)


def _counted(shards: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, documents of each asked term)."""

    def task(batches):
        for batch in batches:
            for lengths, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, n = np.unique(np.frombuffer(codes, np.int32), return_counts=True)
                own = np.frombuffer(lengths, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], found]).astype(np.int64)), pa.array(np.concatenate([[len(own), own.sum()], n]).astype(np.int64))], ["code", "n"])

    summed = shards.select("lengths", "codes").mapInArrow(task, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    held = np.zeros(n_terms, np.int64)
    docs = length = 0
    for r in summed.collect():  # one number a term of the block
        if r["code"] == -2:
            docs = r["n"]
        elif r["code"] == -1:
            length = r["n"]
        else:
            held[r["code"]] = r["n"]
    return docs, length, held


class Shard:
    """Impact-sorted lists and the forward index of some documents."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        lengths, sizes = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        self.codes, tf = np.frombuffer(row["codes"], np.int32), np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.ids, self.nameless = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["nameless"], np.bool_)
        self.begin = np.cumsum(sizes) - sizes
        self.sizes = sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        norm = FLOOR + (SHARE * lengths * n_docs) // n_terms
        self.impact = weights[self.codes] * ((SCALE * tf) // (1000 * tf + GAIN * norm[of]))
        # Within equal impacts any order is right: a list's next impact alone decides when to stop.
        order = np.lexsort((-self.impact, self.codes))
        self.list_doc, self.list_impact = of[order], self.impact[order]
        self.bounds = np.searchsorted(self.codes[order], np.arange(len(weights) + 1))
        # The order of ties: by identifier, those without one last.
        self.place = np.empty(len(sizes), np.int64)
        self.place[np.lexsort((self.ids, self.nameless))] = np.arange(len(sizes))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whole scores by the forward index; ``asked`` marks the item's terms."""
        size = self.sizes[docs]
        upto = np.cumsum(size)
        at = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self.begin[docs] - upto + size, size)
        value = np.where(asked[self.codes[at]], self.impact[at], 0)
        total = np.concatenate([[0], np.cumsum(value)])
        return total[upto] - total[upto - size]

    def top(self, codes: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best ``k``, best first, by the threshold algorithm."""
        low, high = self.bounds[codes], self.bounds[codes + 1]
        low, high = low[low < high], high[low < high]
        seen = np.zeros(len(self.sizes), bool)
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth = FIRST_DEPTH
        while len(low):
            upto = np.minimum(low + depth, high)
            size = upto - low
            ends = np.cumsum(size)
            at = np.arange(int(ends[-1])) + np.repeat(low - ends + size, size)
            new = np.unique(self.list_doc[at])
            new = new[~seen[new]]
            seen[new] = True
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new, asked)])
            best = np.lexsort((self.place[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            more = upto < high
            threshold = int(self.list_impact[upto[more] - 1].sum())
            if len(scores) == k and threshold < scores[-1]:
                break
            low, high = upto[more], high[more]
            depth *= 2
        return docs[scores > 0], scores[scores > 0]


def _tops(shards: DataFrame, items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the best ``k`` of every shard for each item of the block."""

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, weights, n_docs, n_terms)
                asked = np.zeros(len(weights), bool)
                number, found, score = ([np.zeros(0, np.int64)] for _ in range(3))
                for i, (_, codes) in enumerate(items):
                    asked[codes] = True
                    docs, scores = shard.top(codes, asked, k)
                    asked[codes] = False
                    number.append(np.full(len(docs), i))
                    found.append(docs)
                    score.append(scores)
                of, docs = np.concatenate(number), np.concatenate(found)
                named = pa.array(shard.ids[docs], mask=shard.nameless[docs])
                yield pa.RecordBatch.from_arrays([pa.array([items[i][0] for i in of.tolist()], pa.int64()), named, pa.array(np.concatenate(score))], ["item_id", "doc_id", "score"])

    return shards.mapInArrow(task, "item_id long, doc_id long, score long")


def _blocks(pairs: DataFrame) -> list:
    """For each block of items the condition that picks its pairs: as many blocks as it takes for each to be small, by a hash of the item."""
    per = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    n = 1
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(n))
        worst = per.groupBy(block.alias("block")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items")).where((F.col("n") > BLOCK_PAIRS) & (F.col("items") > 1))
        if worst.isEmpty():
            return [block == i for i in range(n)]
        n *= 4


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item; fewer where fewer score above 0."""
    spark = docs.sparkSession
    small_batches(spark, 500)

    def split(batches):
        for batch in batches:
            own = [(item, t) for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in set(terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([t for _, t in own], pa.binary())], ["item_id", "term"])

    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").cast("binary").alias("text"))
    pairs = materialise(asked.mapInArrow(split, "item_id long, term binary").distinct(), "asked-terms")
    best = None
    for block in _blocks(pairs):
        rows = pairs.where(block).collect()  # BLOCK_PAIRS at most, or one item's terms
        code_of = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        by_item: dict[int | None, list[int]] = {}
        for r in rows:
            by_item.setdefault(r["item_id"], []).append(code_of[bytes(r["term"])])
        shards = materialise(_shards(docs, id_col, text_col, code_of), "search-shards")
        n_docs, n_terms, held = _counted(shards, len(code_of))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
        found = _tops(shards, [(item, np.array(sorted(codes), np.int64)) for item, codes in by_item.items()], weights, n_docs, n_terms, k)
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


NAME = "op11_ranked_search"

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')"
SQL = f"""
WITH said AS (SELECT doc_id, unnest({_SPLIT}) AS term FROM documents),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark)),
sizes AS (SELECT doc_id, count(*) AS n FROM said GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
held AS (SELECT doc_id, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
impacts AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))) AS impact
  FROM held JOIN sizes USING (doc_id) JOIN weights USING (term), totals
),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 10"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
