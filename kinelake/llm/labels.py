"""Labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Labelled rows used to fit a classifier, at most: those with the smallest hash of their identifier.
FIT_ROWS = 12_000
#: Bytes of their texts, at most, in the same order (the first is always taken).
FIT_BYTES = 128 << 20


def remainder(doc_id, modulus: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, learn, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents whose remainder ``learn`` admits, and FIT_BYTES of text.

    The identifiers are a bounded set, so their broadcast is bounded too and texts stay where they
    are. Of rows that share an identifier the least text counts.
    """
    good = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn(remainder(F.col("doc_id"), modulus)))
    picked = good.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = own.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    found = materialise(found.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), "labelled")
    upto = F.sum("bytes").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most ``rows`` numbers
    kept = found.select("doc_id", "bytes").withColumn("upto", upto).where((F.col("upto") <= FIT_BYTES) | (F.col("upto") == F.col("bytes")))
    return found.join(F.broadcast(kept.select("doc_id")), "doc_id").select("doc_id", "text", "label")
