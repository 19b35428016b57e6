"""The corpus pipeline: documents pass five stages, each written as Parquet and read again by the next.

toxicity: documents scored 0.5 or more go. exact_dedup: of equal texts one row
stays. near_dedup: of each group of near copies one document stays. mix_sources:
documents are repeated or left out so that sources near their target weights.
bpe: token ids, and the digest of the text decoded from them.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. Null, empty and very
long texts, ties, repeated rows, empty tables and further columns are handled as
each operator states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm.bpe import encode_texts
from kinelake.llm.exact_dedup import drop_copies
from kinelake.llm.minhash import keep_one
from kinelake.llm.mixing import mix_sources
from kinelake.llm.shared import shared_dir, table
from kinelake.llm.toxicity import drop_toxic
from kinelake.tables import remove, scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix_sources(docs)
    return mixed.select(*[mixed[c] for c in docs.columns])


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = encode_texts(docs, keep=("doc_id", "lang", "source"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix), ("bpe", bpe)]

ORACLE_SQL = None  # a fitted classifier and merges by rank have no SQL form; tests compare each stage with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from its table. What a stage wrote on its way goes once its own table is written, and that once the next one is."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{place}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{place}/{name}")
        if before:
            remove(spark, before)
        before = f"{place}/{name}"
    return docs
