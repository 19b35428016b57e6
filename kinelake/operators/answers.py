"""Scoring that can be taken up again: no prompt is asked twice, whatever fails in between.

An ask is named by a digest of (style, model, prompt, repeat). What is already in the table
of answers is taken out by an anti join; the rest is dealt into small batches, which are
stored before any is sent, so that a retried task has the same ones. A batch's answers
are one file under the batch's own name, which appears whole or not at all: a job that
fails keeps every batch that was answered, and a retried task finds its own file and sends nothing.
(A batch that a lost executor had sent and not yet written is sent again.)

The table is a folder of Parquet files that all executors reach, by Arrow's file systems.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from ..tables import written

#: Prompts that are sent, and kept, together.
BATCH = 32
_SCHEMA = "ask string, response string"


def ask_name(style: str, model: str, prompt: Column, repeat: Column) -> Column:
    """Lengths go before the texts, so that no two asks run together to one name."""
    parts = [F.lit(style), F.lit(model), prompt, repeat.cast("string")]
    return F.sha2(F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def answered(spark: SparkSession, store: str) -> DataFrame:
    """(ask, response) of all that has been answered."""
    from pyarrow import fs

    place, folder = fs.FileSystem.from_uri(store)
    place.create_dir(folder, recursive=True)
    return spark.read.schema(_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(store)


def _keep(store: str, name: str, table: pa.Table) -> None:
    from pyarrow import fs

    place, folder = fs.FileSystem.from_uri(store)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with place.open_output_stream(own) as stream:
        pq.write_table(table, stream)
    place.move(own, f"{folder}/{name}.parquet")


def score_once(prompts: DataFrame, store: str, scorer: Callable[[list[str]], list[str]], style: str, model: str, repeats: int = 1, prompt_col: str = "prompt") -> DataFrame:
    """``prompts``, each ``repeats`` times, with ``repeat`` (from 0) and ``response``. Equal prompts are asked once a repeat.

    A null prompt is asked as an empty one.
    """
    spark = prompts.sparkSession
    ship(spark)
    rows = prompts.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = written(rows.withColumn("ask", ask_name(style, model, F.coalesce(F.col(prompt_col), F.lit("")), F.col("repeat"))), "asks")
    wanted = rows.groupBy("ask").agg(F.first(F.coalesce(F.col(prompt_col), F.lit(""))).alias("prompt"))
    todo = wanted.join(answered(spark, store), "ask", "left_anti").repartition("ask").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy("ask"))
    batches = written(todo.withColumn("batch", F.floor((place - 1) / BATCH)), "asks-open")

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        pdf = pdf.sort_values("ask")
        name = hashlib.sha256("".join(pdf["ask"]).encode()).hexdigest()
        where, folder = fs.FileSystem.from_uri(store)
        if where.get_file_info(f"{folder}/{name}.parquet").type != fs.FileType.File:
            said = scorer(pdf["prompt"].tolist())
            if len(said) != len(pdf):
                raise ValueError(f"{len(said)} answers to {len(pdf)} prompts")
            _keep(store, name, pa.table({"ask": pdf["ask"].tolist(), "response": [str(s) for s in said]}))
        return pd.DataFrame({"n": [len(pdf)]})

    batches.groupBy("part", "batch").applyInPandas(ask, "n long").agg(F.sum("n")).collect()  # the answers are in the table
    return rows.join(answered(spark, store), "ask").drop("ask")
