"""An event stream as three-node samples.

A user is a subject, an event a sample of one node by ``event_id % 3``, time is
microseconds as a double (whole numbers below 2**53, so that window arithmetic
is exact). Dropped samples (NaN), partly dropped ones and an absent gyroscope
(the chest has none) come from residues of the identifier, and every fourth
user's values are coarse, so that they repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.samples import NAN

HOUR_US = 3_600_000_000.0
SECOND_US = 1_000_000.0


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    return samples_from_events(events)


def samples_from_events(events: DataFrame) -> DataFrame:
    """Works on batches and streams alike."""
    k = F.get_json_object("props", "$.k").cast("double")
    coarse = F.col("user_id") % 4 == 0
    x = F.when(coarse, F.floor(F.col("value") / 40.0).cast("double")).otherwise(F.col("value") / 50.0)
    y = F.when(coarse, F.lit(0.0)).otherwise(k / 100.0 - 0.5)
    z = F.when(coarse, F.lit(0.5)).otherwise((F.col("value") - k) / 100.0)
    lost, part = F.col("event_id") % 11 == 0, F.col("event_id") % 13 == 0
    node = F.element_at(F.array(F.lit("wrist"), F.lit("chest"), F.lit("ankle")), (F.col("event_id") % 3 + 1).cast("int"))
    has_gyro = F.col("event_id") % 3 != 1
    glost = F.col("event_id") % 17 == 0
    gyro = {"gx": k / 10.0, "gy": F.col("value") / 10.0, "gz": F.lit(1.0)}
    return events.select(
        F.lit("events").alias("dataset"),
        F.col("user_id").alias("subject"),
        F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"),
        F.col("event_id").alias("ord"),
        F.col("event_type").alias("activity"),
        node.alias("node"),
        F.when(lost, F.lit(NAN)).otherwise(x).alias("ax"),
        F.when(lost | part, F.lit(NAN)).otherwise(y).alias("ay"),
        F.when(lost, F.lit(NAN)).otherwise(z).alias("az"),
        *[F.when(has_gyro, F.when(glost, F.lit(NAN)).otherwise(v)).alias(n) for n, v in gyro.items()],
        has_gyro.alias("has_gyro"),
    )
