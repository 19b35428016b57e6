"""JSON and YAML inputs: result files, exported windows, few-shot examples and settings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.samples import ACCEL, AXES, GYRO, NAN

_XYZ = "struct<x:array<double>,y:array<double>,z:array<double>>"
_NODE = f"struct<has_gyro:boolean,t:array<double>,accel_g:{_XYZ},gyro_dps:{_XYZ}>"
#: Schema of an exported window's document.
WINDOW_JSON = f"dataset string, subject string, activity string, start_sec double, end_sec double, nodes map<string,{_NODE}>"


def read_result(spark: SparkSession, path: str) -> DataFrame | None:
    """A pretty-printed JSON result, or None where there is none."""
    try:
        return spark.read.option("multiLine", "true").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_waveforms(spark: SparkSession, path: str) -> DataFrame:
    """Exported windows as frames: a null element is a dropped sample (NaN), a null gyroscope an absent one."""
    rows = spark.read.schema(WINDOW_JSON).option("multiLine", "true").json(path)
    return waveform_frames(rows.select("*", F.lit(1).alias("seg"), F.lit(0).cast("long").alias("win")))


def waveform_frames(rows: DataFrame) -> DataFrame:
    per = rows.select("dataset", "subject", "seg", "win", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), F.col("activity").alias("label"), F.explode("nodes").alias("node", "n"))
    each = per.select("*", F.posexplode("n.t").alias("pos", "rel"))
    dropped = F.lit(NAN)
    accel = [F.coalesce(F.get(F.col(f"n.accel_g.{a}"), F.col("pos")), dropped).alias(c) for a, c in zip(AXES, ACCEL, strict=True)]
    gyro = [F.when(F.col("n.has_gyro"), F.coalesce(F.get(F.col(f"n.gyro_dps.{a}"), F.col("pos")), dropped)).alias(c) for a, c in zip(AXES, GYRO, strict=True)]
    return each.select("dataset", "subject", "seg", "win", "start", "end", "label", "node", (F.col("pos") + 1).alias("idx"), (F.col("start") + F.col("rel")).alias("t"), *accel, *gyro, F.col("n.has_gyro").alias("has_gyro"))


_PAIR = f"dataset string, subject string, activity string, seg long, win long, start_sec double, end_sec double, failure string, severity int, target_node string, realised map<string,double>, clean map<string,{_NODE}>, injected {_NODE}"


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Exported pairs of a folder, a row a document, by Spark's reader; only files that the manifest's write left are there."""
    return spark.read.schema(_PAIR).option("multiLine", "true").option("pathGlobFilter", "*_sev*.json").json(folder)


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A small YAML file by Spark's reader (settings, few-shot examples); needs the yaml package."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    text = spark.read.option("wholetext", "true").text(path).first()
    return (yaml.safe_load(text[0]) if text else None) or {}


def overlay(settings: dict, env: Mapping[str, str], names: Mapping[str, str]) -> dict:
    """``settings`` with entries replaced where their environment variable is set and not blank."""
    return settings | {key: env[var].strip() for key, var in names.items() if env.get(var, "").strip()}


def few_shot_examples(spark: SparkSession, doc: dict) -> DataFrame:
    """(activity, letter, subject, start_sec, features) of a few-shot document."""
    rows = [(e["activity"], e["letter"], e["subject"], float(e["start_sec"]), e["features"]) for e in doc.get("examples", [])]
    return spark.createDataFrame(rows, "activity string, letter string, subject string, start_sec double, features string")
