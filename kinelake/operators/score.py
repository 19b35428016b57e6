"""Scoring verdicts against ground truth: the only place where the two meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import share
from . import WINDOW_KEY
from .diagnose import DIAGNOSES
from .inject import REALISED_KEY


def tally(verdicts: DataFrame, truth: DataFrame | None, labels: DataFrame | None = None) -> DataFrame:
    """One row a node-window: what was true, what was said, and the measured size of the failure.

    ``truth`` None (or a window without a row) is a clean window. ``labels``: WINDOW_KEY and label.
    """
    key = list(WINDOW_KEY)
    if truth is None:
        rows = verdicts.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("target_node", "string"), ("failure", "string"), ("severity", "int"), ("realised", "map<string,double>"), ("clock_source", "string"))])
    else:
        kept = truth.select(*key, "target_node", "failure", "severity", "realised", F.col("clock_source") if "clock_source" in truth.columns else F.lit(None).cast("string").alias("clock_source"))
        rows = verdicts.join(kept, key, "left")
    if labels is not None:
        rows = rows.join(labels.select(*key, F.col("label").alias("activity")), key, "left")
    else:
        rows = rows.withColumn("activity", F.lit(None).cast("string"))
    hit = F.coalesce(F.col("node") == F.col("target_node"), F.lit(False))
    size = F.lit(None).cast("double")
    for name, effect in REALISED_KEY.items():
        size = F.when(F.col("failure") == name, F.try_element_at("realised", F.lit(effect))).otherwise(size)
    return rows.select(
        *key,
        "node",
        "start",
        "end",
        "activity",
        hit.alias("is_target"),
        F.col("failure").alias("true_failure"),
        "severity",
        F.when(hit & F.col("failure").isNotNull(), F.col("failure")).otherwise("healthy").alias("expected_diagnosis"),
        F.col("diagnosis").alias("predicted_diagnosis"),
        "flagged",
        "state",
        "min_sub_score",
        size.alias("realised_magnitude"),
        F.try_element_at("realised", F.lit("gravity_axis_alignment")).alias("alignment"),
        F.try_element_at("realised", F.lit("onset")).alias("onset"),
        "clock_source",
    )


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))}


def detection(rows: DataFrame) -> DataFrame:
    """Precision, recall and F1 by (failure, severity) and, with a null severity, pooled by failure.

    Non-target nodes of injected windows count as false positives where flagged.
    """
    grouped = rows.where("true_failure is not null").groupingSets([["true_failure", "severity"], ["true_failure"]], "true_failure", "severity")
    counted = grouped.agg(
        F.sum((F.col("is_target") & F.col("flagged")).cast("long")).alias("tp"),
        F.sum((~F.col("is_target") & F.col("flagged")).cast("long")).alias("fp"),
        F.sum((F.col("is_target") & ~F.col("flagged")).cast("long")).alias("fn"),
    )
    return counted.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn")))


def _diagnosed(rows: DataFrame) -> DataFrame:
    """Target nodes of injected windows, and every node of clean ones."""
    return rows.where("is_target or true_failure is null")


def confusion(rows: DataFrame) -> DataFrame:
    """One row an expected diagnosis, a column a predicted one, zeros filled in, with the row's total and accuracy."""
    counts = _diagnosed(rows).groupBy("expected_diagnosis").agg(*[F.sum((F.col("predicted_diagnosis") == d).cast("long")).alias(d) for d in DIAGNOSES])
    every = rows.sparkSession.createDataFrame([(d,) for d in DIAGNOSES], "expected_diagnosis string")
    full = F.broadcast(every).join(counts, "expected_diagnosis", "left").na.fill(0, list(DIAGNOSES))
    own = F.lit(0).cast("long")
    for d in DIAGNOSES:
        own = F.when(F.col("expected_diagnosis") == d, F.col(d)).otherwise(own)
    n = sum(F.col(d) for d in DIAGNOSES)
    return full.withColumns({"n": n, "accuracy": F.try_divide(own.cast("double"), n)})


def diagnosis_accuracy(rows: DataFrame) -> DataFrame:
    right = (F.col("expected_diagnosis") == F.col("predicted_diagnosis")).cast("long")
    return _diagnosed(rows).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"))


def false_positives(rows: DataFrame) -> DataFrame:
    """Flagged share of clean node-windows, by node and, with a null node, over all."""
    clean = rows.where("true_failure is null")
    per = clean.groupingSets([["node"], []], "node").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("flagged").cast("long")), F.lit(0)).alias("fp"))
    return per.withColumn("rate", share(F.col("fp"), F.col("n")))


def misdiagnosed(rows: DataFrame) -> DataFrame:
    """What flagged clean nodes were taken for."""
    return rows.where("true_failure is null and flagged").groupBy("predicted_diagnosis").agg(F.count(F.lit(1)).alias("n"))


def _by(rows: DataFrame, failure: str, *keys: str) -> DataFrame:
    hit = rows.where((F.col("true_failure") == failure) & F.col("is_target"))
    return hit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("flagged").cast("long")).alias("detected"),
        F.sum((F.col("predicted_diagnosis") == failure).cast("long")).alias("diagnosed"),
        F.avg("realised_magnitude").alias("mean_realised"),
        F.avg("alignment").alias("mean_alignment"),
    ).withColumns({"recall": share(F.col("detected"), F.col("n")), "diagnosis_accuracy": share(F.col("diagnosed"), F.col("n"))})


def displacement_by_activity(rows: DataFrame) -> DataFrame:
    return _by(rows, "displacement", "node", "activity").withColumn("undetectable", F.col("recall") < 0.5)


def desync_by_clock(rows: DataFrame) -> DataFrame:
    """Measured and derived clocks are not comparable and never pooled."""
    return _by(rows.withColumn("clock_source", F.coalesce("clock_source", F.lit("unknown"))), "clock_desync", "clock_source").drop("mean_realised", "mean_alignment")


def detection_latency(rows: DataFrame, per_second: float = 1.0) -> DataFrame:
    """For each (stream, failure, severity, target) with an onset: the end of its first flagged window from the onset on."""
    keys = ["dataset", "subject", "true_failure", "severity", "node"]
    known = rows.where("is_target and onset is not null").withColumn("onset", F.min("onset").over(Window.partitionBy(*keys)))
    seen = F.min(F.when(F.col("flagged") & (F.col("end") >= F.col("onset")), F.col("end")))
    first = known.groupBy(*keys).agg(F.first("onset").alias("onset"), seen.alias("detected_by"))
    late = F.greatest(F.lit(0.0), F.col("detected_by") - F.col("onset")) / per_second
    return first.withColumn("latency_sec", F.when(F.col("detected_by").isNotNull(), late))


def class_confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """N x N confusion of (true_label, predicted_label): a row a true label, a column a predicted one."""
    return pairs.groupBy("true_label").pivot("predicted_label", labels).count().na.fill(0)


def top_confused(pairs: DataFrame, labels: list[str], top: int = 3) -> DataFrame:
    """The most frequent wrong pairs, equals in label order, with their share of the true class."""
    order = F.create_map(*[x for i, name in enumerate(labels) for x in (F.lit(name), F.lit(i))])
    counts = pairs.groupBy("true_label", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("of_true", F.sum("n").over(Window.partitionBy("true_label")))
    wrong = counts.where("true_label <> predicted_label").withColumn("rate_of_true_class", F.col("n") / F.col("of_true")).drop("of_true")
    return wrong.orderBy(F.desc("n"), order[F.col("true_label")], order[F.col("predicted_label")]).limit(top)


POSTURES, STAIRS = ("lying", "sitting", "standing"), ("ascending_stairs", "descending_stairs")


def fix_ranking(top: DataFrame, overall_accuracy: float) -> DataFrame:
    """Which of four fixes the most confused pairs speak for first: one row."""
    stairs = F.col("true_label").isin(*STAIRS) | F.col("predicted_label").isin(*STAIRS)
    posture = F.col("true_label").isin(*POSTURES) & F.col("predicted_label").isin(*POSTURES)
    sums = top.agg(F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)).alias("all_n"), F.coalesce(F.sum(F.when(stairs, F.col("n"))), F.lit(0)).alias("stairs_n"), F.coalesce(F.sum(F.when(posture, F.col("n"))), F.lit(0)).alias("posture_n"))
    first = (
        F.when(F.col("stairs_n") / F.col("all_n") >= 0.5, "drop the stair classes")
        .when(F.col("posture_n") >= 0.3 * F.col("all_n"), "richer features")
        .when(F.lit(overall_accuracy) < 0.25, "few-shot examples and prompt")
        .otherwise("better few-shot examples")
    )
    return sums.select(F.try_divide(F.col("stairs_n").cast("double"), F.col("all_n")).alias("stair_share"), F.try_divide(F.col("posture_n").cast("double"), F.col("all_n")).alias("posture_share"), first.alias("first_fix"))
