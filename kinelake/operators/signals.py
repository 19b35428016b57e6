"""Observable signals of one node in one window, and their sub-scores.

One pass: window functions over (window, node) mark repeats, runs and gaps, and
one aggregation by the same key gathers them, so frames are shuffled once. Distinct
values are counted by their first places: a distinct aggregate would keep every
other sum once a value instead of once a node. Only observations are read (see ``blind``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import ACCEL, GYRO, any_nan, clip, norm, share
from . import NODE_KEY, WINDOW_KEY
from .blind import require_blind

# Plausible magnitude (g), full scale (g), synchrony (ms).
PLAUSIBLE_G = (0.2, 8.0)
FULL_SCALE_G = 16.0
SYNC_TOLERANCE_MS, SYNC_SCALE_MS = 25.0, 200.0

SUB_SCORES = ("completeness", "staleness", "temporal", "sanity", "synchrony")


def marked(frames: DataFrame) -> DataFrame:
    """Per sample: missing, whether it equals the valid sample before it or is the first with its value, and the run (of repeats, of missing ones) up to it.

    All but ``fresh`` looks along one order, so that a node's samples are sorted for it once. ``fresh``
    comes last: Spark moves the window with more keys to the end, and what followed would be sorted anew.
    """
    order = Window.partitionBy(*NODE_KEY).orderBy("idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    valid = ~F.col("miss")
    rows = frames.withColumn("miss", any_nan())
    vec = F.when(valid, F.struct(*[(F.col(c) + F.lit(0.0)).alias(c) for c in ACCEL]))
    rows = rows.withColumn("dupe", F.coalesce(vec == F.last(vec, ignorenulls=True).over(before), F.lit(False)))
    rows = rows.withColumns({"dt": F.col("t") - F.lag("t").over(order), "place": F.row_number().over(order), "n_valid": F.sum(valid.cast("int")).over(upto)})
    began = F.last(F.when(valid & ~F.col("dupe"), F.col("n_valid")), ignorenulls=True).over(upto)
    seen = F.coalesce(F.last(F.when(valid, F.col("place")), ignorenulls=True).over(upto), F.lit(0))
    rows = rows.withColumns({"repeat_run": F.when(valid, F.col("n_valid") - began + 1), "miss_run": F.col("place") - seen}).drop("place", "n_valid")
    same = Window.partitionBy(*NODE_KEY, "miss", *ACCEL).orderBy("idx")  # as a key, a zero has no sign
    return rows.withColumn("fresh", valid & (F.row_number().over(same) == 1))


def node_signals(frames: DataFrame, per_second: float = 1.0, rate_hz: float | None = None) -> DataFrame:
    """NODE_KEY, start, end and every signal; ``per_second`` is how many units of time a second has.

    Sub-scores and the offset against the other nodes are added by ``with_offset``
    and ``with_sub_scores``, or by ``window_signals`` at once.
    """
    rows = marked(require_blind(frames, "node_signals"))
    valid = ~F.col("miss")
    vec = [F.when(valid, F.col(c)) for c in ACCEL]
    mag = F.when(valid, norm(*[F.col(c) for c in ACCEL]))
    loud = sum((F.abs(v) >= FULL_SCALE_G * 0.99).cast("double") for v in vec)
    gmiss = any_nan(GYRO)
    gyro = [F.when(F.col("has_gyro") & ~gmiss, F.col(c)) for c in GYRO]
    flat_sum, flat_sq = sum(gyro), sum(g * g for g in gyro)
    per = rows.groupBy(*NODE_KEY).agg(
        F.first("start").alias("start"),
        F.first("end").alias("end"),
        F.count(F.lit(1)).alias("n_frames"),
        F.sum(F.col("miss").cast("long")).alias("n_missing"),
        F.max("miss_run").cast("long").alias("nan_run_max"),
        F.max_by("miss", "idx").alias("nan_terminal"),
        (F.max("idx") - F.coalesce(F.max(F.when(valid, F.col("idx"))), F.lit(0))).cast("long").alias("nan_trailing_run"),
        F.sum(F.col("fresh").cast("long")).alias("unique_values"),
        F.coalesce(F.max("repeat_run"), F.lit(0)).cast("long").alias("max_repeat_run"),
        F.sum(F.col("dupe").cast("long")).alias("n_dupes"),
        F.coalesce(F.min(F.col("dt") > 0), F.lit(True)).alias("timestamp_monotonic"),
        F.avg("dt").alias("dt_mean"),
        F.stddev_pop("dt").alias("dt_sd"),
        F.min("t").alias("first_t"),
        *[F.var_pop(v).alias(f"var_{a}") for v, a in zip(vec, "xyz", strict=True)],
        *[F.avg(v).alias(f"mean_{a}") for v, a in zip(vec, "xyz", strict=True)],
        F.avg(mag).alias("mag_mean"),
        F.stddev_pop(mag).alias("mag_sd"),
        F.avg(loud / 3.0).alias("loud"),
        F.first("has_gyro").alias("gyro_available"),
        F.avg(F.when(F.col("has_gyro"), gmiss.cast("double"))).alias("gyro_nan_fraction"),
        F.avg((F.abs(gyro[0]) + F.abs(gyro[1]) + F.abs(gyro[2])) / 3.0).alias("gyro_abs"),
        F.sum(flat_sum).alias("gyro_sum"),
        F.sum(flat_sq).alias("gyro_sq"),
        F.count(gyro[0]).alias("gyro_n"),
    )
    n_valid = F.col("n_frames") - F.col("n_missing")
    many = n_valid > 1
    duration = (F.col("end") - F.col("start")) / per_second
    length = norm(F.col("mean_x"), F.col("mean_y"), F.col("mean_z"))
    expected = F.bround(F.lit(float(rate_hz)) * duration, 0).cast("long") if rate_hz else F.col("n_frames")
    has = F.col("gyro_available")
    g_mean = F.try_divide(F.col("gyro_sum"), 3.0 * F.col("gyro_n"))
    return per.select(
        *NODE_KEY,
        "start",
        "end",
        "first_t",
        "n_frames",
        "n_missing",
        n_valid.alias("n_valid"),
        (F.col("n_missing") / F.col("n_frames")).alias("nan_fraction"),
        "nan_run_max",
        "nan_terminal",
        "nan_trailing_run",
        expected.alias("frames_expected"),
        share(n_valid, expected).alias("frame_completeness"),
        "unique_values",
        share(F.col("unique_values"), n_valid).alias("unique_value_ratio"),
        "max_repeat_run",
        (F.col("n_dupes") / F.greatest(F.lit(1), n_valid - 1)).alias("repeat_fraction"),
        F.when(duration > 0, F.col("unique_values") / duration).otherwise(0.0).alias("effective_unique_rate_hz"),
        "timestamp_monotonic",
        F.when(F.col("dt_mean") > 0, F.col("dt_sd") / F.col("dt_mean")).otherwise(0.0).alias("inter_sample_interval_cv"),
        *[F.when(many, F.col(f"var_{a}")).otherwise(0.0).alias(f"var_{a}") for a in "xyz"],
        F.when(many, F.col("var_x") + F.col("var_y") + F.col("var_z")).otherwise(0.0).alias("total_variance"),
        F.when(many, F.col("mag_mean")).otherwise(0.0).alias("mean_accel_magnitude_g"),
        F.when(many, F.col("mag_mean").between(*PLAUSIBLE_G)).otherwise(False).alias("magnitude_plausible"),
        F.when(many, F.col("loud")).otherwise(0.0).alias("saturation_frac"),
        *[F.when(length > 1e-9, F.col(f"mean_{a}") / length).alias(f"gravity_{a}") for a in "xyz"],
        F.coalesce(length, F.lit(0.0)).alias("gravity_magnitude_g"),
        F.coalesce(1.0 / (1.0 + F.col("mag_sd")), F.lit(0.0)).alias("gravity_stability"),
        "gyro_available",
        F.when(has, F.col("gyro_nan_fraction")).alias("gyro_nan_fraction"),
        F.when(has, F.coalesce("gyro_abs", F.lit(0.0))).alias("gyro_mean_abs_dps"),
        F.when(has, F.when(F.col("gyro_n") > 1, F.col("gyro_sq") / (3.0 * F.col("gyro_n")) - g_mean * g_mean).otherwise(0.0)).alias("gyro_variance"),
    )


def with_offset(signals: DataFrame, per_second: float = 1.0) -> DataFrame:
    """``cross_node_offset_ms``: the node's first time against the median of all nodes'; NULL with one node."""
    w = Window.partitionBy(*WINDOW_KEY)
    off = (F.col("first_t") - F.median("first_t").over(w)) * (1000.0 / per_second)
    return signals.withColumn("cross_node_offset_ms", F.when(F.count(F.lit(1)).over(w) >= 2, off))


def sub_scores() -> dict[str, Column]:
    """Each in [0, 1]; synchrony is NULL where there is no offset to judge."""
    cv, sat, many = F.col("inter_sample_interval_cv"), F.col("saturation_frac"), F.col("n_valid") > 1
    one = F.lit(1.0)
    sanity = F.least(
        F.when(~F.col("magnitude_plausible"), 0.3).otherwise(one),
        F.when(sat > 0.05, clip(1.0 - sat, 0.0, 1.0)).otherwise(one),
        F.when(many & (F.col("total_variance") < 1e-9), 0.1).otherwise(one),
    )
    late = F.greatest(F.lit(0.0), F.abs("cross_node_offset_ms") - SYNC_TOLERANCE_MS)
    return {
        "completeness": clip(1.0 - F.col("nan_fraction"), 0.0, 1.0),
        "staleness": F.when(many, clip(1.0 - F.col("repeat_fraction"), 0.0, 1.0)).otherwise(one),
        "temporal": F.when(~F.col("timestamp_monotonic"), 0.0).when(cv > 0.5, clip(1.5 - cv, 0.0, 1.0)).otherwise(one),
        "sanity": sanity,
        "synchrony": F.when(F.col("cross_node_offset_ms").isNotNull(), clip(1.0 - late / SYNC_SCALE_MS, 0.0, 1.0)),
    }


def window_signals(frames: DataFrame, per_second: float = 1.0, rate_hz: float | None = None) -> DataFrame:
    """All signals, offset and sub-scores of every node of every window."""
    return with_offset(node_signals(frames, per_second, rate_hz), per_second).withColumns(sub_scores())


def with_silent_nodes(signals: DataFrame, expected: DataFrame) -> DataFrame:
    """``signals`` and, for nodes of ``expected`` (NODE_KEY) that sent nothing, a row with completeness 0 and no other sub-score."""
    rows = expected.join(signals, list(NODE_KEY), "left")
    silent = F.col("n_frames").isNull()
    zero = {"completeness": F.when(silent, 0.0).otherwise(F.col("completeness")), "n_frames": F.coalesce("n_frames", F.lit(0).cast("long"))}
    return rows.withColumns(zero)
