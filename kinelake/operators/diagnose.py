"""From signals to a diagnosis, a state and a trust weight, by one ladder of rules.

``references``: (dataset, node, ref_x, ref_y, ref_z, p95) from ``calibrate``; a
node without a row, or with a null p95, is judged without it. Only observations
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.samples import along_axis, angle, clip, norm, observable_angle
from . import NODE_KEY, WINDOW_KEY
from .signals import SUB_SCORES

# The ladder's thresholds, the states' bounds and trust weights.
NAN_PRESENT, TRAILING, UNIQUE_RATIO, REPEAT_RUN, REPEAT_FRACTION = 0.02, 0.10, 0.75, 3, 0.20
OFFSET_MS = 25.0
ANGLE_FLOOR_DEG, ANGLE_FRACTION, SMALLEST_TURN_DEG = 4.0, 0.5, 15.0
STATE_BOUNDS = ((0.9, "HEALTHY"), (0.6, "DEGRADED"), (0.2, "UNRELIABLE"))
TRUST = {"HEALTHY": 1.0, "DEGRADED": 0.6, "UNRELIABLE": 0.25, "OFFLINE": 0.0}
DIAGNOSES = ("healthy", "dropout", "packet_loss", "rate_degradation", "clock_desync", "displacement")


def state_of(score: Column) -> Column:
    out = F.lit("OFFLINE")
    for bound, name in reversed(STATE_BOUNDS):
        out = F.when(score > bound, name).otherwise(out)
    return out


def trust_of(state: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, weight in TRUST.items():
        out = F.when(state == name, weight).otherwise(out)
    return out


def own_threshold(phi: Column) -> Column:
    """Half of what the smallest turn would show at ``phi``, never under the floor."""
    return F.greatest(F.lit(ANGLE_FLOOR_DEG), ANGLE_FRACTION * observable_angle(SMALLEST_TURN_DEG, phi))


def detection_threshold(node: Column, gravity: tuple[Column, ...], spread: Column) -> tuple[Column, Column, Column]:
    """(threshold in degrees, alignment, phi): half of what the smallest turn would show here, never under the floor or the natural spread."""
    alignment = F.abs(along_axis(node, gravity) / norm(*gravity))
    phi = F.degrees(F.acos(clip(alignment, -1.0, 1.0)))
    return F.greatest(own_threshold(phi), F.coalesce(spread, F.lit(0.0))), alignment, phi


def with_displacement(signals: DataFrame, references: DataFrame) -> DataFrame:
    """Angle against the calibrated direction, its threshold, and whether it was exceeded (NULL where there is nothing to compare)."""
    rows = signals.join(F.broadcast(references), ["dataset", "node"], "left")  # a row a node placement
    g = tuple(F.col(f"gravity_{a}") for a in "xyz")
    ref = tuple(F.col(f"ref_{a}") for a in "xyz")
    there = g[0].isNotNull() & ref[0].isNotNull()
    # In steps, each over columns of the one before: written out, the threshold repeats the alignment hundreds of times.
    rows = rows.withColumns({"turned": angle(g, ref), "alignment": F.abs(along_axis(F.col("node"), g) / norm(*g))})
    rows = rows.withColumn("phi", F.degrees(F.acos(clip(F.col("alignment"), -1.0, 1.0))))
    rows = rows.withColumn("bare", own_threshold(F.col("phi")))
    rows = rows.withColumn("threshold", F.greatest("bare", F.coalesce("p95", F.lit(0.0))))
    alignment = F.col("alignment")
    return rows.withColumns(
        {
            "angle_deg": F.when(there, F.col("turned")),
            "estimated_alignment": F.when(there, alignment),
            "estimated_phi_deg": F.when(there, F.col("phi")),
            "threshold_deg": F.when(there, F.col("threshold")),
            "swamped": F.when(there, F.coalesce(F.col("p95") > F.col("bare"), F.lit(False))),
            "exceeded": F.when(there, F.col("turned") > F.col("threshold")),
            "observability": F.when(there, F.when(alignment > 0.9, "low").when(alignment > 0.6, "medium").otherwise("high")),
            "no_reference_reason": F.when(~there, F.when(g[0].isNull(), "no valid samples").otherwise("no reference for this dataset and node")),
        }
    ).drop("ref_x", "ref_y", "ref_z", "p95", "turned", "alignment", "phi", "bare", "threshold")


def aggregated(scores: list[Column]) -> tuple[Column, Column]:
    """(least, geometric mean) of the sub-scores that exist."""
    there = F.filter(F.array(*scores), lambda v: v.isNotNull())
    logs = F.aggregate(there, F.lit(0.0), lambda acc, v: acc + F.log(F.greatest(v, F.lit(1e-9))))
    return F.coalesce(F.array_min(there), F.lit(1.0)), F.coalesce(F.exp(F.try_divide(logs, F.size(there))), F.lit(1.0))


def ladder() -> tuple[Column, Column]:
    """(diagnosis, rule): the first rule that holds."""
    gone = F.col("nan_fraction") > NAN_PRESENT
    trailing = F.col("nan_trailing_run") / F.col("n_frames")
    stale = (F.col("repeat_fraction") >= REPEAT_FRACTION) | ((F.col("unique_value_ratio") < UNIQUE_RATIO) & (F.col("max_repeat_run") >= REPEAT_RUN))
    rules = (
        (gone & F.col("nan_terminal") & (trailing > TRAILING), "dropout", "samples are missing up to the end of the window"),
        (gone, "packet_loss", "samples are missing, but not up to the end"),
        (stale, "rate_degradation", "no sample is missing, successive ones repeat"),
        (F.abs("cross_node_offset_ms") > OFFSET_MS, "clock_desync", "values are whole, times are out of step with the other nodes"),
        (F.col("exceeded"), "displacement", "gravity lies beyond the threshold for its alignment"),
    )
    dx, rule = F.lit("healthy"), F.lit("no rule holds")
    for holds, name, why in reversed(rules):
        holds = F.coalesce(holds, F.lit(False))
        dx, rule = F.when(holds, name).otherwise(dx), F.when(holds, why).otherwise(rule)
    return dx, rule


_NUMBERS = ("nan_fraction", "nan_trailing_run", "nan_run_max", "repeat_fraction", "unique_value_ratio", "max_repeat_run", "effective_unique_rate_hz", "cross_node_offset_ms", "angle_deg", "threshold_deg", "estimated_alignment")
EVIDENCE = {
    "dropout": ("nan_fraction", "nan_trailing_run"),
    "packet_loss": ("nan_fraction", "nan_run_max", "nan_trailing_run"),
    "rate_degradation": ("nan_fraction", "repeat_fraction", "unique_value_ratio", "max_repeat_run", "effective_unique_rate_hz"),
    "clock_desync": ("cross_node_offset_ms",),
    "displacement": ("angle_deg", "threshold_deg", "estimated_alignment"),
    "healthy": ("nan_fraction", "repeat_fraction", "unique_value_ratio", "cross_node_offset_ms", "angle_deg"),
}


def evidence(dx: Column) -> Column:
    """The numbers that the rule looked at, as a map."""
    every = F.map_from_arrays(F.array(*[F.lit(n) for n in _NUMBERS]), F.array(*[F.col(n).cast("double") for n in _NUMBERS]))
    wanted = F.array().cast("array<string>")
    for name, keys in EVIDENCE.items():
        wanted = F.when(dx == name, F.array(*[F.lit(k) for k in keys])).otherwise(wanted)
    return F.map_filter(every, lambda k, v: F.array_contains(wanted, k) & v.isNotNull())


def diagnose(signals: DataFrame, references: DataFrame) -> DataFrame:
    """Verdicts: ``signals`` with displacement, placement, min and geometric mean, state, trust_weight, diagnosis, rule, evidence."""
    rows = with_displacement(signals, references)
    rows = rows.withColumn("placement", F.when(F.col("exceeded").isNotNull(), F.when(F.col("exceeded"), 0.0).otherwise(1.0)))
    least, geometric = aggregated([F.col(s) for s in (*SUB_SCORES, "placement")])
    rows = rows.withColumns({"min_sub_score": least, "geometric_mean_sub_score": geometric})
    dx, rule = ladder()
    rows = rows.withColumns({"state": state_of(F.col("min_sub_score")), "diagnosis": dx, "rule": rule})
    return rows.withColumns({"trust_weight": trust_of(F.col("state")), "evidence": evidence(F.col("diagnosis")), "flagged": F.col("state") != "HEALTHY"})


def network_state(verdicts: DataFrame) -> DataFrame:
    """One row a window: flagged nodes (sorted), the worst score and the state that it means."""
    per = verdicts.groupBy(*WINDOW_KEY).agg(
        F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col("node")))).alias("flagged_nodes"),
        F.min("min_sub_score").alias("worst_min"),
        F.count(F.lit(1)).alias("n_nodes"),
    )
    return per.withColumn("network_state", state_of(F.col("worst_min")))


def no_references(signals: DataFrame) -> DataFrame:
    """An empty table of references."""
    return signals.sparkSession.createDataFrame([], "dataset string, node string, ref_x double, ref_y double, ref_z double, p95 double")


VERDICT_KEY = NODE_KEY
