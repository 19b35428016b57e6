"""Causal rolling baselines: a direction against the mean of those just before it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import MOUNT_AXIS, angle, norm, share
from ..tables import written
from .diagnose import detection_threshold
from .sampling import numbered

CLEAN_PREFIX, HORIZONS = 25, (1, 2, 5)


def with_halo(rows: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` dealt by ranges (``of_range``) of (keys, order), and before each range, marked ``halo``, copies of the ``n`` rows of
    the same key that come before it: from as many earlier ranges as it takes, where some are short.

    A window function over ``keys`` and ``of_range`` that looks back at most ``n`` rows gives for the rows that
    are no halo what one over ``keys`` gives; no key is sorted in one task. ``order`` must be total.
    """
    dealt = written(rows.repartitionByRange(*keys, *order).withColumn("of_range", F.spark_partition_id()), "ranges")
    late = F.row_number().over(Window.partitionBy(*keys, "of_range").orderBy(*[F.desc(o) for o in order]))
    row = F.struct(*order, *[c for c in rows.columns if c not in (*keys, *order)])
    tails = dealt.withColumn("late", late).where(F.col("late") <= n).groupBy(*keys, "of_range").agg(F.sort_array(F.collect_list(F.struct((-F.col("late")).alias("place"), row.alias("row")))).alias("tail"))
    # Each range that is there has a row at least, so n of them have n rows.
    before = F.flatten(F.collect_list("tail").over(Window.partitionBy(*keys).orderBy("of_range").rowsBetween(-n, -1)))
    halo = tails.withColumn("before", before).select(*keys, "of_range", F.explode(F.slice("before", F.greatest(F.lit(1), F.size("before") - n + 1), n)).alias("b"))
    copies = halo.select(*keys, "of_range", "b.row.*").withColumn("halo", F.lit(True))
    return dealt.withColumn("halo", F.lit(False)).unionByName(copies)


def rolling_delta(rows: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], vector: Sequence[str] = ("gx", "gy", "gz"), out: str = "delta_deg") -> DataFrame:
    """``rows`` with the angle to the mean of the ``n`` non-null vectors before; NULL until there are ``n``, and for a null vector.

    Vectors that are null are set aside first, so that they neither fill nor age the baseline.
    """
    there = F.col(vector[0]).isNotNull()
    w = Window.partitionBy(*keys, "of_range").orderBy(*order).rowsBetween(-n, -1)
    means = [F.avg(c).over(w) for c in vector]
    held = with_halo(rows.where(there), n, keys, order)
    length = norm(*means)
    delta = F.when((F.count(vector[0]).over(w) == n) & (length > 1e-9), angle([F.col(c) for c in vector], means))
    based = held.withColumn(out, delta).where(~F.col("halo")).drop("halo", "of_range")
    return based.unionByName(rows.where(~there).withColumn(out, F.lit(None).cast("double")))


def over_threshold(rows: DataFrame, spread: Column, node: Column | None = None, vector: Sequence[str] = ("gx", "gy", "gz"), delta: str = "delta_deg") -> DataFrame:
    """``rows`` with ``hit``: the delta exceeds the monitor's threshold with the temporal spread; NULL without a delta."""
    threshold, _, _ = detection_threshold(node if node is not None else F.col("node"), tuple(F.col(c) for c in vector), spread)
    return rows.withColumn("hit", F.when(F.col(delta).isNotNull(), F.col(delta) > threshold))


def false_positive_rate(rows: DataFrame, *keys: str) -> DataFrame:
    """n, fp and rate of hits on clean rows."""
    per = rows.groupBy(*keys).agg(F.count("hit").alias("n"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("fp"))
    return per.withColumn("rate", share(F.col("fp"), F.col("n")))


def with_onset(rows: DataFrame, keys: Sequence[str], order: Sequence[str], node: str, theta_deg: float, prefix: int = CLEAN_PREFIX, vector: Sequence[str] = ("gx", "gy", "gz")) -> DataFrame:
    """``rows`` with ``pos`` (from 0) in which every vector from ``prefix`` on is turned about the node's axis.

    Turning the mean is the same as the mean of turned samples, so no sample is touched.
    """
    axis = MOUNT_AXIS.get(node, 0)
    i, j = [(1, 2), (2, 0), (0, 1)][axis]
    c, s = math.cos(math.radians(theta_deg)), math.sin(math.radians(theta_deg))
    late = F.col("pos") >= prefix
    a, b = F.col(vector[i]), F.col(vector[j])
    placed = numbered(rows, keys, order, at="pos", of="of_stream").drop("of_stream")
    return placed.withColumns({vector[i]: F.when(late, a * c - b * s).otherwise(a), vector[j]: F.when(late, a * s + b * c).otherwise(b)})


def recall_at(rows: DataFrame, keys: Sequence[str], n: int, prefix: int = CLEAN_PREFIX, horizons: Sequence[int] = HORIZONS, delta: str = "delta_deg") -> DataFrame:
    """From the onset on: recall within each horizon and pooled, and the mean delta at first and once the baseline has caught up."""
    at = F.col("pos") - prefix
    hit = F.col("hit").cast("double")
    after = rows.where(at >= 0)
    return after.groupBy(*keys).agg(
        *[F.coalesce(F.avg(F.when(at < k, hit)), F.lit(0.0)).alias(f"recall_at_{k}") for k in horizons],
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("pooled_recall"),
        F.count("hit").alias("n_pooled"),
        F.avg(F.when(at < 2, F.col(delta))).alias("mean_delta_first"),
        F.avg(F.when(at >= n + 2, F.col(delta))).alias("mean_delta_sustained"),
    )
