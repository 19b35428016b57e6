"""Reference directions of gravity from clean held-out windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import ACCEL, angle, any_nan, norm
from ..tables import written
from . import WINDOW_KEY
from .blind import require_blind


def window_means(frames: DataFrame) -> DataFrame:
    """WINDOW_KEY, node, start and the mean vector of the valid samples, where there are any."""
    rows = require_blind(frames, "window_means").where(~any_nan())
    return rows.groupBy(*WINDOW_KEY, "node").agg(F.first("start").alias("start"), *[F.avg(c).alias(m) for c, m in zip(ACCEL, ("mx", "my", "mz"), strict=True)])


def first_windows(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` windows of each group in stream order."""
    w = Window.partitionBy(*keys).orderBy("subject", "seg", "win")
    return rows.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= n).drop("rank")


def means_of_signals(signals: DataFrame) -> DataFrame:
    """``window_means`` from signals that are there already: direction times length."""
    there = signals.where("n_valid > 0")
    return there.select(*WINDOW_KEY, "node", "start", *[(F.coalesce(f"gravity_{a}", F.lit(0.0)) * F.col("gravity_magnitude_g")).alias(m) for a, m in zip("xyz", ("mx", "my", "mz"), strict=True)])


def calibrate(frames: DataFrame, max_windows: int | None = 60) -> DataFrame:
    """(dataset, node): unit reference, and mean, 95th percentile (exact) and maximum of the angles against it."""
    return calibrate_means(written(window_means(frames), "window-means"), max_windows)  # a row a window and node, read twice


def calibrate_means(means: DataFrame, max_windows: int | None = 60) -> DataFrame:
    """As ``calibrate``, from the mean vectors of windows, a stored table or one that is cheap to read twice."""
    if max_windows is not None:
        means = first_windows(means, max_windows, "dataset")
    centre = means.groupBy("dataset", "node").agg(*[F.avg(m).alias(c) for m, c in zip(("mx", "my", "mz"), ("cx", "cy", "cz"), strict=True)])
    length = norm(*[F.col(c) for c in ("cx", "cy", "cz")])
    ref = centre.where(length > 1e-9).select("dataset", "node", *[(F.col(c) / length).alias(r) for c, r in zip(("cx", "cy", "cz"), ("ref_x", "ref_y", "ref_z"), strict=True)])
    own = [F.col(m) for m in ("mx", "my", "mz")]
    turned = means.where(norm(*own) > 1e-9).join(F.broadcast(ref), ["dataset", "node"]).withColumn("angle", angle(own, [F.col(r) for r in ("ref_x", "ref_y", "ref_z")]))
    turned = turned.select("dataset", "node", "angle")
    spread = turned.groupBy("dataset", "node").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("angle").alias("mean_angle"), F.max("angle").alias("max_angle"))
    spread = spread.join(percentile_of(turned, ("dataset", "node"), "angle", 0.95).withColumnRenamed("percentile", "p95"), ["dataset", "node"], "left")
    return ref.join(spread, ["dataset", "node"], "left").select("dataset", "node", "ref_x", "ref_y", "ref_z", "n_windows", "mean_angle", "p95", "max_angle")


def percentile_of(rows: DataFrame, keys: tuple[str, ...], value: str, share: float, buckets_per_unit: int = 100) -> DataFrame:
    """keys and ``percentile``: the exact one, by linear interpolation, of a value without nulls.

    No group is gathered: values are counted in buckets, the two wanted ranks are found among
    a group's buckets, and only the values of those are counted one by one. ``rows`` is read twice.
    """
    bucket = F.floor(F.col(value) * buckets_per_unit)
    counts = rows.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("bucket")
    place = (F.sum("n").over(Window.partitionBy(*keys)) - 1) * F.lit(float(share))
    counts = counts.withColumns({"below": F.sum("n").over(order) - F.col("n"), "place": place})
    wanted = counts.where((F.col("below") <= F.ceil("place")) & (F.floor("place") < F.col("below") + F.col("n")))  # two buckets a group at most
    values = rows.withColumn("bucket", bucket).join(F.broadcast(wanted), [*keys, "bucket"]).groupBy(*keys, "bucket", value).agg(F.count(F.lit(1)).alias("n_here"), F.first("below").alias("below"), F.first("place").alias("place"))
    upto = F.sum("n_here").over(Window.partitionBy(*keys, "bucket").orderBy(value)) + F.col("below")
    values = values.withColumn("upto", upto)

    def at(rank) -> Column:
        return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n_here")), F.col(value)))

    both = values.groupBy(*keys).agg(at(F.floor("place")).alias("low"), at(F.ceil("place")).alias("high"), F.first("place").alias("place"))
    between = (F.ceil("place") - F.col("place")) * F.col("low") + (F.col("place") - F.floor("place")) * F.col("high")
    return both.select(*keys, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("percentile"))


def references(calibration: DataFrame) -> DataFrame:
    """The columns that ``diagnose`` takes."""
    return calibration.select("dataset", "node", "ref_x", "ref_y", "ref_z", "p95")
