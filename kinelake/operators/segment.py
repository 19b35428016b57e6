"""Segments (gaps and islands) and segment-anchored sliding windows.

Time is a double in any unit (seconds for sensors, microseconds for event
streams); all lengths are given in that unit.

A subject's stream is never sorted in one task: samples are dealt by (stream,
time bucket), breaks are found inside buckets, and one small row a bucket carries
the last sample and the number of breaks on to the next, so that a stream with a
third of all samples costs as many tasks as it has buckets.

A task holds what it sorts. How much that is depends on the number of partitions, which
``parts`` fixes where the caller knows how many samples there are; without it, it is Spark's choice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import half_even
from . import WINDOW_KEY

STREAM = ("dataset", "subject")


def breaks_before(prev_t: Column, prev_activity: Column, t: Column, activity: Column, gap: float, by_activity: bool) -> Column:
    """A new segment begins after a gap longer than ``gap``, and where the activity changes."""
    apart = (t - prev_t) > gap
    return (apart | (activity != prev_activity)) if by_activity else apart


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``rows`` in ``parts`` partitions by ``keys``; as they are where ``parts`` is None.

    The dataset isn't hashed: where it is a constant, Spark leaves it out of the windows' keys, and would deal the rows again for those.
    """
    return rows if parts is None else rows.repartition(parts, *[k for k in keys if k != "dataset"])


def segments(samples: DataFrame, gap: float, bucket: float, keys: Sequence[str] = STREAM, by_activity: bool = True, parts: int | None = None) -> DataFrame:
    """``samples`` with ``seg``, counted from 1 in each stream. Ties in time are ordered by ``ord``.

    ``bucket`` is the span of time that one task sorts; it changes nothing in the result.
    """
    rows = dealt(samples.withColumn("bucket", F.floor(F.col("t") / bucket)), parts, *keys, "bucket")
    inside = Window.partitionBy(*keys, "bucket").orderBy("t", "ord")
    rows = rows.withColumn("brk", F.coalesce(breaks_before(F.lag("t").over(inside), F.lag("activity").over(inside), F.col("t"), F.col("activity"), gap, by_activity), F.lit(False)).cast("long"))
    edge = F.struct("t", "ord", "activity")
    per = rows.groupBy(*keys, "bucket").agg(F.min(edge).alias("head"), F.max(edge).alias("tail"), F.sum("brk").alias("inner"))
    order = Window.partitionBy(*keys).orderBy("bucket")
    tail = F.lag("tail").over(order)
    first = F.coalesce(breaks_before(tail["t"], tail["activity"], F.col("head.t"), F.col("head.activity"), gap, by_activity), F.lit(True)).cast("long")
    per = per.withColumn("first", first)
    total = F.sum(F.col("first") + F.col("inner")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    per = per.select(*keys, "bucket", (total - F.col("inner")).alias("base"))
    running = F.sum("brk").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).join(per, [*keys, "bucket"]).withColumn("seg", F.col("base") + F.col("running")).drop("bucket", "brk", "running", "base")


def segment_bounds(segmented: DataFrame, keys: Sequence[str] = STREAM) -> DataFrame:
    """One row a segment: first and last time, samples, activity."""
    return segmented.groupBy(*keys, "seg").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"), F.first("activity").alias("activity"))


#: Windows whose starts are listed at once; appending to a list copies it.
STARTS_AT_ONCE = 256


def window_starts(t0: Column, t1: Column, length: float, step: float, slack: float = 1e-9) -> Column:
    """Starts from ``t0`` on, each the one before plus ``step`` (added up, not multiplied out), while a window fits before ``t1``.

    A segment with few windows lists them and no more. In a longer one every STARTS_AT_ONCE-th
    start is found first, by adding alone; the starts in between are listed from each of those.
    """
    step_of = F.lit(float(step))
    fit = F.greatest(F.lit(0), F.floor((t1 - t0 - length) / step).cast("int")) + 2  # one more than fit, for the slack
    within = F.sequence(F.lit(2), F.least(F.lit(STARTS_AT_ONCE), fit))
    whole = F.sequence(F.lit(1), F.lit(STARTS_AT_ONCE))
    after = F.aggregate(F.sequence(F.lit(2), F.ceil(fit / STARTS_AT_ONCE).cast("int")), F.array(t0), lambda acc, _: F.array_append(acc, F.aggregate(whole, F.element_at(acc, -1), lambda s, _: s + step_of)))
    chunks = F.when(fit > STARTS_AT_ONCE, after).otherwise(F.array(t0))
    starts = F.flatten(F.transform(chunks, lambda first: F.aggregate(within, F.array(first), lambda acc, _: F.array_append(acc, F.element_at(acc, -1) + step_of))))
    return F.filter(starts, lambda s: s + length <= t1 + slack)


def sliding_windows(segmented: DataFrame, length: float, overlap: float = 0.5, keys: Sequence[str] = STREAM) -> DataFrame:
    """One row a window: keys, seg, win (from 0), start, end, label. Segments shorter than ``length`` have none."""
    step = length * (1.0 - overlap)
    bounds = segment_bounds(segmented, keys).where(F.col("t1") - F.col("t0") >= length)
    starts = bounds.select(*keys, "seg", F.col("activity").alias("label"), F.posexplode(window_starts(F.col("t0"), F.col("t1"), length, step)).alias("win", "start"))
    return starts.select(*keys, "seg", F.col("win").cast("long").alias("win"), "start", (F.col("start") + length).alias("end"), "label")


def least_samples(length_sec: float, rate_hz: float, coverage: float = 0.6) -> int:
    """Samples that a window needs, both roundings to even."""
    return half_even(half_even(length_sec * rate_hz) * coverage)


def frames(segmented: DataFrame, windows: DataFrame, cell: float, least: int = 1, keys: Sequence[str] = STREAM, unit: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """The samples of every window (start <= t < end), as ``frames`` rows, of windows with at least ``least`` samples.

    An equi-join on (stream, segment, time cell): a window is written once for each
    cell that it covers and each sample once, so nothing is compared across a segment.
    ``least`` counts samples, or distinct ``unit`` values where several rows are one sample.
    A window's samples are counted in the order that numbers them, so that they are sorted once.
    Signals that follow need no other partitions: ``parts`` bounds what their tasks sort as well.
    """
    covered = F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))).alias("cell")
    spread = windows.select(*keys, "seg", "win", "start", "end", "label", covered)
    samples = segmented.withColumn("cell", F.floor(F.col("t") / cell))
    joined = samples.join(spread, [*keys, "seg", "cell"]).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).drop("cell", "activity")
    window = WINDOW_KEY if keys == STREAM else (*keys, "seg", "win")
    joined = dealt(joined, parts, *window)
    in_window = Window.partitionBy(*window).orderBy("node", "t", "ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.size(F.collect_set(F.struct(*unit)).over(in_window)) if unit else F.count(F.lit(1)).over(in_window)
    joined = joined.withColumn("held", held).where(F.col("held") >= least).drop("held")
    place = Window.partitionBy(*keys, "seg", "win", "node").orderBy("t", "ord")
    return joined.withColumn("idx", F.row_number().over(place)).drop("ord")


def longest_run(rows: DataFrame, flag: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, run: the most successive rows for which ``flag`` holds; 0 without any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("flag", F.coalesce(flag, F.lit(False)))
    islands = marked.withColumn("island", F.sum((~F.col("flag")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*keys, "island").agg(F.sum(F.col("flag").cast("long")).alias("run"))
    return runs.groupBy(*keys).agg(F.max("run").alias("run"))
