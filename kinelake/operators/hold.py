"""Sample and hold by pointer jumping.

A sample is taken over if a period has passed since the last one that was: whether it is
depends on all before. But which sample *would* follow a taken one does not: it is the
first that comes a period later. So every sample points to its follower, and those taken
are the ones that the pointers reach from a window's first sample. Followers are found by
merging samples and the times that are asked for, in buckets of time; pointers are followed
by doubling, inside chunks of CHUNK samples first, then over the chunks of the windows that
have several. No task has more of a window than one bucket or chunk at a time, and no step is
taken sample by sample, in Python or elsewhere.

Clocks may be irregular, repeat or step back: a sample that follows a taken one is later
than all before it, so the running maximum of the times finds it. ``idx`` counts a node's
samples from 1 without gaps, as ``segment.frames`` gives it; times are numbers from 0 on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.samples import ACCEL, GYRO
from ..tables import written
from . import NODE_KEY

CHUNK = 1024
_KEY = list(NODE_KEY)
_ALL = Window.unboundedPreceding


def due_after(t: Column, least: float | Column) -> Column:
    """The least number v with v - t >= ``least`` as doubles subtract (a sum alone may be off by a last bit)."""
    least = least if isinstance(least, Column) else F.lit(least)
    step = F.lit(1.6e-16)
    total = t + least
    below = total - F.abs(total) * step
    further = below - F.abs(below) * step
    above = total + F.abs(total) * step
    fits = lambda v: v - t >= least
    return F.when(fits(further), further).when(fits(below), below).when(fits(total), total).otherwise(above)


def _of_chunk(idx: Column) -> Column:
    return F.floor((idx - 1) / CHUNK)


def followers(times: DataFrame) -> DataFrame:
    """NODE_KEY, idx, next: the first later sample a ``period`` after it; NULL without one."""
    chunked = times.withColumn("chunk", _of_chunk(F.col("idx")))
    tops = chunked.groupBy(*_KEY, "chunk").agg(F.max("t").alias("top"))
    tops = tops.select(*_KEY, "chunk", F.max("top").over(Window.partitionBy(*_KEY).orderBy("chunk").rowsBetween(_ALL, -1)).alias("before"))  # a row a chunk
    inside = Window.partitionBy(*_KEY, "chunk").orderBy("idx").rowsBetween(_ALL, 0)
    high = chunked.withColumn("high", F.max("t").over(inside)).join(tops, [*_KEY, "chunk"]).withColumn("high", F.greatest("high", "before"))
    sample = F.struct(F.col("high").alias("at"), F.col("idx").alias("sample"), F.lit(None).cast("int").alias("asks"))
    asked = F.struct(due_after(F.col("t"), F.col("period") - 1e-12).alias("at"), F.lit(None).cast("int").alias("sample"), F.col("idx").alias("asks"))
    points = high.select(*_KEY, "period", F.explode(F.array(sample, asked)).alias("p")).select(*_KEY, "period", "p.*")
    points = points.withColumn("bucket", F.floor(F.col("at") / (F.col("period") * CHUNK)))
    # From late to early, a time that is asked for after the samples of that time, the first of those last.
    order = [F.desc("at"), F.col("asks").isNotNull(), F.desc("sample")]
    own = F.last("sample", ignorenulls=True).over(Window.partitionBy(*_KEY, "bucket").orderBy(*order).rowsBetween(_ALL, 0))
    firsts = points.groupBy(*_KEY, "bucket").agg(F.min("sample").alias("first"))
    firsts = firsts.select(*_KEY, "bucket", F.last("first", ignorenulls=True).over(Window.partitionBy(*_KEY).orderBy(F.desc("bucket")).rowsBetween(_ALL, -1)).alias("later"))  # a row a bucket
    found = points.withColumn("own", own).where(F.col("asks").isNotNull()).join(firsts, [*_KEY, "bucket"])
    return found.select(*_KEY, F.col("asks").alias("idx"), F.coalesce("own", "later").alias("next"))


def _doublings(n: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(n)).cast("int")))


def _chunks(pointers: DataFrame) -> DataFrame:
    """One row a chunk: its first idx, ``jump`` (the place in the chunk that each place points to, 0 for none) and ``leave``
    (the sample outside that following pointers leads to from each place)."""
    rows = pointers.groupBy(*_KEY, _of_chunk(F.col("idx")).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("idx", "next"))).alias("s"))
    rows = rows.withColumn("first", F.element_at("s", 1)["idx"]).withColumn("n", F.size("s"))
    to = lambda x: x["next"] - F.col("first") + 1
    rows = rows.withColumn("jump", F.transform("s", lambda x: F.when(to(x) <= F.col("n"), to(x)).otherwise(0)))
    ends = F.aggregate(_doublings(F.col("n")), F.transform("jump", lambda j, i: F.when(j > 0, j).otherwise(i + 1)), lambda at, _: F.transform(at, lambda p: F.get(at, p - 1)))
    return rows.withColumn("ends", ends).select(*_KEY, "chunk", "first", "n", "jump", F.transform("ends", lambda p: F.element_at("s", p)["next"]).alias("leave"))


def _entries(chunks: DataFrame, last: int) -> DataFrame:
    """NODE_KEY, chunk, entry: the first taken sample of each chunk of the windows with several; pointers between chunks double each round."""
    several = chunks.join(chunks.where("chunk = 1").select(*_KEY), _KEY, "left_semi")
    pointers = several.select(*_KEY, "first", F.posexplode("leave").alias("at", "to")).where("to is not null").select(*_KEY, (F.col("first") + F.col("at")).alias("idx"), "to")
    reached = several.where("chunk = 0").select(*_KEY, F.lit(1).alias("idx"))
    for i in range(math.ceil(math.log2(last + 1))):
        pointers, reached = (written(x, f"hold-{name}-{i}") for name, x in (("pointers", pointers), ("reached", reached)))
        reached = reached.unionByName(reached.join(pointers, [*_KEY, "idx"]).select(*_KEY, F.col("to").alias("idx")))
        onward = pointers.select(*_KEY, F.col("idx").alias("to"), F.col("to").alias("further"))
        pointers = pointers.join(onward, [*_KEY, "to"]).select(*_KEY, "idx", F.col("further").alias("to"))
    return reached.select(*_KEY, _of_chunk(F.col("idx")).alias("chunk"), F.col("idx").alias("entry"))


def sources(times: DataFrame, period: float | Column) -> DataFrame:
    """NODE_KEY, idx, source: the sample whose value each sample shows; ``times`` has NODE_KEY, idx and t. ``period`` is one for all, or a column that is the same in all of a window."""
    slim = times.select(*_KEY, F.col("idx").cast("int").alias("idx"), "t", (period if isinstance(period, Column) else F.lit(period)).alias("period"))
    chunks = written(_chunks(followers(written(slim, "hold-times"))), "hold-chunks")
    last = chunks.agg(F.max("chunk")).first()[0] or 0
    if last:
        chunks = chunks.join(_entries(chunks, int(last)), [*_KEY, "chunk"], "left")
    else:
        chunks = chunks.withColumn("entry", F.lit(None).cast("int"))
    # Of a window in one chunk the first sample is taken; a chunk that nothing points into has none.
    place = F.coalesce(F.col("entry") - F.col("first") + 1, F.when(F.col("chunk") == 0, 1))
    begin = F.struct(F.array(place.cast("int")).alias("taken"), F.col("jump").alias("jump"))
    step = lambda acc, _: F.struct(
        F.filter(F.concat(acc["taken"], F.transform(acc["taken"], lambda p: F.get(acc["jump"], p - 1))), lambda p: p > 0).alias("taken"),
        F.transform(acc["jump"], lambda j: F.when(j > 0, F.get(acc["jump"], j - 1)).otherwise(0)).alias("jump"),
    )
    taken = F.when(place.isNotNull(), F.aggregate(_doublings(F.col("n") + 1), begin, step)["taken"]).otherwise(F.array().cast("array<int>"))
    rows = chunks.select(*_KEY, "chunk", "first", "n", taken.alias("taken")).withColumn("own", F.when(F.size("taken") > 0, F.col("first") + F.element_at("taken", -1) - 1))
    rows = rows.withColumn("before", F.last("own", ignorenulls=True).over(Window.partitionBy(*_KEY).orderBy("chunk").rowsBetween(_ALL, -1)))  # a row a chunk
    until = F.concat(F.slice("taken", 2, F.greatest(F.lit(0), F.size("taken") - 1)), F.array(F.col("n") + 1))
    stretches = F.flatten(F.zip_with("taken", F.when(F.size("taken") > 0, until).otherwise(F.col("taken")), lambda a, b: F.array_repeat(F.col("first") + a - 1, b - a)))
    early = F.when(F.size("taken") > 0, F.element_at(F.concat("taken", F.array(F.lit(0))), 1) - 1).otherwise(F.col("n"))
    shown = F.concat(F.array_repeat(F.col("before"), early.cast("int")), stretches)
    return rows.select(*_KEY, "first", F.posexplode(shown).alias("at", "source")).select(*_KEY, (F.col("first") + F.col("at")).alias("idx"), "source")


def hold(frames: DataFrame, period: float | Column) -> DataFrame:
    """``frames`` with held_ax ... held_gz and ``fresh`` (the sample was taken over)."""
    rows = frames.join(sources(frames, period), [*_KEY, "idx"])
    # Samples that show one source are those of a period.
    shown = F.max(F.when(F.col("idx") == F.col("source"), F.struct(*ACCEL, *GYRO))).over(Window.partitionBy(*_KEY, "source"))
    rows = rows.withColumn("taken", shown).withColumn("fresh", F.col("idx") == F.col("source"))
    return rows.select(*frames.columns, *[F.col(f"taken.{c}").alias(f"held_{c}") for c in (*ACCEL, *GYRO)], "fresh")
