"""Statistics of two-state loss chains of any length, at several levels at once.

A draw maps the chain's state: it flips it, sets it or keeps it. So does any piece of
a chain, and the maps of its pieces, in order, give what a walk along it gives.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .inject import transition_probabilities


def piece_maps(u: np.ndarray, starts: np.ndarray, loss: float, burst: float) -> dict[str, np.ndarray]:
    """Of each piece of the draws ``u``, for either state at its first draw: draws lost, bursts begun after the first, the last state."""
    p, r = transition_probabilities(loss, burst)
    head = np.zeros(len(u), bool)
    head[starts] = True
    flips = np.cumsum(~head & (u < min(p, r)))
    resets = ~head & (u >= min(p, r)) & (u < max(p, r))
    since = np.maximum.accumulate(np.where(head | resets, np.arange(len(u)), 0))
    turned, was_reset = (flips - flips[since]) % 2 == 1, resets[since]
    ends, out = np.append(starts[1:], len(u)) - 1, {}
    for state in (0, 1):
        lost = np.where(was_reset, p >= r, state == 1) ^ turned
        begins = lost & ~np.append(False, lost[:-1]) & ~head
        out |= {f"lost{state}": np.add.reduceat(lost, starts, dtype=np.int64), f"begins{state}": np.add.reduceat(begins, starts, dtype=np.int64), f"end{state}": lost[ends].astype(np.int32)}
    return out


def chain_stats(rows: DataFrame, levels: Sequence[tuple[float, float]], u: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """keys, level (from 1), loss, burst, and ``inject.burst_stats`` of ``inject.bursty_loss`` at each (loss, burst) of ``levels``.

    ``u`` is the array of a row's draws, in order. Rows are dealt by ranges of (keys, order) and sorted there, so that
    a batch holds whole pieces of chains; draws are made after that and are never shuffled or sorted. All levels are read
    off a batch, and its maps (a row a piece and level) are composed along each chain.
    """
    ship(rows.sparkSession)
    own, levels = [*keys, *order], [(float(loss), float(burst)) for loss, burst in levels]
    dealt = rows.repartitionByRange(*own).sortWithinPartitions(*own).select(*own, u.cast("array<double>").alias("ge_u"))
    kinds = ", ".join(f"`{c}` {dealt.schema[c].dataType.simpleString()}" for c in own)

    def task(batches):
        for batch in batches:
            sizes = np.nan_to_num(batch.column("ge_u").value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            batch, sizes = batch.filter(pa.array(sizes > 0)), sizes[sizes > 0]
            if not len(sizes):
                continue
            named = batch.select(list(keys)).to_pandas()
            begins = np.flatnonzero(np.append(True, (named.values[1:] != named.values[:-1]).any(axis=1)))
            starts = (np.cumsum(sizes) - sizes)[begins]
            draws = batch.column("ge_u").flatten().to_numpy(zero_copy_only=False)
            pieces = batch.select(own).take(pa.array(begins))
            shared = {"n": np.diff(np.append(starts, len(draws))), "u": draws[starts]}
            for level, (loss, burst) in enumerate(levels, 1):
                found = {"level": np.full(len(begins), level, np.int32)} | shared | piece_maps(draws, starts, loss, burst)
                yield pa.RecordBatch.from_arrays([*pieces.columns, *map(pa.array, found.values())], names=[*own, *found])

    pieces = dealt.mapInArrow(task, f"{kinds}, level int, n long, u double, lost0 long, begins0 long, end0 int, lost1 long, begins1 long, end1 int")
    asked = [F.element_at(F.array(*[F.lit(x) for x in of]), F.col("level")) for of in zip(*levels, strict=True)]
    pieces = pieces.withColumns(dict(zip(("loss", "burst"), asked, strict=True)))
    p, r = transition_probabilities(F.col("loss"), F.col("burst"))
    # A chain's first draw gives its state; a later piece's first draw maps the state before it.
    chain = Window.partitionBy(*keys, "level").orderBy(*order)
    first, at = F.row_number().over(chain) == 1, F.col("u")
    sets, flips = (at >= F.least(p, r)) & (at < F.greatest(p, r)), at < F.least(p, r)
    pieces = pieces.withColumns({"first": first, **{f"head{s}": F.when(first, at < F.col("loss")).when(sets, p >= r).otherwise(flips != F.lit(s == 1)) for s in (0, 1)}})
    through = {f"to{s}": F.when(F.col(f"head{s}"), F.col("end1")).otherwise(F.col("end0")) for s in (0, 1)}
    pieces = pieces.withColumns(through)
    upto = chain.rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("to0") == F.col("to1")
    pieces = pieces.withColumn("turns", F.sum((~same).cast("long") * F.col("to0")).over(upto))
    fixed = F.last(F.when(same, F.struct("to0", "turns")), ignorenulls=True).over(upto)
    pieces = pieces.withColumn("ends", (fixed["to0"] + F.col("turns") - fixed["turns"]) % 2)
    pieces = pieces.withColumn("before", F.coalesce(F.lag("ends").over(chain), F.lit(0)) == 1)
    pieces = pieces.withColumn("head", F.when(F.col("before"), F.col("head1")).otherwise(F.col("head0")))
    of = lambda c: F.sum(F.when(F.col("head"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")))
    begun = F.sum((F.col("head") & ~F.col("before")).cast("long"))
    per = pieces.groupBy(*keys, "level", "loss", "burst").agg(F.sum("n").alias("n"), of("lost").alias("n_lost"), (of("begins") + begun).cast("double").alias("n_bursts"))
    return per.select(*keys, "level", "loss", "burst", (F.col("n_lost") / F.col("n")).alias("loss_rate"), F.when(F.col("n_bursts") > 0, F.col("n_lost") / F.col("n_bursts")).otherwise(0.0).alias("mean_burst"), "n_bursts")
