"""Paired effects, spreads of repeats and summaries by condition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as an effect, and as pinned.
LEAST_PAIRS, LEAST_D, LEAST_CONSISTENCY = 3, 0.5, 0.7


def paired_effect(rows: DataFrame, pair: Sequence[str], condition: str, clean: str, changed: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per-pair differences changed - clean: n_pairs, mean_delta, sd_delta, cohens_d, n_increased, n_decreased, consistency, moves.

    One aggregation pairs the two conditions, in place of a join. Statistics are NULL
    below three pairs, and d where the differences don't vary.
    """
    sides = rows.where(F.col(condition).isin(clean, changed)).groupBy(*keys, *pair).agg(F.max(F.when(F.col(condition) == clean, F.col(value))).alias("a"), F.max(F.when(F.col(condition) == changed, F.col(value))).alias("b"))
    delta = sides.select(*keys, (F.col("b") - F.col("a")).alias("d")).where("d is not null")
    per = delta.groupBy(*keys).agg(F.count("d").alias("n_pairs"), F.avg("d").alias("mean_delta"), F.stddev_pop("d").alias("sd_delta"), F.sum((F.col("d") > 0).cast("long")).alias("n_increased"), F.sum((F.col("d") < 0).cast("long")).alias("n_decreased"))
    enough = F.col("n_pairs") >= LEAST_PAIRS
    d = F.when(enough & (F.col("sd_delta") > 1e-12), F.col("mean_delta") / F.col("sd_delta"))
    steady = F.when(enough, F.greatest("n_increased", "n_decreased") / F.col("n_pairs"))
    per = per.withColumns({"cohens_d": d, "consistency": steady})
    return per.withColumn("moves", F.coalesce((F.abs("cohens_d") >= LEAST_D) & (F.col("consistency") >= LEAST_CONSISTENCY), F.lit(False)))


def headroom_verdict(max_p_moves: Column, log_margin_moves: Column) -> Column:
    return F.when(max_p_moves, "max_p_usable").when(log_margin_moves, "use_log_margin").otherwise("no_headroom")


def group_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, min, max and population deviation (0 for one value) of the non-null values."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("sd"))


def repeat_spread(rows: DataFrame, keys: Sequence[str], value: str, digits: int = 12) -> DataFrame:
    """How far repeats of one call lie apart, and whether they agree to ``digits`` places."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), (F.max(value) - F.min(value)).alias("spread"), (F.countDistinct(F.round(value, digits)) <= 1).alias("identical"))


def by_condition(rows: DataFrame, condition: str = "condition") -> DataFrame:
    """n, accuracy and the mean confidence readouts of each condition."""
    right = (F.col("predicted") == F.col("label")).cast("double")
    return rows.groupBy(condition).agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.avg("max_p").alias("mean_max_p"), F.avg("log_margin").alias("mean_log_margin"), F.avg("entropy").alias("mean_entropy"))


def gate(dist: Column, margin: float = 0.0) -> Column:
    """Whether a distribution sums to 1 and its largest share beats chance by more than ``margin``."""
    p = F.transform(dist, lambda r: r["p"])
    total = F.aggregate(p, F.lit(0.0), lambda acc, v: acc + v)
    return (F.abs(total - 1.0) <= 1e-6) & (F.array_max(p) > 1.0 / F.size(p) + margin)
