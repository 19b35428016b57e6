"""Dataset profiles: rows, spans, windows and missing values, rolled up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.samples import any_nan
from ..tables import written


def rows_profile(samples: DataFrame, keys: Sequence[str] = ("dataset", "subject", "activity")) -> DataFrame:
    """n_rows, first and last time, rows with a missing axis and their share, for every level of the rollup; NULL keys are totals."""
    return samples.rollup(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("t").alias("first_t"),
        F.max("t").alias("last_t"),
        F.sum(any_nan().cast("long")).alias("n_nan"),
        (100.0 * F.avg(any_nan().cast("double"))).alias("pct_nan"),
        F.grouping_id().cast("long").alias("level"),
    )


def window_counts(windows: DataFrame, keys: Sequence[str] = ("dataset", "subject", "label")) -> DataFrame:
    return windows.rollup(*keys).agg(F.count(F.lit(1)).alias("n_windows"), F.grouping_id().cast("long").alias("level"))


class WindowCountError(AssertionError):
    """The windows of a dataset are not as many as they should be."""


def require_window_count(windows: DataFrame, expected: int, tolerance: float = 0.01) -> int:
    """The number of windows; refused if it is off by more than ``tolerance``. (9,909 for the first dataset's eight classes.)"""
    return require_count(windows.count(), expected, tolerance)


def require_count(n: int, expected: int, tolerance: float = 0.01) -> int:
    """As ``require_window_count``, of a number that is known already."""
    if abs(n - expected) > tolerance * expected:
        raise WindowCountError(f"{n} windows; {expected} are expected")
    return n


#: Activity numbers that are counted on the way, each by itself; rows with others are counted by a query.
ACTIVITY_IDS = 64


def stored_windows(windows: DataFrame, labels: Sequence[str] = ()) -> tuple[DataFrame, dict[str, int]]:
    """``windows`` stored, and what was counted while they were: ``n``, and the windows of each label. No second scan."""
    seen = Observation("windows")
    counts = [F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("label") == x).alias(f"label {x}") for x in labels]]
    return written(windows.observe(seen, *counts), "windows"), dict(seen.get)


def stored_samples(samples: DataFrame, missing: Column | None = None) -> tuple[DataFrame, dict]:
    """``samples`` stored, and n_rows, n_nan and pct_nan as ``rows_profile`` gives them for the whole, and ``activities``: {number: rows}.

    ``missing`` says which rows lack a value (by default, those with a missing axis).
    """
    lost = missing if missing is not None else any_nan()
    seen = Observation("samples")
    own = [F.count_if(F.col("activity") == i).alias(f"a{i}") for i in range(ACTIVITY_IDS)]
    kept = written(samples.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(lost).alias("n_nan"), F.count_if(F.col("activity").isNotNull()).alias("n_named"), *own), "samples")
    got = seen.get
    activities = {i: got[f"a{i}"] for i in range(ACTIVITY_IDS) if got[f"a{i}"]}
    if sum(activities.values()) != got["n_named"]:
        others = kept.where(~F.col("activity").between(0, ACTIVITY_IDS - 1)).groupBy("activity").count()
        activities |= {r["activity"]: r["count"] for r in others.collect()}  # a row an activity
    n = got["n_rows"]
    return kept, {"n_rows": n, "n_nan": got["n_nan"], "pct_nan": 100.0 * got["n_nan"] / n if n else None, "activities": activities}
