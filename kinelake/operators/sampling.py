"""Deterministic picks: every order is total, and every draw is a seeded hash of the row's identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written


def drawn(seed: int, *columns: str) -> Column:
    """An order as if drawn by lot."""
    return F.xxhash64(F.lit(seed), *columns)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], at: str = "at", of: str = "of") -> DataFrame:
    """``rows`` with ``at`` (place from 0 in its group's order, which must be total) and ``of`` (rows of the group).

    No group is sorted in one task: rows are dealt by ranges of (group, order), counted a group
    and range, and each range begins where those before it end.
    """
    dealt = written(rows.repartitionByRange(*by, *order).withColumn("of_range", F.spark_partition_id()), "numbered")
    per = dealt.groupBy(*by, "of_range").agg(F.count(F.lit(1)).alias("n_range"))
    group = Window.partitionBy(*by)
    per = per.select(*by, "of_range", (F.sum("n_range").over(group.orderBy("of_range")) - F.col("n_range")).alias("before"), F.sum("n_range").over(group).alias(of))
    inside = F.row_number().over(Window.partitionBy(*by, "of_range").orderBy(*order))
    return dealt.withColumn("inside", inside).join(per, [*by, "of_range"]).withColumn(at, F.col("before") + F.col("inside") - 1).select(*rows.columns, at, of)


def rank_median(rows: DataFrame, by: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """In each group the row at position n // 2 of the order by ``value``."""
    return numbered(rows, by, (value, *tie)).where(F.col("at") == F.floor(F.col("of") / 2)).drop("at", "of")


def first_n(rows: DataFrame, n: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("at") <= n).drop("at")


def middle_excerpt(rows: DataFrame, by: Sequence[str], order: Sequence[str], length: int, points: int = 128) -> DataFrame:
    """The middle ``length`` rows of each group, thinned to every (length // points)-th."""
    placed = numbered(rows, by, order)
    taken = F.least(F.lit(length), F.col("of"))
    begin = F.greatest(F.lit(0), F.floor(F.col("of") / 2) - F.floor(taken / 2))
    stride = F.greatest(F.lit(1), F.floor(taken / points))
    offset = F.col("at") - begin
    return placed.where((offset >= 0) & (offset < taken) & (F.pmod(offset, stride) == 0)).drop("at", "of")


#: Leading bits of a lot that are counted at once, and rows of one bucket that are told apart by sorting them.
DIGIT_BITS, FEW = 16, 4096


def smallest(rows: DataFrame, k: int, by: Sequence[str], lot: str, tie: Sequence[str]) -> DataFrame:
    """The ``k`` rows of each group with the least (``lot``, ``tie``), a total order; ``lot`` is a whole number.

    No group is sorted: rows are counted by the leading bits of their lots, which shows the bucket that the k-th
    is in; its rows are counted by the next bits, until they are few. One filter then keeps what is below, and of
    that bucket's rows as many as are missing. ``rows`` is read once a round; for lots that are hashes there is one.
    """
    by = list(by)
    digit = lambda shift: F.shiftright(F.col(lot).cast("long"), shift)  # noqa: E731  keeps the order, sign included
    bound = None
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        inside = rows.withColumn("need", F.lit(k)) if bound is None else rows.withColumn("prefix", digit(shift + DIGIT_BITS)).join(bound.select(*by, F.col("prefix"), "need"), [*by, "prefix"])
        counts = inside.groupBy(*by, digit(shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
        order = Window.partitionBy(*by).orderBy("prefix")  # a row a bucket that holds any
        counts = counts.withColumn("below", F.sum("n").over(order) - F.col("n"))
        found = counts.where((F.col("below") < F.col("need")) & (F.col("below") + F.col("n") >= F.col("need")))
        bound = written(found.select(*by, "prefix", (F.col("need") - F.col("below")).alias("need"), "n"), "lot-bounds")
        if (bound.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
    # A group with fewer than k rows has no bound and is kept whole.
    placed = rows.withColumn("lot_prefix", digit(shift)).join(bound.select(*by, F.col("prefix").alias("bound"), "need"), by, "left")
    low = placed.where(F.col("bound").isNull() | (F.col("lot_prefix") < F.col("bound")))
    here = placed.where(F.col("lot_prefix") == F.col("bound")).withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(lot, *tie))).where(F.col("at") <= F.col("need"))
    return low.select(*rows.columns).unionByName(here.select(*rows.columns))


def round_robin(rows: DataFrame, n_total: int, classes: Sequence[str], seed: int, label: str = "label", subject: str = "subject", identity: Sequence[str] = ("seg", "win"), draw_by: Column | None = None) -> DataFrame:
    """n_total // classes rows a class, one of each subject in turn, each subject's own in drawn order; all in a drawn order in the end."""
    per_class = max(1, n_total // len(classes))
    lot = draw_by if draw_by is not None else drawn(seed, subject, *identity)
    kept = smallest(rows.where(F.col(label).isin(list(classes))).withColumn("lot", lot.cast("long")), per_class, [label, subject], "lot", identity)
    turns = written(kept.withColumn("turn", F.row_number().over(Window.partitionBy(label, subject).orderBy("lot", *identity))), "turns")  # per_class rows a group at most
    # Whole turns are taken while they fit; of the next one, the first subjects.
    sizes = turns.groupBy(label, "turn").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("room", F.lit(per_class) - (F.sum("n").over(Window.partitionBy(label).orderBy("turn")) - F.col("n"))).where(F.col("room") > 0)
    placed = turns.join(sizes, [label, "turn"])
    whole = placed.where(F.col("n") <= F.col("room")).select(*turns.columns)
    part = placed.where(F.col("n") > F.col("room")).withColumn("place", F.row_number().over(Window.partitionBy(label, "turn").orderBy(subject))).where(F.col("place") <= F.col("room")).select(*turns.columns)
    return whole.unionByName(part).drop("lot", "turn")


def middle_of_run(rows: DataFrame, n_total: int, classes: Sequence[str], label: str = "label", order: Sequence[str] = ("subject", "seg", "win")) -> DataFrame:
    """Labels in turn, from each the window at (len // 2 + turn) modulo len of its stream; ``pick`` is the order."""
    rank = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    placed = numbered(rows.where(F.col(label).isin(list(classes))), (label,), order)
    turn = F.pmod(F.col("at") - F.floor(F.col("of") / 2), F.col("of"))
    each = -(-n_total // len(classes))
    near = placed.withColumn("turn", turn).where(F.col("turn") < each)  # at most n_total + classes rows from here on
    return near.withColumn("pick", F.row_number().over(Window.orderBy("turn", rank[F.col(label)]))).where(F.col("pick") <= n_total).drop("at", "of", "turn")


class SubjectOverlapError(ValueError):
    """The same person is in the examples and in the evaluation."""


def few_shot(rows: DataFrame, k: int, classes: Sequence[str], seed: int, label: str = "label", identity: Sequence[str] = ("subject", "seg", "win"), draw_by: Column | None = None) -> DataFrame:
    """``k`` examples a class by lot."""
    kept = rows.where(F.col(label).isin(list(classes))).withColumn("lot", (draw_by if draw_by is not None else drawn(seed, *identity)).cast("long"))
    return smallest(kept, k, [label], "lot", identity).drop("lot")


def require_disjoint(examples: DataFrame, evaluation: DataFrame, subject: str = "subject") -> None:
    """Refuses examples from people who are evaluated."""
    both = [r[0] for r in examples.select(subject).intersect(evaluation.select(subject)).limit(5).collect()]
    if both:
        raise SubjectOverlapError(f"subjects {both} are in the examples and in the evaluation")
