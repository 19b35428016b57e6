import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelake.functions.samples import NAN
from kinelake.operators import inject as I
from kinelake.operators.chains import chain_stats
from kinelake.operators import temporal as T

from .frames import frames, window


def uniforms(spark, n, chains=1):
    df = spark.range(n, numPartitions=8).select((F.col("id") % chains).alias("k"), F.col("id").alias("i"))
    return df.withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(5), "k", "i"), 11) / F.lit(float(1 << 53)))


@pytest.mark.parametrize("severity", [1, 2, 3, 4])
@pytest.mark.parametrize("size", [1, 7, 1000])
def test_composed_chunks_are_the_whole_chain(spark, severity, size):
    df = uniforms(spark, 1500, 6)
    loss, burst = I.LOSS_AND_BURST[severity - 1]
    whole = I.bursty_loss(df, loss, burst, F.col("u"), keys=("k",), order=("i",))
    parts = I.chunked_loss(df, loss, burst, F.col("u"), F.floor(F.col("i") / size), keys=("k",), order=("i",))
    a, b = ({(r["k"], r["i"]): r["lost"] for r in x.collect()} for x in (whole, parts))
    assert a == b and len(a) == 1500 and parts.columns == [*df.columns, "lost"]
    s, t = (sorted(map(tuple, x.collect())) for x in (I.burst_stats(whole, F.col("lost") == 1, ("k",), ("i",)), I.chunked_burst_stats(whole, F.col("lost") == 1, F.floor(F.col("i") / size), ("k",), ("i",))))
    assert [x[0] for x in s] == [x[0] for x in t] and [x[1:] for x in s] == [pytest.approx(x[1:]) for x in t]


def test_a_chain_of_ten_million_steps(spark):
    n, (loss, burst) = 10_000_000, I.LOSS_AND_BURST[2]
    chunk = F.floor(F.col("i") / 100_000)
    lost = I.chunked_loss(uniforms(spark, n), loss, burst, F.col("u"), chunk, ("k",), ("i",))
    row = I.chunked_burst_stats(lost, F.col("lost") == 1, chunk, ("k",), ("i",)).first()
    assert abs(row["loss_rate"] - loss) < 0.005 and abs(row["mean_burst"] / burst - 1) < 0.02


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_chains_in_pieces_at_all_levels_at_once(spark, batch):
    levels = (*I.LOSS_AND_BURST, (0.9, 2.0), (0.6, 1.5))  # the last two are left more seldom than entered
    df = uniforms(spark, 1500, 6)
    rows = df.groupBy("k", F.floor(F.col("i") / 30).alias("at")).agg(F.sort_array(F.collect_list(F.struct("i", "u")))["u"].alias("u"))
    rows = rows.unionByName(spark.range(3).select(F.col("id").alias("k"), F.lit(5).alias("at"), F.array().cast("array<double>").alias("u")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = chain_stats(rows.repartition(7), levels, F.col("u"), ("k",), ("at",)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r["level"], r["k"]): (r["loss_rate"], r["mean_burst"], r["n_bursts"]) for r in found}
    for level, (loss, burst) in enumerate(levels, 1):
        for r in I.burst_stats(I.bursty_loss(df, loss, burst, F.col("u"), ("k",), ("i",)), F.col("lost") == 1, ("k",), ("i",)).collect():
            assert got.pop((level, r["k"])) == pytest.approx((r["loss_rate"], r["mean_burst"], r["n_bursts"]))
    assert not got


def test_all_levels_are_one_pass(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = chain_stats(rows, I.LOSS_AND_BURST, F.array(F.rand(1)), ("k",), ("id",))._jdf.queryExecution().analyzed()
    assert plan.collectLeaves().size() == 1


def largest_share(df, columns):
    """The share of all rows that the most frequent combination of ``columns`` has."""
    per = df.groupBy(*columns).count().agg(F.max("count"), F.sum("count")).first()
    return per[0] / per[1]


@pytest.mark.parametrize("n", [1, 3, 50])
def test_ranges_with_halos_give_the_whole_streams_baseline(spark, n):
    # One stream has half of all rows; some vectors are missing, in long stretches too.
    rows = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, 0).otherwise(1 + F.col("id") % 5).alias("k"), F.col("id").alias("o"),
        *[F.when((F.col("id") % 7 == 3) | F.col("id").between(1000, 1400), None).otherwise(F.cos(F.col("id") * m)).alias(g) for g, m in (("gx", 1.0), ("gy", 0.3), ("gz", 0.07))],
    )
    got = {r["o"]: r["delta_deg"] for r in T.rolling_delta(rows, n, ["k"], ["o"]).collect()}
    w = Window.partitionBy("k").orderBy("o").rowsBetween(-n, -1)
    there = rows.where("gx is not null")
    means = [F.avg(c).over(w) for c in ("gx", "gy", "gz")]
    plain = there.withColumn("d", F.when(F.count("gx").over(w) == n, T.angle([F.col("gx"), F.col("gy"), F.col("gz")], means)))
    want = {r["o"]: r["d"] for r in plain.collect()} | {r["o"]: None for r in rows.where("gx is null").collect()}
    assert set(got) == set(want) and len(got) == 3000
    assert all(got[o] == pytest.approx(want[o], abs=1e-6) if want[o] is not None else got[o] is None for o in want)


def test_no_range_has_most_of_a_stream(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(8000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"), F.lit(1.0).alias("gx"))
        dealt = T.with_halo(rows, 3, ["k"], ["o"])
        assert largest_share(dealt, ["of_range"]) < 0.4 and largest_share(dealt, ["k", "of_range"]) < 0.4
        assert dealt.where("not halo").count() == 8000 and dealt.where("halo").count() <= 3 * dealt.select("of_range").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_onset_counts_over_ranges(spark):
    rows = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.lit(0.0).alias("gx"), F.lit(1.0).alias("gy"), F.lit(0.0).alias("gz"))
    got = {r["o"]: (r["pos"], round(r["gz"], 6)) for r in T.with_onset(rows.repartition(7), ["k"], ["o"], "wrist", 90.0, prefix=25).collect()}
    assert all(got[o] == (o, 1.0 if o >= 25 else 0.0) for o in range(400))


def sums_of(spark, make):
    base = [r for w in range(2) for r in window(win=w, start=w * 0.5, n=20)]
    clean = frames(spark, base)
    after = make(clean).withColumns({"failure": F.lit("dropout"), "severity": F.lit(1)})
    return I.invariants(I.window_sums(clean, "ankle"), I.window_sums(after, "ankle", ["failure", "severity", *I.WINDOW_KEY])).first()


def test_invariants_see_each_kind_of_harm(spark):
    fine = sums_of(spark, lambda c: c)
    assert fine["untouched"] and fine["changed"] == 0.0 and (fine["n_made"], fine["n_nulls"], fine["n_nan"]) == (0, 0, 0) and fine["n_windows"] == 2
    last = lambda c, node, other: F.when((F.col("node") == node) & (F.col("idx") == 20) & (F.col("win") == 1), other).otherwise(F.col(c))
    assert not sums_of(spark, lambda c: c.withColumn("ax", last("ax", "wrist", F.col("ax") + 1e-9)))["untouched"]
    assert not sums_of(spark, lambda c: c.withColumn("gx", last("gx", "wrist", F.lit(NAN))))["untouched"]
    swapped = sums_of(spark, lambda c: c.withColumn("node", F.when(F.col("node") == "wrist", "chest").when(F.col("node") == "chest", "wrist").otherwise(F.col("node"))))
    assert not swapped["untouched"]
    nulled = sums_of(spark, lambda c: c.withColumn("ax", last("ax", "ankle", F.lit(None))))
    assert nulled["untouched"] and nulled["changed"] == 0.5 and nulled["n_nulls"] == 1
    lost = sums_of(spark, lambda c: c.withColumn("ax", last("ax", "ankle", F.lit(NAN))))
    assert lost["n_nan"] == 1 and lost["n_nulls"] == 0 and lost["effect"] == 0.5
    assert sums_of(spark, lambda c: c.where("node <> 'wrist' or idx > 1"))["n_made"] == -2


def test_the_invariants_plan_does_not_grow_with_the_conditions(spark, sf_dir):
    from kinelake.plans import evaluation_queries as V

    plan = V.injector_invariants(spark, sf_dir)._jdf.queryExecution().analyzed()
    assert plan.collectLeaves().size() <= 12 < len(V.CONDITIONS)


def test_a_window_without_a_direction_counts_as_not_turned(spark):
    blank = lambda node, i: (NAN, NAN, NAN) if node == "ankle" else (0.0, 0.9, 0.2)
    clean = frames(spark, [*window(win=0, n=20), *window(win=1, start=0.5, n=20, accel=blank)])
    after, _ = I.inject(clean, "displacement", 4, "ankle")
    key = ["failure", "severity", *I.WINDOW_KEY]
    effects = [I.invariants(I.window_sums(a, "ankle"), I.window_sums(b.withColumns({"failure": F.lit("displacement"), "severity": F.lit(4)}), "ankle", key)).first()["effect"] for a, b in ((clean, after), (clean.where("win = 0"), after.where("win = 0")))]
    assert effects[0] == pytest.approx(effects[1] / 2) and effects[1] > 0
