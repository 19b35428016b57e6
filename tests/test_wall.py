import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelake import labels as L
from kinelake.operators import inject as I
from kinelake.operators import profile as P
from kinelake.operators import signals as Si
from kinelake.operators.blind import GroundTruthError, blind, column_sources, require_blind
from kinelake.tables import written

from .frames import NAN, frames, window


@pytest.fixture(scope="module")
def clean(spark):
    return frames(spark, [r for w in range(2) for r in window(win=w, start=w * 0.5, n=20)])


TOLD = "dropout"
DISGUISES = {
    "renamed": lambda d: d.withColumn("rate_hz", F.col("severity")),
    "renamed twice": lambda d: d.withColumnRenamed("severity", "x").withColumnRenamed("x", "rate_hz"),
    "in a struct": lambda d: d.withColumn("ecg", F.struct(F.col("ax"), F.col("severity").alias("lead1"))),
    "in a map": lambda d: d.withColumn("channels_present", F.create_map(F.lit("k"), F.col("failure"))),
    "in a sum": lambda d: d.withColumn("ax", F.col("ax") + F.col("severity") * 0),
    "in a condition": lambda d: d.withColumn("t", F.when(F.col("failure") == "dropout", F.col("t")).otherwise(0.0)),
    "over a window": lambda d: d.withColumn("rate_hz", F.max("severity").over(Window.partitionBy("win"))),
    "after a group": lambda d: d.groupBy("dataset", "subject", "seg", "win", "node", "idx").agg(F.first("t").alias("t"), F.max("severity").alias("rate_hz")),
    "after an explode": lambda d: d.withColumn("rate_hz", F.explode(F.array("severity", "severity"))),
    "by a join": lambda d: d.drop("severity", "failure").join(d.select("win", F.col("severity").alias("rate_hz")).distinct(), "win"),
    "by a union": lambda d: d.withColumn("rate_hz", F.lit(1)).unionByName(d.withColumn("rate_hz", F.col("severity"))),
    "in SQL": lambda d: d.selectExpr("*", "named_struct('a', failure) AS ecg"),
    "after pandas": lambda d: d.mapInPandas(lambda b: b, d.schema).withColumnRenamed("severity", "rate_hz"),
}


@pytest.mark.parametrize("name", DISGUISES)
def test_truth_is_refused_under_any_name(spark, clean, name):
    told = clean.withColumns({"failure": F.lit(TOLD), "severity": F.lit(2)})
    frame = blind(DISGUISES[name](told))
    with pytest.raises(GroundTruthError, match="come from the ground truth"):
        require_blind(frame, "test")
    with pytest.raises(GroundTruthError):
        Si.node_signals(frame)


def test_what_only_stands_beside_truth_is_let_through(spark, clean):
    told = clean.withColumns({"failure": F.lit(TOLD), "severity": F.lit(2), "label": F.lit("walking")})
    assert require_blind(blind(told), "test").columns == blind(told).columns
    joined = clean.join(told.select("win", "severity").distinct(), "win").where("severity = 2")
    require_blind(blind(joined), "test")
    after, _ = I.inject(clean, "dropout", 1, "ankle")
    require_blind(blind(after), "test")
    swept = I.swept(told, F.lit(0.5), 100.0)
    with pytest.raises(GroundTruthError):
        require_blind(blind(swept), "test")
    require_blind(blind(written(blind(swept), "stored")), "test")


def test_sources_are_all_names_on_the_way(spark, clean):
    df = clean.select((F.col("ax") + F.col("t")).alias("s"), "node").groupBy("node").agg(F.sum("s").alias("total"))
    assert dict(column_sources(df)) == {"node": frozenset({"node"}), "total": frozenset({"ax", "t", "s", "total"})}


def test_windows_and_samples_are_counted_while_they_are_stored(spark):
    windows = spark.range(990).select("id", F.when(F.col("id") % 3 == 0, "walking").otherwise("lying").alias("label"))
    kept, seen = P.stored_windows(windows, ["walking", "lying", "running"])
    assert seen == {"n": 990, "label walking": 330, "label lying": 660, "label running": 0} and kept.count() == 990
    assert P.require_count(seen["n"], 991) == P.require_window_count(windows, 991)
    with pytest.raises(P.WindowCountError):
        P.require_count(seen["n"], 1200)


@pytest.mark.parametrize("beyond", [False, True])
def test_labels_are_verified_from_what_was_counted(spark, beyond):
    act = F.when(F.col("id") < 1500, 1).when(F.col("id") < 1600, 2).when(F.col("id") < 3000, 200 if beyond else 50).otherwise(None)
    samples = spark.range(3500).select(act.cast("int").alias("activity"), F.lit("d").alias("dataset"), F.lit("s").alias("subject"), F.col("id").cast("double").alias("t"), F.when(F.col("id") % 10 == 0, NAN).otherwise(1.0).alias("ax"), F.lit(1.0).alias("ay"), F.lit(1.0).alias("az"))
    kept, seen = P.stored_samples(samples)
    whole = P.rows_profile(samples).where("level = 7").first()
    assert (seen["n_rows"], seen["n_nan"], seen["pct_nan"]) == (whole["n_rows"], whole["n_nan"], whole["pct_nan"]) and kept.count() == 3500
    dimension = spark.createDataFrame([(1, "lying", "mapped"), (2, "sitting", "mapped"), (3, "standing", "mapped"), (9, "other", "documented")], "activity_id int, name string, role string")
    want = L.verify_labels(samples.where("activity is not null").groupBy(F.col("activity").alias("activity_id")).agg(F.count("*").alias("n")), dimension)
    got = L.verify_observed(spark, seen["activities"], dimension)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {r["finding"] for r in got.collect()} == {"expected", "thin", "missing", "undocumented", "not present"}
