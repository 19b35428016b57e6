import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelake.operators import sampling as Sa


@pytest.mark.parametrize("few", [0, 3, 4096])
@pytest.mark.parametrize("lot", ["xxhash64(id)", "id % 7 - 3", "cast(0 as bigint)", "id * 4294967296 - 5"])
def test_smallest_is_what_sorting_gives(spark, monkeypatch, few, lot):
    monkeypatch.setattr(Sa, "FEW", few)
    rows = spark.range(700).selectExpr("CASE WHEN id < 500 THEN 0 WHEN id < 650 THEN id % 3 ELSE id END AS g", "id", f"{lot} AS lot").repartition(5)
    for k in (1, 20, 600):
        got = sorted(r["id"] for r in Sa.smallest(rows, k, ["g"], "lot", ["id"]).collect())
        at = F.row_number().over(Window.partitionBy("g").orderBy("lot", "id"))
        assert got == sorted(r["id"] for r in rows.withColumn("at", at).where(F.col("at") <= k).collect())


def test_round_robin_is_what_sorting_gives(spark):
    rows = spark.range(900).selectExpr("CASE WHEN id % 2 = 0 THEN 'a' WHEN id % 5 = 0 THEN 'b' ELSE 'c' END AS label", "CASE WHEN id < 600 THEN 1 ELSE id % 40 END AS subject", "id AS seg", "0 AS win").repartition(4)
    for total in (3, 30, 240, 3000):
        got = sorted(r["seg"] for r in Sa.round_robin(rows, total, ["a", "b", "c"], 5).collect())
        each = total // 3
        lots = rows.withColumn("lot", Sa.drawn(5, "subject", "seg", "win"))
        turns = lots.withColumn("turn", F.row_number().over(Window.partitionBy("label", "subject").orderBy("lot", "seg", "win"))).where(F.col("turn") <= each)
        placed = turns.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("turn", "subject"))).where(F.col("place") <= each)
        assert got == sorted(r["seg"] for r in placed.collect()) and len(got) > 0


def test_no_window_over_a_class(spark):
    rows = spark.range(100).selectExpr("id % 2 AS label", "id AS seg", "0 AS win", "1 AS subject")
    made = Sa.few_shot(rows, 3, [0, 1], 9, identity=("seg",))
    assert made.count() == 6 and set(made.columns) == {"label", "seg", "win", "subject"}
    assert Sa.few_shot(rows.limit(0), 3, [0, 1], 9, identity=("seg",)).count() == 0
