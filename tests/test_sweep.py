import pytest
from pyspark.sql import functions as F

from kinelake.operators import inject as I
from kinelake.tables import shared_table

from .frames import NAN, frames, window

COLUMNS = ("seg", "win", "node", "idx", "t", "ax", "ay", "az", "gx", "gy", "gz")


@pytest.mark.parametrize("node", ["ankle", "chest"])
def test_one_pass_is_what_each_strategy_does(spark, node):
    rows = [r for w in range(2) for r in window(win=w, start=w * 0.5, n=40, accel=lambda n, i: (NAN, NAN, NAN) if i == 3 else (0.1 * i, 0.9, 0.2 - 0.01 * i))]
    target = frames(spark, rows).where(F.col("node") == node)
    u = F.pmod(F.xxhash64("seg", "win", "idx"), F.lit(1000)) / 1000.0
    made = {"dropout": I.Dropout(), "clock_desync": I.ClockDesync(), "packet_loss": I.PacketLoss(u), "rate_degradation": I.RateDegradation(100.0), "displacement": I.Displacement()}
    want, asked = [], None
    for k, (failure, severity) in enumerate(I.sweep_table()):
        own = target.withColumn("seg", F.col("seg") * 100 + k)
        want += made[failure].change(own, severity, 0).select(*COLUMNS).collect()
        part = own.withColumns({"failure": F.lit(failure), "severity": F.lit(severity)})
        asked = part if asked is None else asked.unionByName(part)
    out = I.swept(asked, u, 100.0)
    assert out.columns == asked.columns
    key = lambda r: r[:4]
    got = sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=key)
    want = sorted(map(tuple, want), key=key)
    assert len(got) == len(want) == 20 * 80
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-12, nan_ok=True), (a, b)


def test_a_shared_table_is_made_once_for_each_state_of_its_source(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.read.parquet(source).selectExpr("id * 2 AS x")

    source = str(tmp_path / "source")
    spark.range(5).write.parquet(source)
    a = [sorted(r[0] for r in shared_table(spark, source, "probe", make).collect()) for _ in range(3)]
    assert a == [[0, 2, 4, 6, 8]] * 3 and len(made) == 1
    spark.range(7).write.mode("overwrite").parquet(source)
    assert shared_table(spark, source, "probe", make).count() == 7 and len(made) == 2
