import random
import time

import pytest
from pyspark.sql import functions as F

from kinelake.operators import segment as G


def samples(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], "dataset string, subject string, t double, ord int, activity int, node string, v double")


def test_breaks_on_gap_and_activity_whatever_the_bucket(spark):
    rng = random.Random(3)
    t, rows, act = 0.0, [], 1
    for i in range(400):
        t += rng.choice([0.01, 0.1, 0.1000001, 0.5])
        act = rng.choice([act] * 9 + [2, 3])
        rows.append(("s", t, i, act, "wrist", 1.0))
    expected, seg, before = [], 0, None
    for r in rows:
        if before is None or r[1] - before[1] > 0.1 or r[3] != before[3]:
            seg += 1
        expected.append(seg)
        before = r
    for bucket in (0.3, 7.0, 1e9):
        got = G.segments(samples(spark, rows), 0.1, bucket).orderBy("ord").select("seg").collect()
        assert [r[0] for r in got] == expected


def test_starts_are_added_up(spark):
    got = spark.range(1).select(G.window_starts(F.lit(0.0), F.lit(700.0), 2.56, 1.28).alias("s")).first()["s"]
    start, expected = 0.0, []
    while start + 2.56 <= 700.0 + 1e-9:
        expected.append(start)
        start += 1.28
    assert got == expected
    assert any(a != i * 1.28 for i, a in enumerate(got))


@pytest.mark.parametrize("end", [2.0, 2.56, 3.84, 5.0, 329.0, 330.24, 331.5, 657.92, 659.2, 5000.0])
def test_starts_of_short_and_long_segments(spark, end):
    start, expected = 0.5, []
    while start + 2.56 <= 0.5 + end + 1e-9:
        expected.append(start)
        start += 1.28
    assert spark.range(1).select(G.window_starts(F.lit(0.5), F.lit(0.5 + end), 2.56, 1.28).alias("s")).first()["s"] == expected


def test_starts_are_quick_for_many_short_and_for_one_long_segment(spark):
    def seconds(df):
        began = time.perf_counter()
        df.select(F.sum(F.size(G.window_starts(F.col("t0"), F.col("t1"), 2.56, 1.28))).alias("n")).collect()
        return time.perf_counter() - began

    short = spark.range(80_000, numPartitions=4).select(F.lit(0.0).alias("t0"), (2.56 + 1.28 * (F.col("id") % 9)).alias("t1"))
    long = spark.range(1).select(F.lit(0.0).alias("t0"), F.lit(1.28 * 80_000).alias("t1"))
    seconds(short)
    assert min(seconds(short) for _ in range(3)) < 2 and min(seconds(long) for _ in range(3)) < 3


def test_short_segments_and_thin_windows_are_left_out(spark):
    rows = [("s", i / 10, i, 1, "wrist", 1.0) for i in range(100)] + [("s", 100 + i / 10, 200 + i, 1, "wrist", 1.0) for i in range(5)]
    seg = G.segments(samples(spark, rows), 0.15, 3.0)
    wins = G.sliding_windows(seg, 2.0)
    assert {r["seg"] for r in wins.collect()} == {1}
    fr = G.frames(seg, wins, 1.0, least=20)
    counts = {r["win"]: r["n"] for r in fr.groupBy("win").agg(F.count("*").alias("n")).collect()}
    assert all(n >= 20 for n in counts.values())
    for r in fr.select("t", "start", "end").collect():
        assert r["start"] <= r["t"] < r["end"]
    assert G.frames(seg, wins, 1.0, least=21).count() == 0


def test_cells_do_not_change_the_frames(spark):
    rows = [("s", i * 0.07, i, 1, "wrist", 1.0) for i in range(300)]
    seg = G.segments(samples(spark, rows), 0.1, 2.0)
    wins = G.sliding_windows(seg, 2.56)
    a, b = (G.frames(seg, wins, c).select("win", "t").collect() for c in (0.4, 9.0))
    assert sorted(a) == sorted(b)


def test_longest_run(spark):
    rows = spark.createDataFrame([(1, i, c == "x") for i, c in enumerate("..xx.xxx.x")] + [(2, 0, False)], "k int, i int, f boolean")
    assert {r["k"]: r["run"] for r in G.longest_run(rows, F.col("f"), ["k"], ["i"]).collect()} == {1: 3, 2: 0}


def test_least_samples_rounds_to_even():
    assert G.least_samples(2.56, 100) == 154
    assert G.least_samples(2.56, 50) == 77
    assert G.least_samples(0.05, 50) == 1  # round(2.5) is 2, round(1.2) is 1


@pytest.mark.parametrize("rows", [[], [("s", 1.0, 1, 1, "wrist", 1.0)]])
def test_nothing_in_nothing_out(spark, rows):
    seg = G.segments(samples(spark, rows), 0.1, 1.0)
    assert seg.count() == len(rows)
    assert G.sliding_windows(seg, 1.0).count() == 0
