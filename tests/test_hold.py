import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import NODE_KEY
from kinelake.operators import hold as H

COLUMNS = ("ax", "ay", "az", "gx", "gy", "gz")


def frames(spark, streams):
    rows = [("d", "s", 1, w, "ankle", i + 1, float(t), float(v), float("nan") if i % 5 == 0 else float(v), 0.0, None, None, None) for w, ts in enumerate(streams) for i, (t, v) in enumerate(zip(ts, range(len(ts)), strict=True))]
    return spark.createDataFrame(rows, "dataset string, subject string, seg long, win long, node string, idx int, t double, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(4)


def walked(ts, period):
    """The definition, a sample at a time: which sample each one shows."""
    out, last = [], None
    for i, t in enumerate(ts):
        if last is None or t - ts[last] >= period - 1e-12:
            last = i
        out.append(last)
    return out


def streams():
    rng = random.Random(6)
    made = [[i / 100 for i in range(60)], [1e9 + i / 100 for i in range(50)], [0.0] * 9, [5.0], [i * 0.02 for i in range(40)]]
    for _ in range(25):
        t, ts = rng.random(), []
        for _ in range(rng.randrange(1, 70)):
            t += rng.choice([0.0, 0.01, 0.01, 0.02, 0.005, 0.019999999999, 0.02 + 1e-15, rng.random() * 0.05, rng.choice([-0.03, 0.7])])
            ts.append(t)
        made.append(ts)
    return made


@pytest.mark.parametrize("chunk", [4, 16, 1024])
def test_is_the_walk_for_any_clock_and_chunk(spark, monkeypatch, chunk):
    monkeypatch.setattr(H, "CHUNK", chunk)
    made = streams()
    got = {}
    for r in H.hold(frames(spark, made), 0.02).collect():
        got[r["win"], r["idx"] - 1] = (r["held_ax"], r["held_ay"], r["held_gx"], r["fresh"])
    for w, ts in enumerate(made):
        shown = walked(ts, 0.02)
        for i, s in enumerate(shown):
            held, lossy, gyro, fresh = got[w, i]
            assert held == s and fresh == (s == i) and gyro is None, (w, i)
            assert np.isnan(lossy) if s % 5 == 0 else lossy == s
    assert len(got) == sum(map(len, made))


def test_due_time_is_where_subtraction_says_so(spark):
    rng = np.random.default_rng(4)
    t, least = rng.random(3000) * 10.0 ** rng.integers(-3, 10, 3000), 0.02 - 1e-12
    got = [r[0] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "i int, t double").orderBy("i").select(H.due_after(F.col("t"), least)).collect()]
    for x, v in zip(t, got, strict=True):
        assert v - x >= least and np.nextafter(v, -np.inf) - x < least


def test_a_window_of_a_million_samples(spark):
    n = 1_000_000
    wide = spark.range(n, numPartitions=8).select(*[F.lit("x" if c in ("dataset", "subject", "node") else 1).alias(c) for c in NODE_KEY], (F.col("id") + 1).cast("int").alias("idx"), (F.col("id") / 100.0 + (F.xxhash64("id") % 997) / 4e5).alias("t"))
    began = time.perf_counter()
    rows = H.sources(wide, 0.08)
    got = np.array([(r["idx"], r["source"]) for r in rows.orderBy("idx").toLocalIterator()])
    assert time.perf_counter() - began < 150
    ts = [r["t"] for r in wide.orderBy("idx").toLocalIterator()]
    assert (got[:, 0] == np.arange(1, n + 1)).all() and (got[:, 1] - 1 == np.array(walked(ts, 0.08))).all()


def test_no_python_and_no_task_with_a_whole_window(spark):
    plan = H.hold(frames(spark, streams()), 0.02)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_nothing_in_nothing_out(spark):
    assert H.hold(frames(spark, [[1.0]]).limit(0), 0.02).count() == 0
