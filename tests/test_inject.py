import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import inject as I
from kinelake.operators import signals as Si
from kinelake.operators.blind import blind

from .frames import NAN, by_node, frames, window

RATE = 100.0


def noisy(node, i):
    rng = random.Random(f"{node}{i}")
    return rng.gauss(0, 0.3), 0.9 + rng.gauss(0, 0.2), rng.gauss(0.2, 0.1)


@pytest.fixture(scope="module")
def clean(spark):
    rows = [r for w in range(3) for r in window(win=w, start=w * 0.5, accel=noisy)]
    return frames(spark, rows).cache()


@pytest.mark.parametrize("failure", I.FAILURE_TYPES)
@pytest.mark.parametrize("severity", [1, 4])
def test_other_nodes_stay_and_the_target_changes(spark, clean, failure, severity):
    after, truth = I.inject(clean, failure, severity, "ankle", seed=7, rate_hz=RATE)
    assert after.columns == clean.columns and after.count() == clean.count()
    assert I.untouched(clean, after, "ankle").count() == 0
    a, b = (d.where("node = 'ankle'").orderBy("win", "idx").drop("win").collect() for d in (clean, after))
    assert repr(a) != repr(b)
    again, _ = I.inject(clean, failure, severity, "ankle", seed=7, rate_hz=RATE)
    assert repr(again.orderBy("win", "node", "idx").collect()) == repr(after.orderBy("win", "node", "idx").collect())
    row = truth.first()
    assert row["tag"] == f"{failure}:sev{severity}" and I.REALISED_KEY[failure] in row["realised"]
    assert truth.count() == 3


def test_realised_effects_grow_with_severity(spark, clean):
    for failure in ("dropout", "clock_desync", "displacement"):
        got = [I.inject(clean, failure, s, "ankle", rate_hz=RATE, checked=False)[1].agg(F.avg(F.col("realised")[I.REALISED_KEY[failure]])).first()[0] for s in (1, 2, 3, 4)]
        assert got == sorted(got) and got[0] < got[-1], failure


def test_dropout_blanks_the_end(spark, clean):
    after, truth = I.inject(clean, "dropout", 1, "ankle")
    s = by_node(Si.node_signals(blind(after)).where("win = 0"), "n_missing", "nan_terminal", "nan_trailing_run")
    assert s["ankle"] == (25, True, 25) and s["wrist"] == (0, False, 0)
    row = truth.where("win = 0").first()["realised"]
    assert row["frac_nan"] == 0.25 and row["onset"] == pytest.approx(0.75) and row["n_frames"] == 100
    lost = after.where("node = 'ankle' and isnan(ax)")
    assert lost.where("not isnan(gx)").count() == 0
    chest, _ = I.inject(clean, "dropout", 4, "chest")
    assert chest.where("node = 'chest' and gx is not null").count() == 0


def test_hold_repeats_without_losing(spark, clean):
    after, truth = I.inject(clean, "rate_degradation", 2, "ankle", rate_hz=RATE)
    assert after.where(F.isnan("ax")).count() == 0
    s = by_node(Si.node_signals(blind(after)).where("win = 0"), "unique_values", "max_repeat_run", "repeat_fraction")
    assert s["ankle"][:2] == (25, 4) and s["ankle"][2] == pytest.approx(75 / 99)
    assert truth.first()["realised"]["target_hz"] == 25.0


def test_hold_keeps_a_held_gap_and_structural_absence(spark):
    rows = window(nodes=("wrist", "chest"), n=8, accel=lambda node, i: (NAN, NAN, NAN) if i == 0 else (i, 0.0, 0.0))
    after, _ = I.inject(frames(spark, rows), "rate_degradation", 1, "chest", rate_hz=RATE)
    ax = [r["ax"] for r in after.where("node = 'chest'").orderBy("idx").collect()]
    assert math.isnan(ax[0]) and math.isnan(ax[1]) and ax[2:] == [2.0, 2.0, 4.0, 4.0, 6.0, 6.0]
    assert after.where("node = 'chest' and gx is not null").count() == 0


def test_offset_and_skew_shift_times_only(spark, clean):
    after, truth = I.inject(clean, I.ClockDesync(skew_ppm=1000.0), 2, "ankle")
    both = clean.alias("a").join(after.alias("b"), ["win", "node", "idx"]).where("node = 'ankle' and win = 0").select("idx", F.col("a.t").alias("t0"), F.col("b.t").alias("t1"), F.col("a.ax").alias("x0"), F.col("b.ax").alias("x1")).collect()
    for r in both:
        assert r["x0"] == r["x1"] and r["t1"] - r["t0"] == pytest.approx(0.2 + r["t0"] * 1e-3)
    assert truth.where("win = 0").first()["realised"]["delta_ms"] == pytest.approx(200 + 0.495)


def test_turn_is_a_rotation(spark, clean):
    after, truth = I.inject(clean, "displacement", 3, "wrist")
    pair = clean.alias("a").join(after.alias("b"), ["win", "node", "idx"]).where("node = 'wrist'").limit(20)
    c = math.cos(math.radians(45))
    for r in pair.select("a.ax", "a.ay", "a.az", "b.ax", "b.ay", "b.az", "a.gy", "a.gz", "b.gy").collect():
        assert r[3] == r[0] and r[4] == pytest.approx(c * r[1] - c * r[2]) and r[5] == pytest.approx(c * r[1] + c * r[2])
        assert r[8] == pytest.approx(c * r[6] - c * r[7])
    got = truth.first()["realised"]
    phi = math.acos(got["gravity_axis_alignment"])
    assert got["realised_angle_deg"] == pytest.approx(math.degrees(math.acos(math.cos(phi) ** 2 + math.sin(phi) ** 2 * c)))
    chest, _ = I.inject(clean, "displacement", 3, "chest")  # about y, and no gyroscope to turn
    assert chest.alias("b").join(clean.alias("a"), ["win", "node", "idx"]).where("node = 'chest' and (a.ay <> b.ay or b.gx is not null)").count() == 0


def walked(u, loss, burst):
    """The chain as it is defined, a step at a time."""
    p, r = I.transition_probabilities(loss, burst)
    out = [u[0] < loss]
    for x in u[1:]:
        out.append(x >= r if out[-1] else x < p)
    return [int(v) for v in out]


@pytest.mark.parametrize("severity", [1, 2, 3, 4])
def test_loss_without_walking_is_the_chain(spark, severity):
    rng = np.random.default_rng(severity)
    u = {k: rng.random(60) for k in range(25)}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in u.items() for i, x in enumerate(v)], "k int, i int, u double")
    got = I.bursty_loss(df, *I.LOSS_AND_BURST[severity - 1], F.col("u"), keys=("k",), order=("i",)).orderBy("k", "i").collect()
    for k, v in u.items():
        assert [r["lost"] for r in got if r["k"] == k] == walked(v, *I.LOSS_AND_BURST[severity - 1])


def test_loss_rates_and_bursts_are_calibrated(spark):
    df = spark.range(20 * 10_000).select((F.col("id") % 20).alias("k"), F.col("id").alias("i")).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(5), "k", "i"), 11) / F.lit(float(1 << 53)))
    for loss, burst in I.LOSS_AND_BURST:
        lost = I.bursty_loss(df, loss, burst, F.col("u"), keys=("k",), order=("i",))
        row = I.burst_stats(lost, F.col("lost") == 1, keys=("k",), order=("i",)).agg(F.avg("loss_rate"), F.avg("mean_burst")).first()
        assert abs(row[0] - loss) < 0.02 and abs(row[1] / burst - 1) < 0.15


def test_numpys_numbers_are_those_of_a_sequential_walk(spark, clean):
    after, _ = I.inject(clean, I.NumpyPacketLoss(), 3, "ankle", seed=20)
    got = {w: [math.isnan(r["ax"]) for r in after.where(f"node = 'ankle' and win = {w}").orderBy("idx").collect()] for w in range(3)}
    rng, (loss, burst) = np.random.default_rng(20), I.LOSS_AND_BURST[2]
    p, r = I.transition_probabilities(loss, burst)
    for w in range(3):
        bad, lost = rng.random() < loss, []
        for _ in range(100):
            lost.append(bool(bad))
            u = rng.random()
            bad = u >= r if bad else u < p
        assert got[w] == lost


def test_failures_compose(spark, clean):
    once, t1 = I.inject(clean, "displacement", 2, "ankle")
    twice, t2 = I.inject(once, "dropout", 1, "ankle")
    stack = I.stacked(t1, t2).first()["injection_stack"]
    assert stack == ["displacement:sev2", "dropout:sev1"]
    assert twice.where("node = 'ankle' and isnan(ax)").count() == 75


def test_refusals(spark, clean):
    for bad in (lambda: I.inject(clean, "meteor", 1, "ankle"), lambda: I.inject(clean, "dropout", 5, "ankle"), lambda: I.inject(clean, "dropout", 1, "knee"), lambda: I.inject(clean, "rate_degradation", 1, "ankle")):
        with pytest.raises(I.InjectionError):
            bad()

    class NeedsGyro(I.Dropout):
        name, required = "gyro_loss", ("accel", "gyro")

    with pytest.raises(I.InjectionError):
        I.inject(clean, NeedsGyro(), 1, "chest")
    I.register(NeedsGyro())
    assert I.inject(clean, "gyro_loss", 1, "ankle")[1].count() == 3
    I.REGISTRY.pop("gyro_loss")
    assert len(I.sweep_table()) == 20
