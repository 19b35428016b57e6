import math

import numpy as np
import pytest

from kinelake.operators import diagnose as D
from kinelake.operators import signals as Si
from kinelake.operators.blind import GroundTruthError, blind

from .frames import NAN, by_node, frames, window


def test_missing_is_not_zero_and_not_imputed(spark):
    half = lambda node, i: (2.0, 0.0, 0.0) if i < 50 or node != "ankle" else (NAN, NAN, NAN)
    s = Si.window_signals(frames(spark, window(accel=half)))
    row = {r["node"]: r for r in s.collect()}["ankle"]
    assert row["nan_fraction"] == 0.5 and row["nan_run_max"] == 50 and row["nan_terminal"] and row["nan_trailing_run"] == 50
    assert row["mean_accel_magnitude_g"] == 2.0 and row["total_variance"] == 0.0
    assert row["frame_completeness"] == 0.5


def test_one_lost_axis_makes_a_sample_missing(spark):
    part = lambda node, i: (0.1 * i, NAN if i == 10 else 0.9, 0.2)
    assert by_node(Si.window_signals(frames(spark, window(accel=part))), "n_missing") == {"wrist": 1, "chest": 1, "ankle": 1}


def test_absent_gyroscope_is_not_a_silent_one(spark):
    out = by_node(Si.window_signals(frames(spark, window())), "gyro_available", "gyro_nan_fraction", "gyro_mean_abs_dps")
    assert out["chest"] == (False, None, None)
    assert out["wrist"] == (True, 0.0, 2.0)


def test_gyroscope_variance_is_over_all_axes(spark):
    out = by_node(Si.window_signals(frames(spark, window())), "gyro_variance")
    assert out["wrist"] == pytest.approx(np.var([1.0, 2.0, 3.0] * 100))


def test_repeats_are_counted_over_valid_samples(spark):
    values = [1, 1, NAN, 1, 2, 3, 3, 3, 3, 4]
    s = Si.window_signals(frames(spark, window(nodes=("wrist",), n=10, accel=lambda node, i: (values[i], 0.5, 0.5))))
    row = s.first()
    assert row["max_repeat_run"] == 4 and row["unique_values"] == 4 and row["repeat_fraction"] == pytest.approx(5 / 8)
    assert row["cross_node_offset_ms"] is None and row["synchrony"] is None


@pytest.mark.parametrize("n,accel", [(1, lambda node, i: (0.0, 1.0, 0.0)), (3, lambda node, i: (NAN, NAN, NAN)), (2, lambda node, i: (0.0, 1.0, 0.0))])
def test_hardly_any_samples(spark, n, accel):
    row = Si.window_signals(frames(spark, window(nodes=("wrist",), n=n, accel=accel))).first()
    valid = 0 if n == 3 else n
    assert row["n_valid"] == valid and row["staleness"] == (0.0 if valid == 2 else 1.0)
    assert row["magnitude_plausible"] == (valid > 1)
    assert (row["gravity_x"] is None) == (valid == 0)


def test_offset_against_the_median_of_three_and_of_two(spark):
    three = by_node(Si.window_signals(frames(spark, window(shift={"ankle": 0.05}))), "cross_node_offset_ms")
    assert three["ankle"] == pytest.approx(50) and three["wrist"] == pytest.approx(0)
    two = by_node(Si.window_signals(frames(spark, window(nodes=("wrist", "ankle"), shift={"ankle": 0.05}))), "cross_node_offset_ms")
    assert two["ankle"] == pytest.approx(25) and two["wrist"] == pytest.approx(-25)


def test_clock_runs_backwards(spark):
    rows = window(nodes=("wrist",), n=5)
    rows[3] = rows[3][:8] + (rows[1][8],) + rows[3][9:]
    row = Si.window_signals(frames(spark, rows)).first()
    assert not row["timestamp_monotonic"] and row["temporal"] == 0.0


def test_truth_never_enters(spark):
    df = frames(spark, window()).withColumnRenamed("has_gyro", "has_gyro")
    with pytest.raises(GroundTruthError):
        Si.node_signals(df.selectExpr("*", "'walking' AS label"))
    assert "label" not in blind(df.selectExpr("*", "'walking' AS label", "1 AS severity")).columns


def test_monitor_sources_do_not_name_the_truth():
    from pathlib import Path

    import kinelake.operators as ops

    root = Path(ops.__file__).parent
    for name in ("signals.py", "diagnose.py", "features.py", "calibrate.py"):
        text = (root / name).read_text()
        for word in ("injected_failure", "failure_type", "severity", "realised"):
            assert word not in text, (name, word)


def signals_with(spark, **given):
    base = dict(dataset="d", subject="s", seg=1, win=1, node="ankle", n_frames=100, n_valid=100, nan_fraction=0.0, nan_terminal=False, nan_trailing_run=0, nan_run_max=0, repeat_fraction=0.0, unique_value_ratio=1.0, max_repeat_run=1, effective_unique_rate_hz=100.0, cross_node_offset_ms=0.0, gravity_x=1.0, gravity_y=0.0, gravity_z=0.0, magnitude_plausible=True, saturation_frac=0.0, total_variance=1.0, timestamp_monotonic=True, inter_sample_interval_cv=0.0) | given
    df = spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'double'}" for k, v in base.items()))
    return df.withColumns(Si.sub_scores())


@pytest.mark.parametrize(
    "given,diagnosis",
    [
        ({}, "healthy"),
        ({"nan_fraction": 0.3, "nan_terminal": True, "nan_trailing_run": 30}, "dropout"),
        ({"nan_fraction": 0.3, "nan_terminal": True, "nan_trailing_run": 10}, "packet_loss"),
        ({"nan_fraction": 0.3}, "packet_loss"),
        ({"nan_fraction": 0.02}, "healthy"),
        ({"repeat_fraction": 0.5}, "rate_degradation"),
        ({"unique_value_ratio": 0.7, "max_repeat_run": 3}, "rate_degradation"),
        ({"unique_value_ratio": 0.7, "max_repeat_run": 2}, "healthy"),
        ({"cross_node_offset_ms": -50.0}, "clock_desync"),
        ({"cross_node_offset_ms": 25.0}, "healthy"),
        ({"gravity_x": 0.0, "gravity_y": 1.0}, "displacement"),
    ],
)
def test_ladder(spark, given, diagnosis):
    ref = spark.createDataFrame([("d", "ankle", 0.0, 0.0, 1.0, 5.0)] if diagnosis == "displacement" else [("d", "ankle", 1.0, 0.0, 0.0, None)], "dataset string, node string, ref_x double, ref_y double, ref_z double, p95 double")
    row = D.diagnose(signals_with(spark, **given), ref).first()
    assert row["diagnosis"] == diagnosis and row["rule"] and row["evidence"]


def test_the_worst_sub_score_decides(spark):
    row = D.diagnose(signals_with(spark, nan_fraction=1.0, n_valid=0, magnitude_plausible=False), D.no_references(spark.range(1))).first()
    assert row["state"] == "OFFLINE" and row["trust_weight"] == 0.0 and row["min_sub_score"] == 0.0
    assert row["geometric_mean_sub_score"] < 0.02 and row["placement"] is None


@pytest.mark.parametrize("score,state", [(0.95, "HEALTHY"), (0.9, "DEGRADED"), (0.7, "DEGRADED"), (0.4, "UNRELIABLE"), (0.2, "OFFLINE"), (0.1, "OFFLINE")])
def test_state_bounds_are_strict(spark, score, state):
    from pyspark.sql import functions as F

    assert spark.range(1).select(D.state_of(F.lit(score)).alias("s")).first()["s"] == state


def test_what_a_turn_shows(spark):
    from pyspark.sql import functions as F

    from kinelake.functions.samples import observable_angle

    got = spark.range(1).select(observable_angle(15.0, F.lit(90.0)).alias("a"), observable_angle(15.0, F.lit(0.0)).alias("b")).first()
    assert got["a"] == pytest.approx(15.0) and got["b"] == pytest.approx(0.0, abs=1e-6)


def test_silent_nodes_are_offline(spark):
    s = Si.window_signals(frames(spark, window(nodes=("wrist",))))
    expected = spark.createDataFrame([("toy", "s1", 1, 0, n) for n in ("wrist", "ankle")], "dataset string, subject string, seg long, win long, node string")
    out = D.diagnose(Si.with_silent_nodes(s, expected), D.no_references(s))
    assert by_node(out, "state") == {"wrist": "HEALTHY", "ankle": "OFFLINE"}
    net = D.network_state(out).first()
    assert net["flagged_nodes"] == ["ankle"] and net["worst_min"] == 0.0 and net["network_state"] == "OFFLINE"


def test_unclipped_cosines_stay_in_range(spark):
    from pyspark.sql import functions as F

    from kinelake.functions.samples import angle, clip

    v = [F.lit(0.1), F.lit(0.2), F.lit(0.3)]
    assert spark.range(1).select(angle(v, v).alias("a")).first()["a"] == pytest.approx(0.0, abs=1e-5)
    got = spark.range(1).select(clip(F.lit(NAN), 0.0, 1.0).alias("n"), clip(F.lit(None).cast("double"), 0.0, 1.0).alias("z")).first()
    assert math.isnan(got["n"]) and got["z"] is None


def sorts_of(df):
    """The sorts by window of a plan, outermost first."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Sort [")[1] for line in plan.splitlines() if "- Sort [" in line and "win#" in line.split("Sort [")[1]]


def test_samples_of_a_window_are_sorted_three_times_in_all(spark, sf_dir):
    from kinelake.plans.event_queries import event_signals

    by_window, *samples = sorts_of(event_signals(spark, sf_dir))
    assert "node#" not in by_window  # of signals, for the offset
    assert len(samples) == 3, samples  # by place in time, by number, by value


def test_values_are_counted_once_each_whatever_lies_between(spark):
    values = [0.5, 0.5, -0.0, 0.5, 0.0, NAN, 0.25, NAN, 0.5, 0.25]
    got = Si.node_signals(frames(spark, window(nodes=("ankle",), n=10, accel=lambda node, i: (values[i], 1.0, 0.0)))).first()
    assert (got["unique_values"], got["n_valid"], got["max_repeat_run"], got["nan_run_max"], got["repeat_fraction"]) == (3, 8, 2, 1, 1 / 7)
