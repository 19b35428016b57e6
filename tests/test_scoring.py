import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import calibrate as C
from kinelake.operators import diagnose as D
from kinelake.operators import inject as I
from kinelake.operators import score as S
from kinelake.operators import signals as Si
from kinelake.operators import temporal as T
from kinelake.operators.blind import blind

from .frames import frames, window
from .test_inject import RATE, noisy


def test_whole_evaluation(spark):
    clean = frames(spark, [r for w in range(6) for r in window(win=w, start=w * 0.5, accel=noisy)]).cache()
    refs = C.references(C.calibrate(blind(clean))).cache()
    rows = S.tally(D.diagnose(Si.window_signals(blind(clean)), refs), None)
    for failure in ("dropout", "clock_desync", "rate_degradation"):
        after, truth = I.inject(clean, failure, 3, "ankle", seed=1, rate_hz=RATE)
        rows = rows.unionByName(S.tally(D.diagnose(Si.window_signals(blind(after)), refs), truth))
    rows = rows.cache()
    prf = {(r["true_failure"], r["severity"]): r for r in S.detection(rows).collect()}
    for failure in ("dropout", "clock_desync", "rate_degradation"):
        assert prf[(failure, 3)]["recall"] == 1.0 and prf[(failure, None)]["tp"] == 6
    table = {r["expected_diagnosis"]: r for r in S.confusion(rows).collect()}
    assert set(table) == set(D.DIAGNOSES) and table["dropout"]["dropout"] == 6 and table["packet_loss"]["n"] == 0 and table["packet_loss"]["accuracy"] is None
    assert table["healthy"]["n"] == 18
    fpr = {r["node"]: r for r in S.false_positives(rows).collect()}
    assert fpr[None]["n"] == 18 and fpr["ankle"]["n"] == 6
    late = {r["true_failure"]: r for r in S.detection_latency(rows).collect()}
    assert set(late) == {"dropout"} and late["dropout"]["latency_sec"] == pytest.approx(0.75)
    assert S.diagnosis_accuracy(rows).first()["n"] == 18 + 18
    desync = S.desync_by_clock(rows).collect()
    assert [(r["clock_source"], r["n"], r["diagnosed"]) for r in desync] == [("unknown", 6, 6)]


def test_nothing_flagged_gives_zeros(spark):
    schema = "true_failure string, severity int, is_target boolean, flagged boolean, node string, predicted_diagnosis string, expected_diagnosis string"
    rows = spark.createDataFrame([("dropout", 1, True, False, "a", "healthy", "dropout")], schema)
    r = S.detection(rows).where("severity is not null").first()
    assert (r["precision"], r["recall"], r["f1"], r["fn"]) == (0.0, 0.0, 0.0, 1)
    none = S.false_positives(rows).collect()
    assert [(r["n"], r["rate"]) for r in none] in ([], [(0, 0.0)])


def test_calibration_is_numpys(spark):
    rng = np.random.default_rng(0)
    mean = {w: rng.normal([0.1, 0.9, 0.2], 0.1) for w in range(20)}
    rows = [r for w in range(20) for r in window(nodes=("ankle",), n=4, win=w, accel=lambda node, i, w=w: mean[w])]
    got = C.calibrate(frames(spark, rows).drop("label"), max_windows=12).first()
    a = np.array([mean[w] for w in range(12)])
    ref = a.mean(0) / np.linalg.norm(a.mean(0))
    angles = np.degrees(np.arccos(np.clip((a / np.linalg.norm(a, axis=1, keepdims=True)) @ ref, -1, 1)))
    assert got["n_windows"] == 12
    assert (got["ref_x"], got["p95"], got["mean_angle"], got["max_angle"]) == pytest.approx((ref[0], np.percentile(angles, 95), angles.mean(), angles.max()))


def test_rolling_delta_skips_nulls_and_leaves_itself_out(spark):
    rng = np.random.default_rng(2)
    vectors = [None if i % 5 == 3 else rng.normal([0, 1, 0], 0.3).tolist() for i in range(30)]
    df = spark.createDataFrame([(1, i, *(v or (None, None, None))) for i, v in enumerate(vectors)], "k int, i int, gx double, gy double, gz double")
    got = {r["i"]: r["delta_deg"] for r in T.rolling_delta(df, 4, ["k"], ["i"]).collect()}
    held = []
    for i, v in enumerate(vectors):
        if v is None or len(held) < 4:
            assert got[i] is None
        else:
            m = np.mean(held[-4:], axis=0)
            assert got[i] == pytest.approx(np.degrees(np.arccos(np.dot(v, m) / np.linalg.norm(v) / np.linalg.norm(m))))
        if v is not None:
            held.append(v)


def test_turning_the_mean_is_the_mean_of_turned_samples(spark):
    clean = frames(spark, window(accel=noisy))
    after, _ = I.inject(clean, "displacement", 4, "ankle")
    means = [C.window_means(blind(d)).where("node = 'ankle'").select(F.col("mx").alias("gx"), F.col("my").alias("gy"), F.col("mz").alias("gz"), "win").first() for d in (clean, after)]
    df = spark.createDataFrame([(1, 0, means[0]["gx"], means[0]["gy"], means[0]["gz"])], "k int, i int, gx double, gy double, gz double")
    turned = T.with_onset(df, ["k"], ["i"], "ankle", 90.0, prefix=0).first()
    assert [turned[c] for c in ("gx", "gy", "gz")] == pytest.approx([means[1][c] for c in ("gx", "gy", "gz")])


def test_recall_dies_when_the_baseline_catches_up(spark):
    rows = [(1, i, 1.0, 0.05 * ((i % 3) - 1), 0.05 * ((i * 7 % 5) - 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, gx double, gy double, gz double").withColumns({"gx": F.lit(0.1), "gy": F.lit(1.0) + F.col("gy")})
    moved = T.with_onset(df, ["k"], ["i"], "ankle", 90.0)
    hit = T.over_threshold(T.rolling_delta(moved, 5, ["k"], ["i"]), F.lit(8.0), node=F.lit("ankle"))
    r = T.recall_at(hit, ["k"], 5).first()
    assert r["recall_at_1"] == 1.0 and r["pooled_recall"] < 0.5 and r["mean_delta_sustained"] < r["mean_delta_first"]


def test_confusion_and_ties(spark):
    pairs = [("a", "b")] * 3 + [("a", "a")] * 5 + [("b", "c")] * 3 + [("c", "a")] * 2 + [("b", "a")]
    df = spark.createDataFrame(pairs, "true_label string, predicted_label string")
    top = [(r["true_label"], r["predicted_label"], r["n"]) for r in S.top_confused(df, ["c", "b", "a"]).collect()]
    assert top == [("b", "c", 3), ("a", "b", 3), ("c", "a", 2)]
    table = {r["true_label"]: r for r in S.class_confusion(df, ["a", "b", "c"]).collect()}
    assert table["a"]["b"] == 3 and table["c"]["c"] == 0
