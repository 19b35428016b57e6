import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.functions import confidence as Co
from kinelake.operators import agent as Ag
from kinelake.operators import diagnose as D
from kinelake.operators import effects as X
from kinelake.operators import export as E
from kinelake.operators import features as Fe
from kinelake.operators import sampling as Sa
from kinelake.operators.blind import blind

from .frames import NAN, frames, window


def test_features_are_numpys(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, (50, 3))
    a[7, 1] = np.nan
    rows = window(nodes=("wrist",), n=50, accel=lambda node, i: a[i])
    r = Fe.node_features(blind(frames(spark, rows))).first()
    for i, axis in enumerate("xyz"):
        v = a[:, i][~np.isnan(a[:, i])]
        assert [r[f"acc_{axis}_{s}"] for s in Fe.STATS] == pytest.approx([v.mean(), v.std(), v.min(), v.max(), (v**2).mean()])
    m = ~np.isnan(a[:, 1])
    assert r["corr_xy"] == pytest.approx(np.corrcoef(a[m, 0], a[m, 1])[0, 1]) and r["corr_xz"] == pytest.approx(np.corrcoef(a[:, 0], a[:, 2])[0, 1])
    v = a[m]
    assert r["magnitude_g"] == pytest.approx(np.linalg.norm(v.mean(0))) and r["motion_sd_g"] == pytest.approx(v.std(0).mean()) and r["motion_level"] == "vigorous"


def test_a_constant_axis_has_no_correlation_whatever_its_value(spark):
    for value in (0.1, 0.9, 0.3, 1234.567):
        rows = window(nodes=("wrist",), n=47, accel=lambda node, i, value=value: (i / 7, value, (i % 5) / 3))
        r = Fe.node_features(blind(frames(spark, rows))).first()
        assert r["corr_xy"] is None and r["corr_yz"] is None and r["corr_xz"] is not None


def test_absent_things_stay_absent(spark):
    flat = lambda node, i: (0.0, 1.0, 0.0) if node != "ankle" or i < 15 else (NAN, NAN, NAN)
    f = Fe.node_features(blind(frames(spark, window(accel=flat))))
    by = {r["node"]: r for r in f.collect()}
    assert by["wrist"]["corr_xy"] is None and by["chest"]["gyro_x_mean"] is None and by["wrist"]["motion_level"] == "still"
    assert not by["ankle"]["has_data"] and by["ankle"]["acc_x_mean"] is None
    text = Fe.render(f).first()["text"].split("\n")
    assert text[0] == "wrist  ORIENTATION (+0.00, +1.00, +0.00)  magnitude 1.00 g"
    assert text[1] == "       MOTION      0.000 g  (still)"
    assert "       GYRO        none on this node" in text
    assert text[-1].startswith("ankle  NO DATA -- node reported no usable data (85% of samples missing)")
    assert not any("CORR" in line for line in text)
    n = Fe.feature_count(f).first()["n_features"]
    assert n == (15 + 15 + 3 + 2) + (15 + 3 + 2)


@pytest.mark.parametrize("value,shown", [(0.625, "+0.62"), (-0.001, "-0.00"), (-0.125, "-0.12"), (0.375, "+0.38"), (2.5, "+2.50")])
def test_numbers_are_written_to_even(spark, value, shown):
    got = spark.range(1).select(Fe.fixed(F.lit(value), 2, "+").alias("s")).first()["s"]
    assert got == shown == f"{value:+.2f}"


def test_prompt_and_legend(spark):
    assert Fe.legend(["lying", "sitting"]) == "A = lying\nB = sitting"
    assert spark.range(1).select(Fe.fill_prompt("{a}-{b}-{a}", a="x", b=F.lit("y")).alias("p")).first()["p"] == "x-y-x"


FIXTURE = {"D": -0.223, "E": -1.897, "F": -3.100, "C": -4.050, "B": -5.200, "A": -6.010}


def test_distribution_of_known_candidates(spark):
    labels = list("ABCDEF")
    out = Ag.readouts(spark.createDataFrame([(Ag.offline(FIXTURE)(["p"])[0],)], "response string"), "openai", labels, "p", "m").first()
    p = {k: np.exp(v) for k, v in FIXTURE.items()}
    assert out["predicted"] == "D" and out["log_margin"] == pytest.approx(1.674)
    assert out["max_p"] == pytest.approx(0.783984, abs=1e-6)
    assert sum(r["p"] for r in out["distribution"]) == pytest.approx(1.0)
    q = np.array(list(p.values())) / sum(p.values())
    assert out["entropy"] == pytest.approx(-(q * np.log(q)).sum()) and out["confidence_method"] == "logprob"


def test_token_variants_merge_and_absent_labels_are_zero(spark):
    c = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(v).alias("logprob")) for t, v in ((" a", -1.0), ("▁A", -2.0), ("B\n", -1.5), ("zebra", -0.1))])
    lp = Co.label_logprobs(c, ["A", "B", "C"])
    r = spark.range(1).select(Co.distribution(lp).alias("d"), Co.log_margin(lp).alias("m")).first()
    a, b = np.exp(-1) + np.exp(-2), np.exp(-1.5)
    assert [x["p"] for x in r["d"]] == pytest.approx([a / (a + b), b / (a + b), 0.0]) and r["m"] == pytest.approx(np.log(a) + 1.5)


def test_prose_is_refused(spark):
    bad = spark.createDataFrame([(Ag.offline({"The": -0.1})(["p"])[0],)], "response string")
    with pytest.raises(Exception, match="no label"):
        Ag.readouts(bad, "openai", ["A"], "p", "m").collect()
    for style in ("openai", "vllm", "llamacpp", "ollama_native", "gemini"):
        with pytest.raises(Exception, match="the response has no"):
            Ag.readouts(spark.createDataFrame([('{"choices": []}',)], "response string"), style, ["A"], "p", "m").collect()


BODIES = {
    "llamacpp": '{"completion_probabilities":[{"probs":[{"tok_str":"A","prob":0.5},{"tok_str":"B","logprob":-2.0}]}]}',
    "vllm": '{"choices":[{"logprobs":{"top_logprobs":[null,{"A":-0.6931471805599453,"B":-2.0}]}}]}',
    "ollama_native": '{"logprobs":[{"top_logprobs":[{"token":"A","logprob":-0.6931471805599453},{"token":"B","logprob":-2.0},{"token":"C"}]}]}',
    "gemini": '{"candidates":[{"logprobsResult":{"topCandidates":[{"candidates":[{"token":"A","logProbability":-0.6931471805599453},{"token":"B","logProbability":-2.0}]}]}}]}',
}


@pytest.mark.parametrize("style", BODIES)
def test_every_service_gives_the_same_distribution(spark, style):
    r = Ag.readouts(spark.createDataFrame([(BODIES[style],)], "response string"), style, ["A", "B"], "p", "m").first()
    assert r["predicted"] == "A" and r["max_p"] == pytest.approx(0.5 / (0.5 + np.exp(-2)))


def test_votes(spark):
    answers = ["D"] * 7 + [" e"] * 2 + ["A.", "nothing"]
    rows = spark.createDataFrame([(1, '{"content":[{"type":"text","text":"' + a + '"}]}') for a in answers], "k int, response string")
    r = Ag.sampled_readouts(rows, ["k"], list("ABCDE"), "p", "m").first()
    assert [x["p"] for x in r["distribution"]] == pytest.approx([0.1, 0, 0, 0.7, 0.2]) and r["log_margin"] is None
    assert r["probability_resolution"] == pytest.approx(0.1) and r["confidence_method"] == "self_consistency"


def test_requests_retries_and_backends():
    assert Ag.payload("openai", "m", "p", 50)["top_logprobs"] == 20 and Ag.payload("llamacpp", "m", "p", 50)["n_probs"] == 50
    waits, answers = [], iter([(429, {}, ""), (503, {"Retry-After": "7"}, ""), (200, {}, "ok")])
    assert Ag.post_with_retry(lambda b: next(answers), {}, waits.append) == "ok" and waits == [2.0, 7.0]
    for status, text in ((400, ""), (429, "insufficient_quota")):
        with pytest.raises(Ag.ScoringError):
            Ag.post_with_retry(lambda b, s=status, t=text: (s, {}, t), {}, waits.append)
    with pytest.raises(Ag.ScoringError):
        Ag.post_with_retry(lambda b: (500, {}, ""), {}, waits.append)
    assert Ag.resolve_backend({"backend": "openai"}, None, {"LLM_PROVIDER": "vllm"}) == ["vllm"]
    assert Ag.resolve_backend({"backend": "auto", "fallback_order": ["a", "b"]}, None, {}) == ["a", "b"]
    with pytest.raises(Ag.ScoringError):
        Ag.resolve_backend({"require_logprobs": True}, "anthropic", {})
    with pytest.raises(Ag.ScoringError):
        Ag.payload("smoke signals", "m", "p", 5)


def test_agent_run(spark):
    df = blind(frames(spark, window()))
    out = Ag.run(df, D.no_references(df), "L:\n{legend}\n{few_shot}\n{query}", ["lying", "sitting"], Ag.offline({"A": -0.1, "B": -2.0})).first()
    assert out["predicted"] == "A" and "A = lying" in out["prompt"] and "HEALTH" in out["prompt"] and out["flags"] == Ag.FLAGS
    assert set(out["health_states"]) == {"wrist", "chest", "ankle"}


def test_paired_effects(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, 30), rng.normal(0.4, 1, 30)
    rows = [(i, "c", float(x)) for i, x in enumerate(a)] + [(i, "d", float(x)) for i, x in enumerate(b[:25])] + [(99, "d", None)]
    r = X.paired_effect(spark.createDataFrame(rows, "w int, cond string, v double"), ["w"], "cond", "c", "d", "v").first()
    d = b[:25] - a[:25]
    assert r["n_pairs"] == 25 and r["cohens_d"] == pytest.approx(d.mean() / d.std()) and r["consistency"] == pytest.approx(max((d > 0).sum(), (d < 0).sum()) / 25)
    two = X.paired_effect(spark.createDataFrame(rows[:2] + rows[30:32], "w int, cond string, v double"), ["w"], "cond", "c", "d", "v").first()
    assert two["cohens_d"] is None and not two["moves"]
    got = spark.range(1).select(*[X.headroom_verdict(F.lit(p), F.lit(q)) for p, q in ((True, True), (False, True), (False, False))]).first()
    assert list(got) == ["max_p_usable", "use_log_margin", "no_headroom"]


def test_samples(spark):
    rows = [(c, s, i) for c in "ab" for s in range(3) for i in range({0: 1, 1: 5, 2: 9}[s])] + [("z", 0, 0)]
    df = spark.createDataFrame(rows, "label string, subject int, win int")
    got = Sa.round_robin(df, 16, ["a", "b"], 3, identity=("win",)).collect()
    per = {}
    for r in got:
        per.setdefault((r["label"], r["subject"]), []).append(r["win"])
    assert {k: len(v) for k, v in per.items()} == {(c, s): n for c in "ab" for s, n in ((0, 1), (1, 4), (2, 3))}
    assert Sa.few_shot(df, 2, ["a", "b"], 1, identity=("subject", "win")).count() == 4
    with pytest.raises(Sa.SubjectOverlapError):
        Sa.require_disjoint(df, df)
    Sa.require_disjoint(df.where("subject = 1"), df.where("subject = 2"))
    mid = Sa.rank_median(spark.createDataFrame([("k", float(v), v) for v in (5, 1, 9, 3)], "k string, m double, i int"), ["k"], "m", ["i"]).first()
    assert mid["m"] == 5.0
    part = Sa.middle_excerpt(spark.range(1000).withColumn("k", F.lit(1)), ["k"], ["id"], 256)
    ids = sorted(r["id"] for r in part.collect())
    assert ids[0] == 372 and len(ids) == 128 and ids[1] - ids[0] == 2
    picks = Sa.middle_of_run(df.withColumn("seg", F.lit(0)), 5, ["a", "b"]).orderBy("pick").collect()
    assert [r["label"] for r in picks] == ["a", "b", "a", "b", "a"] and picks[0]["win"] == 1


def test_exports(spark, tmp_path):
    import json

    rows = window(n=3, accel=lambda node, i: (NAN, NAN, NAN) if i == 1 else (0.123456789, 1.0, 2.0))
    df = frames(spark, rows).withColumn("label", F.lit("walking"))
    made = json.loads(E.waveforms(df).first()["json"])
    node = made["nodes"]["chest"]
    assert node["gyro_dps"] is None and node["accel_g"]["x"] == [0.12346, None, 0.12346] and node["t"] == [0.0, 0.01, 0.02]
    tree = json.loads(E.manifest(spark.createDataFrame([("d", "s1", "w", "f2"), ("d", "s1", "w", "f1"), ("d", "s2", "r", "f3")], "dataset string, subject string, activity string, file string")).first()["json"])
    assert tree == {"d": {"s1": {"w": ["f1", "f2"]}, "s2": {"r": ["f3"]}}}
    E.write_results(spark.createDataFrame([("Some Co.", "m/1", 0.5)], "provider string, model string, v double"), str(tmp_path / "r"))
    assert (tmp_path / "r" / "provider=Some-Co." / "model=m-1").is_dir()
    assert E.markdown_table(spark.createDataFrame([(1, 0.5, None)], "a int, b double, c string")) == "| a | b | c |\n|---|---|---|\n| 1 | 0.5000 |  |"
    from kinelake.operators import inject as I

    after, truth = I.inject(df.drop("label"), "dropout", 4, "ankle")
    pair = E.pairs(df.drop("label"), after, truth).first()
    assert len(pair["clean"]) == 3 and pair["injected"]["node"] == "ankle" and pair["injected"]["payload"]["accel_g"]["x"] == [None] * 3


def test_exported_windows_read_back(spark, tmp_path):
    import json

    from kinelake.sources.results import few_shot_examples, overlay, read_result, read_waveforms

    doc = {"dataset": "d", "subject": "s", "activity": "walking", "start_sec": 2.0, "end_sec": 2.02, "nodes": {"chest": {"has_gyro": False, "t": [0.0, 0.01], "accel_g": {"x": [1.0, None], "y": [0.0, None], "z": [0.5, None]}, "gyro_dps": None}}}
    (tmp_path / "w.json").write_text(json.dumps(doc, indent=1))
    rows = read_waveforms(spark, str(tmp_path / "w.json")).orderBy("idx").collect()
    assert rows[0]["ax"] == 1.0 and rows[0]["t"] == 2.0 and np.isnan(rows[1]["ax"]) and rows[1]["gx"] is None and not rows[1]["has_gyro"]
    assert read_result(spark, str(tmp_path / "none.json")) is None and read_result(spark, str(tmp_path / "w.json")).first()["activity"] == "walking"
    assert overlay({"a": 1, "b": 2}, {"X": " 9 ", "Y": " "}, {"a": "X", "b": "Y"}) == {"a": "9", "b": 2}
    assert few_shot_examples(spark, {"examples": [{"activity": "lying", "letter": "A", "subject": "s", "start_sec": 1, "features": "f"}]}).count() == 1


def test_fixed_is_what_c_prints(spark):
    rng = random.Random(12)
    values = [rng.uniform(-20, 20) * 10 ** rng.randrange(-4, 3) for _ in range(100_000)] + [k / 1000 for k in range(-6000, 6000)] + [k / 8 for k in range(-400, 400)] + [0.085, 0.575, 1.005, -0.004, -0.0, 0.5, 1.5, 2.5, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(8)
    rows = df.select("i", *[Fe.fixed(F.col("v"), d, s).alias(f"f{d}{'p' if s else ''}") for d in (0, 1, 2, 3) for s in ("", "+")]).collect()
    for r in rows:
        v = values[r["i"]]
        for d in (0, 1, 2, 3):
            assert r[f"f{d}"] == f"{v:.{d}f}" and r[f"f{d}p"] == f"{v:+.{d}f}", (v, d)


def test_noise_of_a_sum_turns_neither_ties_nor_signs(spark):
    rows = spark.createDataFrame([(0.085, 1), (0.085 + 1e-15, 1), (0.085 - 1e-15, 1), (1e-17, 2), (-1e-17, 2), (0.0, 2)], "v double, k int")
    got = rows.groupBy("k").agg(F.collect_set(Fe.fixed(Fe.steady(F.col("v")), 2, "+")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {1: ["+0.09"], 2: ["+0.00"]}


def test_correlation_of_small_motion_on_a_large_mean(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1e-4, 60)
    rows = window(n=60, accel=lambda node, i: (1000.0 + float(x[i]), 1000.0 + float(x[i]) * 2, -500.0 - float(x[i])))
    f = Fe.node_features(blind(frames(spark, rows))).where("node = 'wrist'").first()
    assert f["corr_xy"] == pytest.approx(1.0, abs=1e-6) and f["corr_xz"] == pytest.approx(-1.0, abs=1e-6)


def test_a_motion_on_the_edge_of_a_band_is_not_below_it(spark):
    def deviation(values):
        mean = m2 = 0.0
        for n, v in enumerate(values, 1):
            mean, d = mean + (v - mean) / n, v - mean
            m2 += d * (v - mean)
        return (m2 / len(values)) ** 0.5

    # Two samples whose deviations are 0.16, 0.02 and 0.06, which a sum of doubles puts on either side of 0.08 * 3.
    pairs = [((a, b, c), (a + 0.32, b + 0.04, c + 0.12)) for a in (0.0, 0.1, 0.7, 2.3) for b in (0.03, 0.17, 0.9) for c in (0.01, 0.23, 1.1)]
    below = [p for p in pairs if sum(map(deviation, zip(*p, strict=True))) / 3.0 < Fe.STILL]
    rows = [r for w, p in enumerate(pairs) for r in window(nodes=("wrist",), n=2, win=w, start=float(w), accel=lambda _, i, p=p: p[i])]
    levels = {r["motion_level"] for r in Fe.node_features(blind(frames(spark, rows))).collect()}
    assert 0 < len(below) < len(pairs) and levels == {"moderate"}


def test_a_pairs_level_by_its_doubles_hangs_on_no_order(spark):
    def deviation(a, b):
        return ((b - (a + (b - a) / 2)) * (b - a) / 2) ** 0.5

    # As above, with a third sample that is lost, between, before or after the two.
    pairs = [((a, b, c), (a + 0.32, b + 0.04, c + 0.12)) for a in (0.0, 0.1, 0.7, 2.3) for b in (0.03, 0.17, 0.9) for c in (0.01, 0.23, 1.1)]
    below = [sum(deviation(x, y) for x, y in zip(*p, strict=True)) / 3.0 < Fe.STILL for p in pairs]
    found = set()
    for order in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (2, 1, 0)):
        rows = [r for w, p in enumerate(pairs) for r in window(nodes=("wrist",), n=3, win=w, start=float(w), accel=lambda _, i, p=p, order=order: (*p, (NAN, 0.5, 9.0))[order[i]])]
        levels = Fe.node_features(blind(frames(spark, rows)), as_summed=True).orderBy("win").collect()
        found.add(tuple(r["motion_level"] == "still" for r in levels))
    assert found == {tuple(below)} and 0 < sum(below) < len(below)


def test_a_formatted_number_names_its_argument_once(spark):
    plan = spark.range(1).select(Fe.fixed(F.col("id") / F.lit(7.0), 2, "+").alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("cast(id") == 1
