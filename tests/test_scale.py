"""What must hold at any size: long windows and streams, exact ranks without gathering a group, retries."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.operators import agent as Ag
from kinelake.operators import calibrate as C
from kinelake.operators import inject as I
from kinelake.operators import sampling as Sa
from kinelake.operators import segment as G
from kinelake.tables import scratch, shared_dir, written


def test_starts_of_one_long_segment_are_added_up_and_quick(spark):
    n = 80_000
    end = spark.range(1).select(F.lit(2.56 + 1.28 * n).alias("t1"))
    starts = end.select(F.explode(G.window_starts(F.lit(0.0), F.col("t1"), 2.56, 1.28)).alias("s"))
    starts.count()
    began = time.perf_counter()
    got = np.array([r[0] for r in starts.collect()])
    assert time.perf_counter() - began < 3
    expected = np.add.accumulate(np.concatenate([[0.0], np.full(n + 5, 1.28)]))
    assert np.array_equal(got, expected[expected + 2.56 <= 2.56 + 1.28 * n + 1e-9])


@pytest.mark.parametrize("t1", [0.0, 2.55, 2.56, 2.56 + 1.28 * 255, 2.56 + 1.28 * 256, 2.56 + 1.28 * 257])
def test_starts_at_the_edges(spark, t1):
    got = spark.range(1).select(G.window_starts(F.lit(0.0), F.lit(t1), 2.56, 1.28).alias("s")).first()["s"]
    s, expected = 0.0, []
    while s + 2.56 <= t1 + 1e-9:
        expected.append(s)
        s += 1.28
    assert got == expected


def test_percentiles_are_exact_in_every_group(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.uniform(0, 180, 2000), "b": np.round(rng.uniform(0, 2, 999), 1), "one": np.array([4.25]), "same": np.full(500, 7.0), "two": np.array([1.0, 2.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    for share in (0.95, 0.5, 0.0, 1.0):
        got = {r["g"]: r["percentile"] for r in C.percentile_of(rows, ("g",), "v", share).collect()}
        assert got == {g: pytest.approx(float(np.percentile(v, 100 * share)), abs=1e-12) for g, v in groups.items()}
    assert C.percentile_of(rows.limit(0), ("g",), "v", 0.95).count() == 0


def test_places_in_a_group_that_is_dealt_over_ranges(spark):
    rows = spark.range(3000).select((F.col("id") % 7 == 0).cast("int").alias("g"), F.xxhash64("id").alias("o"), "id").repartition(6)
    got = Sa.numbered(rows, ["g"], ["o", "id"])
    assert got.columns == ["g", "o", "id", "at", "of"]
    for g in (0, 1):
        own = sorted((r["o"], r["id"], r["at"], r["of"]) for r in got.where(F.col("g") == g).collect())
        assert [r[2] for r in own] == list(range(len(own))) and {r[3] for r in own} == {len(own)}


def test_a_held_stream_may_be_one_long_window(spark):
    n = 30_000
    frames = spark.range(n).select(F.lit("d").alias("dataset"), F.lit(1).alias("subject"), F.lit(1).alias("seg"), F.lit(0).alias("win"), F.lit("n").alias("node"), (F.col("id") + 1).cast("int").alias("idx"), (F.col("id") + F.col("id") % 3 * 0.1).alias("t"), *[F.col("id").cast("double").alias(c) for c in ("ax", "ay", "az")], *[F.lit(None).cast("double").alias(c) for c in ("gx", "gy", "gz")])
    held = {r["idx"]: (r["held_ax"], r["fresh"]) for r in I.hold(frames.repartition(4), 2.5).select("idx", "held_ax", "fresh").collect()}
    last, value = -math.inf, None
    for i in range(n):
        t = i + i % 3 * 0.1
        fresh = t - last >= 2.5 - 1e-12
        if fresh:
            last, value = t, float(i)
        assert held[i + 1] == (value, fresh)


def test_tables_are_written_to_the_folder_that_is_named(spark):
    out = written(spark.range(5).toDF("x"), "probe")
    assert out.count() == 5 and all(f.startswith(shared_dir(spark)) for f in out.inputFiles())


def test_scratch_tables_go_and_others_stay(spark):
    import os

    before = written(spark.range(3).toDF("x"), "probe")
    with scratch(spark):
        inside = written(before, "probe")
        with scratch(spark):
            written(inside, "probe")
        folders = {os.path.dirname(f.removeprefix("file:").replace("//", "/")) for f in inside.inputFiles()}
        assert all(map(os.path.isdir, folders)) and inside.count() == 3
    assert not any(map(os.path.isdir, folders)) and before.count() == 3


def test_votes_waits_and_the_network():
    assert Ag.payload("anthropic", "m", "p", 5)["temperature"] == 0.7 and Ag.payload("openai", "m", "p", 5)["temperature"] == 0.0
    with pytest.raises(Ag.ScoringError, match="temperature"):
        Ag.payload("anthropic", "m", "p", 5, vote_temperature=0.0)
    answers = iter([(429, {"retry-after": "1"}, ""), ConnectionError("reset"), (503, {"Retry-After": "30"}, ""), (200, {}, "ok")])

    def send(body):
        a = next(answers)
        if isinstance(a, Exception):
            raise a
        return a

    waits = []
    assert Ag.post_with_retry(send, {}, waits.append) == "ok" and waits == [2.0, 4.0, 30.0]
    waits.clear()
    for status, text in ((408, ""), (204, ""), (302, ""), (429, "You EXCEEDED your current quota, see billing")):
        with pytest.raises(Ag.ScoringError):
            Ag.post_with_retry(lambda b, s=status, t=text: (s, {}, t), {}, waits.append)
    assert waits == []

    def unreachable(body):
        raise TimeoutError("too late")

    with pytest.raises(Ag.ScoringError, match="too late"):
        Ag.post_with_retry(unreachable, {}, waits.append)
    assert waits == [2.0, 4.0, 8.0, 16.0, 32.0]


def test_the_sender_posts_json_and_gives_refusals_back():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(body["status"])
            self.send_header("Retry-After", "3")
            self.end_headers()
            self.wfile.write(json.dumps({"key": self.headers["X-Key"]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    send = Ag.http_sender(f"http://127.0.0.1:{server.server_port}/", {"X-Key": "k"})
    try:
        assert send({"status": 200})[::2] == (200, '{"key": "k"}')
        status, headers, _ = send({"status": 429})
        assert status == 429 and headers["Retry-After"] == "3"
    finally:
        server.shutdown()


def test_what_a_task_sorts_of_windows_depends_on_the_samples_alone(spark, sf_dir, monkeypatch):
    from kinelake.plans import event_queries as Q

    columns = ("n_frames", "n_missing", "unique_values", "max_repeat_run", "first_t", "cross_node_offset_ms")
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    got = {}
    for parts in (4, 9):  # 4 cores, 4 partitions of a shuffle
        monkeypatch.setattr(Q, "SAMPLES_A_PART", -(-n // parts), raising=False)
        signals = Q.event_signals(spark, sf_dir)
        assert signals.rdd.getNumPartitions() == parts
        plan = signals._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange hashpartitioning" in line and "win#" in line and "REPARTITION_BY_NUM" not in line for line in plan.splitlines())
        got[parts] = sorted(signals.select("subject", "seg", "win", "node", *columns).collect())
    assert got[4] == got[9] and got[4]


@pytest.mark.parametrize("name", ["detection_prf", "diagnosis_confusion", "diagnose_ladder", "network_rollup", "displacement_by_activity", "evidence_of_verdicts"])
def test_a_whole_query_sorts_windows_in_partitions_by_the_samples(spark, sf_dir, monkeypatch, name):
    from kinelake.plans import event_queries as Q

    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    made, frames = [], G.frames

    def seen(*args, **kwargs):
        made.append(frames(*args, **kwargs))
        return made[-1]

    monkeypatch.setattr(G, "frames", seen)
    monkeypatch.setattr(Q, "SAMPLES_A_PART", -(-n // 9), raising=False)  # a shuffle has 4 partitions
    assert Q.QUERIES[name][0](spark, sf_dir).count()
    assert made and {f.rdd.getNumPartitions() for f in made} == {9}
