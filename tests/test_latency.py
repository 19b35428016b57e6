import random

from kinelake.operators import score as S
from kinelake.plans import evaluation_queries as V
from kinelake.plans.event_queries import DAY_US, WIDTH
from kinelake.streaming.latency import KEYS, latency_stream

from .test_streaming import drained, stream_of

SCHEMA = "dataset string, subject long, true_failure string, severity int, node string, end double, onset double, flagged boolean, is_target boolean"


def shown(df):
    return sorted(((*[r[k] for k in KEYS], r["onset"], r["detected_by"], r["latency_sec"]) for r in df.collect()), key=repr)


def test_stream_gives_the_batchs_latencies_for_any_order_within_the_watermark(spark):
    rng = random.Random(5)
    rows = []
    for subject in range(12):
        for severity in (1, 2):
            for w in range(rng.randrange(1, 30)):
                start = w * 1.28
                rows.append(("d", subject, "dropout", severity, "ankle", start + 2.56, start + 2.56 * rng.choice([0.25, 0.5]), rng.random() < 0.15 and w > 4, True))
                rows.append(("d", subject, "dropout", severity, "wrist", start + 2.56, None, True, False))
    rows.sort(key=lambda r: r[5] + rng.random() * 4)
    want = shown(S.detection_latency(spark.createDataFrame(rows, SCHEMA)))
    last = ("end", 0, "dropout", 1, "ankle", 1e6, 1e6, False, True)
    got = [r for r in shown(drained(latency_stream(stream_of(spark, [*rows, last], SCHEMA, files=6), 2.56, 1e5, "5 seconds"), "latency")) if r[0] != "end"]
    assert got == want and any(r[6] is None for r in got) and any(r[6] for r in got)


def test_stream_equals_the_evaluations_query(spark, sf_dir):
    rows = V.evaluated(spark, sf_dir).where("is_target and onset is not null").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    want = shown(S.detection_latency(rows, per_second=DAY_US))
    rows = sorted((tuple(r) for r in rows.collect()), key=lambda r: r[5])
    last = (*rows[-1][:1], -1, *rows[-1][2:5], rows[-1][5] * 2, rows[-1][5] * 2, False, True)
    stream = stream_of(spark, [*rows, last], spark.createDataFrame([], SCHEMA).schema)
    got = [r for r in shown(drained(latency_stream(stream, WIDTH, WIDTH * 1000, "1 hour", ms_per_unit=1e-3, per_second=DAY_US), "evaluated_latency")) if r[1] != -1]
    assert got == want and len(got) > 5


def test_a_late_verdict_is_ignored_and_an_answer_is_given_once(spark):
    def row(end, onset, flagged):
        return ("d", 1, "dropout", 1, "ankle", float(end), float(onset), flagged, True)

    rows = [row(10, 9, False), row(12, 11, True), row(1000, 999, True), row(11, 9, True), row(3000, 2999, True), row(4000, 3999, True)]
    got = drained(latency_stream(stream_of(spark, rows, SCHEMA, files=6), 2.0, 500.0, "5 seconds"), "late").collect()
    assert [(r["onset"], r["detected_by"], r["latency_sec"]) for r in got] == [(9.0, 12.0, 3.0)]


def test_a_dropout_that_nothing_showed_is_what_the_sql_says(spark, monkeypatch):
    rows = [("d", 1, "dropout", 1, "ankle", 2.0 * DAY_US, 1.0 * DAY_US, False, True), ("d", 2, "dropout", 1, "ankle", 2.0 * DAY_US, 1.0 * DAY_US, True, True)]
    monkeypatch.setattr(V, "evaluated", lambda *_: spark.createDataFrame(rows, SCHEMA))
    got = {r["subject"]: (r["detected_by"], r["latency_sec"]) for r in V.eval_latency(spark, "").collect()}
    assert got == {1: (None, 0.0), 2: (2.0 * DAY_US, 1.0)}
