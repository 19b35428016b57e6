"""Pairs of clean and injected windows exported as files and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import WINDOW_KEY
from ..operators import export as E
from ..operators import features as Fe
from ..operators import inject as I
from ..operators import sampling as Sa
from ..operators import segment as G
from ..operators.blind import blind
from ..sources.documents import read_manifest, write_documents
from ..sources.results import WINDOW_JSON, read_pairs, waveform_frames
from ..tables import held, shared_dir, written
from .evaluation_queries import CONDITIONS, evaluation_sql, folded, strategies, unioned
from .event_queries import _VALID, CELL, TARGET, WIDTH, event_frames, segmented, sql_with
from .rounding import near, nudged

TRIALS = 32
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def exported_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each motion level the window of median motion (by the wrist), under every failure and severity: 20 documents a level."""
    rows = segmented(spark, sf_dir)
    frames = written(folded(G.frames(rows, G.sliding_windows(rows, WIDTH), CELL, least=5)), "export-frames")
    targets = frames.where(F.col("node") == TARGET).select(*WINDOW_KEY).distinct()
    motion = Fe.node_features(blind(frames.where("node = 'wrist'")), as_summed=True).where("motion_level is not null").select(*WINDOW_KEY, F.col("motion_level").alias("activity"), near("motion_sd_g", 6).alias("motion"))
    picked = written(Sa.rank_median(motion.join(targets, list(WINDOW_KEY)), ["activity"], "motion", ["subject", "seg", "win"]).drop("motion"), "export-picks")
    own = written(frames.join(picked.drop("activity"), list(WINDOW_KEY), "left_semi"), "export-windows")
    made, parts = strategies(), []
    for k, (failure, severity) in enumerate(CONDITIONS):
        if failure:
            numbered = own.withColumn("seg", F.col("seg") * TRIALS + k)
            after, truth = I.inject(numbered, made[failure], severity, TARGET, checked=False)
            parts.append(E.pairs(numbered, after, truth.select(*WINDOW_KEY, "target_node", "failure", "severity", "realised")))
    pairs = unioned(parts).withColumn("seg", F.floor(F.col("seg") / TRIALS)).join(picked, list(WINDOW_KEY))
    folder = held(f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}")
    write_documents(E.pair_documents(pairs, ("activity", "failure", "severity")), folder, ("activity", "failure", "severity"))
    listed = read_manifest(spark, folder) or {}
    counts = [(a, f, int(s), len(files)) for a, by_failure in listed.items() for f, by_severity in by_failure.items() for s, files in by_severity.items()]
    return read_pairs(spark, folder).join(F.broadcast(spark.createDataFrame(counts, "activity string, failure string, severity int, n_files int")), ["activity", "failure", "severity"])  # the manifest is a file listing


def export_pairs_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = exported_pairs(spark, sf_dir)
    x = F.col("injected.accel_g.x")
    before = F.col("clean")[TARGET]["accel_g"]["x"]
    known = lambda a: F.filter(a, lambda v: v.isNotNull())
    return pairs.select(
        "activity", "failure", "severity", F.col("subject").cast("long").alias("subject"), "seg", "win", F.size("clean").alias("n_nodes"), F.size(x).alias("n_samples"),
        (F.size(x) - F.size(known(x))).alias("n_lost"), (F.size(before) - F.size(known(before))).alias("n_lost_before"), near(F.array_max(known(x)), 3).alias("most_x"), near(F.array_max("injected.t") / 1e6, 2).alias("last_t"), "n_files",
    )


QUERIES["export_pairs_back"] = (
    export_pairs_back,
    nudged(evaluation_sql(
        levels=f"""
  SELECT dataset, subject, seg, win, round((stddev_pop(ax) FILTER (WHERE {_VALID}) + stddev_pop(ay) FILTER (WHERE {_VALID}) + stddev_pop(az) FILTER (WHERE {_VALID})) / 3.0 + 1.2345678912345e-9, 6) + 0.0 AS motion,
    (stddev_pop(ax) FILTER (WHERE {_VALID}) + stddev_pop(ay) FILTER (WHERE {_VALID}) + stddev_pop(az) FILTER (WHERE {_VALID})) / 3.0 AS sd FROM frames WHERE seg % {TRIALS} = 0 AND node = 'wrist' GROUP BY dataset, subject, seg, win HAVING avg(({_VALID})::INT) >= 0.2""",
        levelled=f"""
  SELECT *, CASE WHEN sd < 0.08 THEN 'still' WHEN sd < 0.35 THEN 'moderate' WHEN sd IS NOT NULL THEN 'vigorous' END AS activity FROM levels l WHERE EXISTS (SELECT 1 FROM frames f WHERE f.node = '{TARGET}' AND f.dataset = l.dataset AND f.subject = l.subject AND f.seg = l.seg AND f.win = l.win)""",
        picked="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY activity ORDER BY motion, subject, seg, win) AS place, count(*) OVER (PARTITION BY activity) AS n_of FROM levelled WHERE activity IS NOT NULL) WHERE place = n_of // 2 + 1",
        nodes="SELECT p.activity, p.dataset, p.subject, p.seg, p.win, count(DISTINCT f.node)::INTEGER AS n_nodes, count(*) FILTER (WHERE f.node = 'ankle' AND isnan(f.ax))::INTEGER AS n_lost_before FROM picked p JOIN frames f ON f.dataset = p.dataset AND f.subject = p.subject AND f.seg = p.seg AND f.win = p.win GROUP BY ALL",
        last=f"""SELECT n.activity, {list(I.FAILURE_TYPES)}[((f.seg % {TRIALS} - 1) // 4 + 1)::INT] AS failure, ((f.seg % {TRIALS} - 1) % 4 + 1)::INTEGER AS severity, n.subject, (n.seg // {TRIALS})::BIGINT AS seg, n.win, any_value(n_nodes) AS n_nodes, count(*)::INTEGER AS n_samples,
  count(*) FILTER (WHERE isnan(f.ax))::INTEGER AS n_lost, any_value(n_lost_before) AS n_lost_before, NEAR(max(round(f.ax, 5)) FILTER (WHERE NOT isnan(f.ax)), 3) AS most_x, NEAR(max(round(f.t, 4)) / 1e6, 2) AS last_t, 1 AS n_files
FROM nodes n JOIN frames f ON f.node = '{TARGET}' AND f.dataset = n.dataset AND f.subject = n.subject AND f.win = n.win AND f.seg % {TRIALS} > 0 AND f.seg - f.seg % {TRIALS} = n.seg GROUP BY n.activity, f.seg, n.subject, n.seg, n.win""",
    )),
)


def waveforms_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window as its JSON document and as frames again: samples, dropped ones and absent gyroscopes, a node."""
    frames = event_frames(spark, sf_dir).withColumn("label", F.lit("activity"))
    texts = E.waveforms(frames.withColumn("subject", F.col("subject").cast("string")))
    back = waveform_frames(texts.select("seg", "win", F.from_json("json", WINDOW_JSON).alias("w")).select("seg", "win", "w.*"))
    return back.groupBy("dataset", "subject", "seg", "win", "node").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("ax")).alias("n_lost"), F.count("gx").alias("n_gyro"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), near(F.sum(F.nanvl("ax", F.lit(None))), 4).alias("sum_x"), F.first("has_gyro").alias("has_gyro"),
    )


QUERIES["waveforms_back"] = (
    waveforms_back,
    nudged(sql_with(last="SELECT dataset, subject::VARCHAR AS subject, seg, win, node, count(*) AS n, count(*) FILTER (WHERE isnan(ax)) AS n_lost, count(gx) AS n_gyro, min(t) AS first_t, max(t) AS last_t, NEAR(sum(CASE WHEN NOT isnan(ax) THEN ax END), 4) AS sum_x, any_value(has_gyro) AS has_gyro FROM frames GROUP BY dataset, subject, seg, win, node")),
)
