"""Queries over the event stream as three-node samples (see ``sources.events``).

Floats are rounded to six decimals on both sides. The SQL is put together from the
steps in ``STEPS``, each a named common table expression on top of others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.samples import all_nan, any_nan, known
from ..operators import NODE_KEY, WINDOW_KEY
from ..operators import agent as Ag
from ..operators import answers as An
from ..operators import calibrate as C
from ..operators import diagnose as D
from ..operators import effects as X
from ..operators import features as Fe
from ..operators import inject as I
from ..operators import profile as P
from ..operators import sampling as Sa
from ..operators import score as S
from ..operators import segment as G
from ..operators import signals as Si
from ..operators import temporal as T
from ..operators.blind import blind
from ..tables import held, parts_of, shared_dir, written
from .rounding import near, near_sql, nudged, rounded
from ..sources.events import HOUR_US, SECOND_US, event_samples

GAP, WIDTH, BUCKET = 48 * HOUR_US, 240 * HOUR_US, 168 * HOUR_US
SHORT = 72 * HOUR_US
CELL = 24 * HOUR_US
TARGET = "ankle"
#: How fast the stream is taken to be: a "second" of a sensor is a day here.
DAY_US = 24 * HOUR_US
#: Samples that a task sorts. Each is in two windows, and three sorts of one stage hold it.
SAMPLES_A_PART = 250_000

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


STEPS: dict[str, str] = {
    "samples": """
  SELECT 'events' AS dataset, user_id AS subject, CAST(epoch_us(ts) AS DOUBLE) AS t, event_id AS ord, event_type AS activity,
    ['wrist', 'chest', 'ankle'][CAST(event_id % 3 + 1 AS INTEGER)] AS node,
    CASE WHEN lost THEN 'nan'::DOUBLE WHEN coarse THEN floor(value / 40.0) ELSE value / 50.0 END AS ax,
    CASE WHEN lost OR part THEN 'nan'::DOUBLE WHEN coarse THEN 0.0 ELSE k / 100.0 - 0.5 END AS ay,
    CASE WHEN lost THEN 'nan'::DOUBLE WHEN coarse THEN 0.5 ELSE (value - k) / 100.0 END AS az,
    CASE WHEN NOT gyro THEN NULL WHEN glost THEN 'nan'::DOUBLE ELSE k / 10.0 END AS gx,
    CASE WHEN NOT gyro THEN NULL WHEN glost THEN 'nan'::DOUBLE ELSE value / 10.0 END AS gy,
    CASE WHEN NOT gyro THEN NULL WHEN glost THEN 'nan'::DOUBLE ELSE 1.0::DOUBLE END AS gz,
    gyro AS has_gyro
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, user_id % 4 = 0 AS coarse, event_id % 11 = 0 AS lost,
      event_id % 13 = 0 AS part, event_id % 17 = 0 AS glost, event_id % 3 <> 1 AS gyro FROM events)""",
    "segmented": f"""
  SELECT *, sum(brk) OVER (PARTITION BY dataset, subject ORDER BY t, ord ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM (
    SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {GAP} THEN 1 ELSE 0 END AS brk FROM samples
    WINDOW w AS (PARTITION BY dataset, subject ORDER BY t, ord))""",
    "windows": f"""
  SELECT dataset, subject, seg, win, t0 + win * {WIDTH / 2} AS "start", t0 + win * {WIDTH / 2} + {WIDTH} AS "end" FROM (
    SELECT dataset, subject, seg, t0, t1, unnest(range(0, CAST(floor((t1 - t0 - {WIDTH}) / {WIDTH / 2}) AS BIGINT) + 1)) AS win FROM (
      SELECT dataset, subject, seg, min(t) AS t0, max(t) AS t1 FROM segmented GROUP BY ALL) WHERE t1 - t0 >= {WIDTH})""",
    "frames": """
  SELECT * EXCLUDE (ord, held), row_number() OVER (PARTITION BY dataset, subject, seg, win, node ORDER BY t, ord)::INTEGER AS idx FROM (
    SELECT s.dataset, s.subject, s.seg, w.win, w."start", w."end", s.node, s.t, s.ord, s.ax, s.ay, s.az, s.gx, s.gy, s.gz, s.has_gyro,
      count(*) OVER (PARTITION BY s.dataset, s.subject, s.seg, w.win) AS held
    FROM segmented s JOIN windows w ON s.dataset = w.dataset AND s.subject = w.subject AND s.seg = w.seg AND s.t >= w."start" AND s.t < w."end")
  WHERE held >= 5""",
    "marked": """
  SELECT *, CASE WHEN NOT miss THEN sum(CASE WHEN NOT miss THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, subject, seg, win, node, repeat_island) END AS repeat_run,
    sum(CASE WHEN miss THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, subject, seg, win, node, miss_island) AS miss_run
  FROM (SELECT *, sum(CASE WHEN NOT miss AND NOT dupe THEN 1 ELSE 0 END) OVER n AS repeat_island, sum(CASE WHEN NOT miss THEN 1 ELSE 0 END) OVER n AS miss_island,
      t - lag(t) OVER (PARTITION BY dataset, subject, seg, win, node ORDER BY idx) AS dt
    FROM (SELECT *, coalesce(vec = last_value(vec IGNORE NULLS) OVER (PARTITION BY dataset, subject, seg, win, node ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dupe
      FROM (SELECT *, CASE WHEN isnan(ax) OR isnan(ay) OR isnan(az) THEN NULL ELSE struct_pack(x := ax, y := ay, z := az) END AS vec, isnan(ax) OR isnan(ay) OR isnan(az) AS miss FROM frames))
    WINDOW n AS (PARTITION BY dataset, subject, seg, win, node ORDER BY idx ROWS UNBOUNDED PRECEDING))""",
    "aggregated": """
  SELECT dataset, subject, seg, win, node, min("start") AS "start", min("end") AS "end", min(t) AS first_t, count(*) AS n_frames, sum(miss::INT)::BIGINT AS n_missing,
    (count(*) - sum(miss::INT))::BIGINT AS n_valid, max(miss_run)::BIGINT AS nan_run_max, arg_max(miss, idx) AS nan_terminal,
    (max(idx) - coalesce(max(CASE WHEN NOT miss THEN idx END), 0))::BIGINT AS nan_trailing_run, count(DISTINCT vec) AS unique_values,
    coalesce(max(repeat_run), 0)::BIGINT AS max_repeat_run, sum(dupe::INT)::BIGINT AS n_dupes, coalesce(bool_and(dt > 0), true) AS timestamp_monotonic,
    avg(dt) AS dt_mean, stddev_pop(dt) AS dt_sd, var_pop(vec.x) AS vx, var_pop(vec.y) AS vy, var_pop(vec.z) AS vz, avg(vec.x) AS mx, avg(vec.y) AS my, avg(vec.z) AS mz,
    avg(sqrt(vec.x * vec.x + vec.y * vec.y + vec.z * vec.z)) AS mag_mean, stddev_pop(sqrt(vec.x * vec.x + vec.y * vec.y + vec.z * vec.z)) AS mag_sd,
    avg(((abs(vec.x) >= 15.84)::INT + (abs(vec.y) >= 15.84)::INT + (abs(vec.z) >= 15.84)::INT) / 3.0) AS loud, bool_or(has_gyro) AS gyro_available,
    avg(CASE WHEN has_gyro THEN (isnan(gx) OR isnan(gy) OR isnan(gz))::INT::DOUBLE END) AS gyro_nan_fraction,
    avg(CASE WHEN has_gyro AND NOT isnan(gx) THEN (abs(gx) + abs(gy) + abs(gz)) / 3.0 END) AS gyro_abs,
    count(CASE WHEN has_gyro AND NOT isnan(gx) THEN 1 END) AS gyro_n,
    sum(CASE WHEN has_gyro AND NOT isnan(gx) THEN gx + gy + gz END) AS gyro_sum, sum(CASE WHEN has_gyro AND NOT isnan(gx) THEN gx * gx + gy * gy + gz * gz END) AS gyro_sq
  FROM marked GROUP BY dataset, subject, seg, win, node""",
    "signals": f"""
  SELECT dataset, subject, seg, win, node, "start", "end", first_t, n_frames, n_missing, n_valid, n_missing / n_frames AS nan_fraction, nan_run_max, nan_terminal, nan_trailing_run,
    n_frames AS frames_expected, n_valid / n_frames AS frame_completeness, unique_values, CASE WHEN n_valid > 0 THEN unique_values / n_valid ELSE 0.0 END AS unique_value_ratio, max_repeat_run,
    n_dupes / greatest(1, n_valid - 1) AS repeat_fraction, unique_values / (("end" - "start") / {DAY_US}) AS effective_unique_rate_hz, timestamp_monotonic,
    CASE WHEN dt_mean > 0 THEN dt_sd / dt_mean ELSE 0.0 END AS inter_sample_interval_cv,
    CASE WHEN n_valid > 1 THEN vx ELSE 0.0 END AS var_x, CASE WHEN n_valid > 1 THEN vy ELSE 0.0 END AS var_y, CASE WHEN n_valid > 1 THEN vz ELSE 0.0 END AS var_z,
    CASE WHEN n_valid > 1 THEN vx + vy + vz ELSE 0.0 END AS total_variance, CASE WHEN n_valid > 1 THEN mag_mean ELSE 0.0 END AS mean_accel_magnitude_g,
    CASE WHEN n_valid > 1 THEN mag_mean BETWEEN 0.2 AND 8.0 ELSE false END AS magnitude_plausible, CASE WHEN n_valid > 1 THEN loud ELSE 0.0 END AS saturation_frac,
    CASE WHEN len > 1e-9 THEN mx / len END AS gravity_x, CASE WHEN len > 1e-9 THEN my / len END AS gravity_y, CASE WHEN len > 1e-9 THEN mz / len END AS gravity_z,
    coalesce(len, 0.0) AS gravity_magnitude_g, coalesce(1.0 / (1.0 + mag_sd), 0.0) AS gravity_stability, gyro_available,
    CASE WHEN gyro_available THEN gyro_nan_fraction END AS gyro_nan_fraction, CASE WHEN gyro_available THEN coalesce(gyro_abs, 0.0) END AS gyro_mean_abs_dps,
    CASE WHEN gyro_available THEN CASE WHEN gyro_n > 1 THEN gyro_sq / (3.0 * gyro_n) - (gyro_sum / (3.0 * gyro_n)) * (gyro_sum / (3.0 * gyro_n)) ELSE 0.0 END END AS gyro_variance
  FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS len FROM aggregated)""",
    "offsets": f"""
  SELECT *, CASE WHEN count(*) OVER w >= 2 THEN (first_t - median(first_t) OVER w) * {1000.0 / DAY_US} END AS cross_node_offset_ms FROM signals
  WINDOW w AS (PARTITION BY dataset, subject, seg, win)""",
    "scored": """
  SELECT *, least(1.0, greatest(0.0, 1.0 - nan_fraction)) AS completeness, CASE WHEN n_valid > 1 THEN least(1.0, greatest(0.0, 1.0 - repeat_fraction)) ELSE 1.0 END AS staleness,
    CASE WHEN NOT timestamp_monotonic THEN 0.0 WHEN inter_sample_interval_cv > 0.5 THEN least(1.0, greatest(0.0, 1.5 - inter_sample_interval_cv)) ELSE 1.0 END AS temporal,
    least(CASE WHEN NOT magnitude_plausible THEN 0.3 ELSE 1.0 END, CASE WHEN saturation_frac > 0.05 THEN least(1.0, greatest(0.0, 1.0 - saturation_frac)) ELSE 1.0 END,
      CASE WHEN n_valid > 1 AND total_variance < 1e-9 THEN 0.1 ELSE 1.0 END) AS sanity,
    CASE WHEN cross_node_offset_ms IS NOT NULL THEN least(1.0, greatest(0.0, 1.0 - greatest(0.0, abs(cross_node_offset_ms) - 25.0) / 200.0)) END AS synchrony
  FROM offsets""",
    "means": """
  SELECT dataset, subject, seg, win, node, min("start") AS "start", avg(ax) AS mx, avg(ay) AS my, avg(az) AS mz FROM frames
  WHERE NOT (isnan(ax) OR isnan(ay) OR isnan(az)) GROUP BY dataset, subject, seg, win, node""",
    "centres": """
  SELECT dataset, node, cx / len AS ref_x, cy / len AS ref_y, cz / len AS ref_z FROM (
    SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS len FROM (SELECT dataset, node, avg(mx) AS cx, avg(my) AS cy, avg(mz) AS cz FROM means GROUP BY dataset, node)) WHERE len > 1e-9""",
    "calibration": """
  SELECT c.dataset, c.node, any_value(ref_x) AS ref_x, any_value(ref_y) AS ref_y, any_value(ref_z) AS ref_z, count(angle) AS n_windows, avg(angle) AS mean_angle, quantile_cont(angle, 0.95) AS p95, max(angle) AS max_angle
  FROM centres c LEFT JOIN (SELECT m.dataset, m.node, degrees(acos(greatest(-1.0, least(1.0, (mx * ref_x + my * ref_y + mz * ref_z) / (sqrt(mx * mx + my * my + mz * mz) * sqrt(ref_x * ref_x + ref_y * ref_y + ref_z * ref_z)))))) AS angle
    FROM means m JOIN centres USING (dataset, node) WHERE sqrt(mx * mx + my * my + mz * mz) > 1e-9) a ON a.dataset = c.dataset AND a.node = c.node
  GROUP BY c.dataset, c.node""",
    "turned": """
  SELECT s.*, ref_x, ref_y, ref_z, p95, gravity_x IS NOT NULL AND ref_x IS NOT NULL AS there,
    degrees(acos(greatest(-1.0, least(1.0, (gravity_x * ref_x + gravity_y * ref_y + gravity_z * ref_z) / (sqrt(gravity_x * gravity_x + gravity_y * gravity_y + gravity_z * gravity_z) * sqrt(ref_x * ref_x + ref_y * ref_y + ref_z * ref_z)))))) AS angle,
    abs((CASE WHEN s.node = 'chest' THEN gravity_y ELSE gravity_x END) / sqrt(gravity_x * gravity_x + gravity_y * gravity_y + gravity_z * gravity_z)) AS alignment
  FROM scored s LEFT JOIN calibration c ON c.dataset = s.dataset AND c.node = s.node""",
    "observed": """
  SELECT *, greatest(4.0, 0.5 * degrees(acos(greatest(-1.0, least(1.0, pow(cos(phi), 2) + pow(sin(phi), 2) * cos(radians(15.0))))))) AS own
  FROM (SELECT *, acos(greatest(-1.0, least(1.0, alignment))) AS phi FROM turned)""",
    "judged": """
  SELECT *, CASE WHEN there THEN angle END AS angle_deg, CASE WHEN there THEN greatest(own, coalesce(p95, 0.0)) END AS threshold_deg,
    CASE WHEN there THEN angle > greatest(own, coalesce(p95, 0.0)) END AS exceeded, CASE WHEN there THEN coalesce(p95 > own, false) END AS swamped,
    CASE WHEN there THEN CASE WHEN alignment > 0.9 THEN 'low' WHEN alignment > 0.6 THEN 'medium' ELSE 'high' END END AS observability,
    CASE WHEN there THEN CASE WHEN angle > greatest(own, coalesce(p95, 0.0)) THEN 0.0 ELSE 1.0 END END AS placement
  FROM observed""",
    "least": """
  SELECT *, list_min(list_filter([completeness, staleness, temporal, sanity, synchrony, placement], lambda v: v IS NOT NULL)) AS min_sub_score,
    exp(list_avg(list_transform(list_filter([completeness, staleness, temporal, sanity, synchrony, placement], lambda v: v IS NOT NULL), lambda v: ln(greatest(v, 1e-9))))) AS geometric_mean_sub_score
  FROM judged""",
    "verdicts": """
  SELECT *, state <> 'HEALTHY' AS flagged, CAST(CASE state WHEN 'HEALTHY' THEN 1.0 WHEN 'DEGRADED' THEN 0.6 WHEN 'UNRELIABLE' THEN 0.25 ELSE 0.0 END AS DOUBLE) AS trust_weight FROM (
    SELECT *, CASE WHEN min_sub_score > 0.9 THEN 'HEALTHY' WHEN min_sub_score > 0.6 THEN 'DEGRADED' WHEN min_sub_score > 0.2 THEN 'UNRELIABLE' ELSE 'OFFLINE' END AS state,
      CASE WHEN nan_fraction > 0.02 AND nan_terminal AND nan_trailing_run / n_frames > 0.10 THEN 'dropout' WHEN nan_fraction > 0.02 THEN 'packet_loss'
        WHEN repeat_fraction >= 0.20 OR (unique_value_ratio < 0.75 AND max_repeat_run >= 3) THEN 'rate_degradation' WHEN abs(cross_node_offset_ms) > 25 THEN 'clock_desync'
        WHEN exceeded THEN 'displacement' ELSE 'healthy' END AS diagnosis
    FROM least)""",
}


def sql_with(*, last: str, steps: dict[str, str] | None = None, **own: str) -> str:
    """``last`` on top of the steps that it needs, in order; ``own`` are steps of this query alone."""
    every = STEPS | (steps or {}) | own
    return "WITH " + ",\n".join(f"{name} AS ({body}\n)" for name, body in every.items()) + f"\n{last}"


def r6(*names: str) -> str:
    return ", ".join(near_sql(n) + f" AS {n}" for n in names)


KEYS = "dataset, subject, seg, win"


def segmented(spark: SparkSession, sf_dir: str, by_activity: bool = False) -> DataFrame:
    return G.segments(event_samples(spark, sf_dir), GAP, BUCKET, by_activity=by_activity, parts=event_parts(spark, sf_dir))


def event_parts(spark: SparkSession, sf_dir: str) -> int:
    return parts_of(spark, f"{sf_dir}/events.parquet", SAMPLES_A_PART)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmented(spark, sf_dir)
    return G.frames(rows, G.sliding_windows(rows, WIDTH), CELL, least=5, parts=event_parts(spark, sf_dir))


def event_signals(spark: SparkSession, sf_dir: str, frames: DataFrame | None = None) -> DataFrame:
    return Si.window_signals(blind(frames if frames is not None else event_frames(spark, sf_dir)), per_second=DAY_US)


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = (f, nudged(sql))
        return f

    return add


# --- segmentation and windows -------------------------------------------------------------------


@query(
    "segment_islands",
    f"""
WITH b AS (
  SELECT user_id AS subject, epoch_us(ts)::DOUBLE AS t, event_id, event_type, lag(epoch_us(ts)::DOUBLE) OVER w AS pt, lag(event_type) OVER w AS pa
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), s AS (
  SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > {GAP} OR event_type <> pa THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM b
)
SELECT subject, seg, min(t) AS t0, max(t) AS t1, count(*) AS n, any_value(event_type) AS activity, max(t) - min(t) >= {24 * HOUR_US} AS long_enough FROM s GROUP BY subject, seg""",
)
def segment_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = G.segment_bounds(segmented(spark, sf_dir, by_activity=True))
    return bounds.select("subject", "seg", "t0", "t1", "n", "activity", (F.col("t1") - F.col("t0") >= 24 * HOUR_US).alias("long_enough"))


@query(
    "sliding_features",
    f"""
WITH s AS (
  SELECT user_id AS subject, epoch_us(ts)::DOUBLE AS t, value, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM (
    SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > {GAP} THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
), b AS (SELECT subject, seg, min(t) AS t0, max(t) AS t1 FROM s GROUP BY ALL),
w AS (SELECT subject, seg, win, t0 + win * {SHORT / 2} AS ws FROM (SELECT *, unnest(range(0, CAST(floor((t1 - t0 - {SHORT}) / {SHORT / 2}) AS BIGINT) + 1)) AS win FROM b WHERE t1 - t0 >= {SHORT}))
SELECT s.subject, s.seg, w.win, w.ws AS "start", count(*) AS n, NEAR(avg(value), 6) AS mean, NEAR(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, NEAR(avg(value * value), 6) AS energy
FROM s JOIN w ON s.subject = w.subject AND s.seg = w.seg AND t >= ws AND t < ws + {SHORT} GROUP BY ALL HAVING count(*) >= 5""",
)
def sliding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = events.select(F.lit("events").alias("dataset"), F.col("user_id").alias("subject"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), F.col("event_id").alias("ord"), F.col("event_type").alias("activity"), F.lit("all").alias("node"), "value")
    rows = G.segments(samples, GAP, BUCKET, by_activity=False)
    frames = G.frames(rows, G.sliding_windows(rows, SHORT), CELL, least=5)
    v = F.col("value")
    per = frames.groupBy("subject", "seg", "win", "start").agg(F.count(F.lit(1)).alias("n"), near(F.avg(v), 6).alias("mean"), near(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), near(F.avg(v * v), 6).alias("energy"))
    return per.select("subject", "seg", "win", "start", "n", "mean", "std", "min", "max", "energy")


@query(
    "window_start_accumulate",
    """
WITH RECURSIVE s AS (SELECT l_suppkey AS subject, 0.0::DOUBLE AS t0, count(*) / 50.0::DOUBLE AS t1 FROM lineitem GROUP BY l_suppkey),
w AS (
  SELECT subject, t1, 0::BIGINT AS win, t0 AS "start" FROM s WHERE t1 - t0 >= 2.56 AND t0 + 2.56 <= t1 + 1e-9
  UNION ALL SELECT subject, t1, win + 1, "start" + 1.28::DOUBLE FROM w WHERE ("start" + 1.28::DOUBLE) + 2.56 <= t1 + 1e-9
)
SELECT subject, win, "start", "start" <> win * 1.28::DOUBLE AS drifted FROM w""",
)
def window_start_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("subject")).agg((F.count(F.lit(1)) / 50.0).alias("t1"))
    starts = counts.where("t1 >= 2.56").select("subject", F.posexplode(G.window_starts(F.lit(0.0), F.col("t1"), 2.56, 1.28)).alias("win", "start"))
    return starts.select("subject", F.col("win").cast("long").alias("win"), "start", (F.col("start") != F.col("win") * F.lit(1.28)).alias("drifted"))


# --- signals ------------------------------------------------------------------------------------


def _signal_query(name: str, columns: tuple[str, ...], floats: tuple[str, ...], step: str = "signals") -> None:
    sql = sql_with(last=f"SELECT {KEYS}, node, " + ", ".join([*columns, r6(*floats)] if floats else columns) + f" FROM {step}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(event_signals(spark, sf_dir).select(*NODE_KEY, *columns, *floats))

    QUERIES[name] = (run, nudged(sql))


_signal_query("nan_signals", ("n_frames", "n_missing", "nan_run_max", "nan_terminal", "nan_trailing_run", "frames_expected"), ("nan_fraction", "frame_completeness"))
_signal_query("repeat_signals", ("unique_values", "max_repeat_run"), ("unique_value_ratio", "repeat_fraction", "effective_unique_rate_hz"))
_signal_query("interval_cv", ("timestamp_monotonic",), ("inter_sample_interval_cv",))
_signal_query("magnitude_gravity", ("magnitude_plausible",), ("var_x", "var_y", "var_z", "total_variance", "mean_accel_magnitude_g", "saturation_frac", "gravity_x", "gravity_y", "gravity_z", "gravity_magnitude_g", "gravity_stability"))
_signal_query("gyro_signals", ("gyro_available",), ("gyro_nan_fraction", "gyro_mean_abs_dps", "gyro_variance"))
_signal_query("cross_node_offset", (), ("cross_node_offset_ms",), "offsets")


def event_verdicts(spark: SparkSession, sf_dir: str, frames: DataFrame | None = None) -> DataFrame:
    signals = written(event_signals(spark, sf_dir, frames), "signals")  # read by the calibration and by the ladder
    clean = signals if frames is None else event_signals(spark, sf_dir)
    return D.diagnose(signals, C.references(C.calibrate_means(C.means_of_signals(clean), max_windows=None)))


@query("calibrate_gravity", sql_with(last=f"SELECT dataset, node, n_windows, {r6('ref_x', 'ref_y', 'ref_z', 'mean_angle', 'p95', 'max_angle')} FROM calibration"))
def calibrate_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(C.calibrate(blind(event_frames(spark, sf_dir)), max_windows=None))
    return out.select("dataset", "node", "n_windows", "ref_x", "ref_y", "ref_z", "mean_angle", "p95", "max_angle")


_SCORES = ("completeness", "staleness", "temporal", "sanity", "synchrony", "placement", "min_sub_score", "geometric_mean_sub_score")


@query("subscores_state", sql_with(last=f"SELECT {KEYS}, node, state, trust_weight, {r6(*_SCORES)} FROM verdicts"))
def subscores_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_verdicts(spark, sf_dir).select(*NODE_KEY, "state", "trust_weight", *_SCORES))


@query("diagnose_ladder", sql_with(last=f"SELECT {KEYS}, node, diagnosis, flagged, exceeded, swamped, observability, {r6('angle_deg', 'threshold_deg')} FROM verdicts"))
def diagnose_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(event_verdicts(spark, sf_dir).select(*NODE_KEY, "diagnosis", "flagged", "exceeded", "swamped", "observability", "angle_deg", "threshold_deg"))


@query(
    "network_state",
    sql_with(
        last=f"""SELECT {KEYS}, coalesce(string_agg(node, ',' ORDER BY node) FILTER (WHERE flagged), '') AS flagged_nodes, NEAR(min(min_sub_score), 6) AS worst_min, count(*) AS n_nodes,
  CASE WHEN min(min_sub_score) > 0.9 THEN 'HEALTHY' WHEN min(min_sub_score) > 0.6 THEN 'DEGRADED' WHEN min(min_sub_score) > 0.2 THEN 'UNRELIABLE' ELSE 'OFFLINE' END AS network_state
FROM verdicts GROUP BY {KEYS}"""
    ),
)
def network_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.network_state(event_verdicts(spark, sf_dir))
    return out.select(*WINDOW_KEY, F.array_join("flagged_nodes", ",").alias("flagged_nodes"), near("worst_min", 6).alias("worst_min"), "n_nodes", "network_state")


# --- failures -----------------------------------------------------------------------------------

_TARGET = f"SELECT * FROM frames WHERE node = '{TARGET}'"


@query(
    "inject_dropout",
    sql_with(
        last=f"""SELECT {KEYS}, count(*) AS n_frames, sum((isnan(ax) OR t >= "start" + 0.5 * ("end" - "start") - 1e-12)::INT)::BIGINT AS n_blanked, min("start" + 0.5 * ("end" - "start")) AS onset,
  sum(CASE WHEN gx IS NOT NULL AND (isnan(gx) OR t >= "start" + 0.5 * ("end" - "start") - 1e-12) THEN 1 ELSE 0 END)::BIGINT AS n_gyro_lost FROM ({_TARGET}) GROUP BY {KEYS}"""
    ),
)
def inject_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, truth = I.inject(event_frames(spark, sf_dir), "dropout", 2, TARGET)
    gone = frames.where(F.col("node") == TARGET).groupBy(*WINDOW_KEY).agg(F.count(F.lit(1)).alias("n_frames"), F.sum(F.isnan("ax").cast("long")).alias("n_blanked"), F.sum(F.coalesce(F.isnan("gx"), F.lit(False)).cast("long")).alias("n_gyro_lost"))
    return gone.join(truth.select(*WINDOW_KEY, F.col("realised")["onset"].alias("onset")), list(WINDOW_KEY))


@query("inject_desync", sql_with(last=f'SELECT {KEYS}, idx, t + {500.0 / 1000.0 * SECOND_US} + (t - min(t) OVER (PARTITION BY {KEYS})) * 0.0001 AS t FROM ({_TARGET})').replace("AS t FROM (SELECT", "AS t FROM (SELECT", 1))
def inject_desync(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = I.inject(event_frames(spark, sf_dir), I.ClockDesync(skew_ppm=100.0, per_second=SECOND_US), 3, TARGET)
    return frames.where(F.col("node") == TARGET).select(*WINDOW_KEY, "idx", "t")


@query(
    "inject_displacement",
    sql_with(
        turned_frames=f"""
  SELECT * EXCLUDE (ay, az, gy, gz), ay * cos(radians(45.0)) - az * sin(radians(45.0)) AS ay, ay * sin(radians(45.0)) + az * cos(radians(45.0)) AS az,
    gy * cos(radians(45.0)) - gz * sin(radians(45.0)) AS gy, gy * sin(radians(45.0)) + gz * cos(radians(45.0)) AS gz FROM ({_TARGET})""",
        pairs=f"""
  SELECT * FROM (SELECT {KEYS}, avg(CASE WHEN blank THEN NULL ELSE ax END) AS mx, avg(CASE WHEN blank THEN NULL ELSE ay END) AS my, avg(CASE WHEN blank THEN NULL ELSE az END) AS mz FROM (SELECT *, isnan(ax) AND isnan(ay) AND isnan(az) AS blank FROM ({_TARGET})) GROUP BY {KEYS})
  JOIN (SELECT {KEYS}, avg(CASE WHEN blank THEN NULL ELSE ax END) AS nx, avg(CASE WHEN blank THEN NULL ELSE ay END) AS ny, avg(CASE WHEN blank THEN NULL ELSE az END) AS nz FROM (SELECT *, isnan(ax) AND isnan(ay) AND isnan(az) AS blank FROM turned_frames) GROUP BY {KEYS}) USING ({KEYS})""",
        last=f"""SELECT {KEYS}, CASE WHEN isnan(mx * my * mz) THEN NULL ELSE NEAR(degrees(acos(greatest(-1.0, least(1.0, (mx * nx + my * ny + mz * nz) / (sqrt(mx * mx + my * my + mz * mz) * sqrt(nx * nx + ny * ny + nz * nz)))))), 6) + 0.0 END AS realised_angle_deg
FROM pairs""",
    ),
)
def inject_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, truth = I.inject(event_frames(spark, sf_dir), "displacement", 3, TARGET)
    turned = F.col("realised")["realised_angle_deg"]
    return truth.select(*WINDOW_KEY, F.when(~F.isnan(turned), near(turned, 6)).alias("realised_angle_deg"))


_LCG = "(((event_id + 1) * 1103515245 + 12345) % 2147483648) / 2147483648.0"


@query(
    "inject_packet_loss",
    f"""
WITH u AS (SELECT user_id AS subject, event_id, ts, {_LCG} AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
m AS (SELECT *, CASE WHEN i = 1 OR (u >= least(p, r) AND u < greatest(p, r)) THEN 1 ELSE 0 END AS reset,
    CASE WHEN i = 1 THEN (u < 0.30)::INT WHEN u >= least(p, r) AND u < greatest(p, r) THEN CASE WHEN p < r THEN 0 ELSE 1 END END AS val, CASE WHEN i > 1 AND u < least(p, r) THEN 1 ELSE 0 END AS flip
  FROM u, (SELECT 0.30 / ((1.0 - 0.30) * 6.0) AS p, 1.0 / 6.0 AS r)),
g AS (SELECT *, sum(reset) OVER (PARTITION BY subject ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM m),
l AS (SELECT *, (max(val) OVER (PARTITION BY subject, grp) + sum(flip) OVER (PARTITION BY subject, grp ORDER BY i ROWS UNBOUNDED PRECEDING)) % 2 AS lost FROM g),
b AS (SELECT *, CASE WHEN lost = 1 AND coalesce(lag(lost) OVER (PARTITION BY subject ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS begins FROM l)
SELECT subject, NEAR(avg(lost), 6) AS loss_rate, CASE WHEN sum(begins) > 0 THEN NEAR(sum(lost) / sum(begins), 6) ELSE 0.0 END AS mean_burst, sum(begins)::DOUBLE AS n_bursts FROM b GROUP BY subject""",
)
def inject_packet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("subject"), "event_id", "ts")
    u = F.pmod((F.col("event_id") + 1) * F.lit(1103515245).cast("long") + 12345, F.lit(2147483648)) / F.lit(2147483648.0)
    lost = I.bursty_loss(events, 0.30, 6.0, u, keys=("subject",), order=("ts", "event_id"))
    return rounded(I.burst_stats(lost, F.col("lost") == 1, keys=("subject",), order=("ts", "event_id")))


@query(
    "inject_rate_hold",
    f"""
WITH RECURSIVE f AS (SELECT user_id AS subject, epoch_us(ts)::DOUBLE AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events),
h AS (
  SELECT subject, idx, t, t AS last_t, value AS held, 1 AS fresh FROM f WHERE idx = 1
  UNION ALL
  SELECT f.subject, f.idx, f.t, CASE WHEN f.t - h.last_t >= {2 * DAY_US} - 1e-12 THEN f.t ELSE h.last_t END, CASE WHEN f.t - h.last_t >= {2 * DAY_US} - 1e-12 THEN f.value ELSE h.held END, CASE WHEN f.t - h.last_t >= {2 * DAY_US} - 1e-12 THEN 1 ELSE 0 END
  FROM h JOIN f ON f.subject = h.subject AND f.idx = h.idx + 1
)
SELECT subject, idx::INTEGER AS idx, held, fresh = 1 AS fresh FROM h""",
)
def inject_rate_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    whole = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.col("value")
    frames = events.select(*[F.lit("events" if c == "dataset" else "all").alias(c) for c in ("dataset", "node")], F.col("user_id").alias("subject"), F.lit(1).alias("seg"), F.lit(0).alias("win"), F.row_number().over(whole).alias("idx"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"), *[value.alias(c) for c in ("ax", "ay", "az")], *[F.lit(None).cast("double").alias(c) for c in ("gx", "gy", "gz")])
    return I.hold(frames, 2 * DAY_US).select("subject", "idx", F.col("held_ax").alias("held"), "fresh")


@query("severity_sweep", sql_with(last=f"SELECT {KEYS}, failure, severity, onset FROM (SELECT {KEYS}, failure, severity::INTEGER AS severity, \"start\" + (1.0 - [0.25, 0.5, 0.75, 1.0][severity]) * {WIDTH} AS onset FROM windows, (SELECT unnest(['dropout', 'clock_desync', 'packet_loss', 'rate_degradation', 'displacement']) AS failure), (SELECT unnest([1, 2, 3, 4]) AS severity))"))
def severity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = I.sweep(G.sliding_windows(segmented(spark, sf_dir), WIDTH))
    dropped = F.element_at(F.array(*[F.lit(x) for x in I.DROPPED_SHARE]), F.col("severity"))
    return windows.select(*WINDOW_KEY, "failure", "severity", (F.col("start") + (1.0 - dropped) * WIDTH).alias("onset"))


# --- scoring ------------------------------------------------------------------------------------

#: Every third window stays clean, the others get a dropout or an offset on the ankle; verdicts are taken as they are.
_ROWS_SQL = """
  SELECT v.*, failure, severity, failure IS NOT NULL AND node = 'ankle' AS is_target, CASE WHEN failure IS NOT NULL AND node = 'ankle' THEN failure ELSE 'healthy' END AS expected
  FROM (SELECT *, CASE (subject + win) % 3 WHEN 1 THEN 'dropout' WHEN 2 THEN 'clock_desync' END AS failure, CASE WHEN (subject + win) % 3 > 0 THEN (seg % 2 + 1)::INTEGER END AS severity FROM verdicts) v"""


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = event_verdicts(spark, sf_dir)
    turn = (F.col("subject") + F.col("win")) % 3
    truth = G.sliding_windows(segmented(spark, sf_dir), WIDTH).where(turn > 0).select(
        *WINDOW_KEY, F.lit(TARGET).alias("target_node"), F.when(turn == 1, "dropout").otherwise("clock_desync").alias("failure"), (F.col("seg") % 2 + 1).cast("int").alias("severity"),
        F.create_map(F.lit("onset"), F.col("start") + 0.5 * WIDTH).alias("realised"),
    )
    return S.tally(verdicts, truth)


@query(
    "detection_prf",
    sql_with(
        rows=_ROWS_SQL,
        counted="""
  SELECT failure AS true_failure, severity, sum((is_target AND flagged)::INT)::BIGINT AS tp, sum((NOT is_target AND flagged)::INT)::BIGINT AS fp, sum((is_target AND NOT flagged)::INT)::BIGINT AS fn
  FROM rows WHERE failure IS NOT NULL GROUP BY GROUPING SETS ((failure, severity), (failure))""",
        last="""SELECT *, NEAR(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, NEAR(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
  NEAR(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM counted""",
    ),
)
def detection_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.detection(scored_rows(spark, sf_dir)))


_DX = D.DIAGNOSES


@query(
    "diagnosis_confusion",
    sql_with(
        rows=_ROWS_SQL,
        last="SELECT e AS expected_diagnosis, " + ", ".join(f"count(*) FILTER (WHERE diagnosis = '{d}') AS {d}" for d in _DX) + f", count(diagnosis) AS n, NEAR(count(*) FILTER (WHERE diagnosis = e) / nullif(count(diagnosis), 0), 6) AS accuracy FROM (SELECT unnest({list(_DX)}) AS e) LEFT JOIN (SELECT * FROM rows WHERE is_target OR failure IS NULL) ON expected = e GROUP BY e",
    ),
)
def diagnosis_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.confusion(scored_rows(spark, sf_dir)))


@query("clean_fpr", sql_with(rows=_ROWS_SQL, last="SELECT node, count(*) AS n, coalesce(sum(flagged::INT), 0)::BIGINT AS fp, NEAR(coalesce(avg(flagged::INT), 0.0), 6) AS rate FROM rows WHERE failure IS NULL GROUP BY GROUPING SETS ((node), ())"))
def clean_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.false_positives(scored_rows(spark, sf_dir)))


@query(
    "detection_latency",
    sql_with(
        rows=_ROWS_SQL,
        onsets=f"""SELECT dataset, subject, failure AS true_failure, severity, node, min("start" + 0.5 * {WIDTH}) AS onset FROM rows WHERE is_target GROUP BY ALL""",
        last=f"""SELECT o.dataset, o.subject, o.true_failure, o.severity, o.node, o.onset, min(CASE WHEN r.flagged AND r."end" >= o.onset THEN r."end" END) AS detected_by,
  NEAR((min(CASE WHEN r.flagged AND r."end" >= o.onset THEN r."end" END) - o.onset) / {DAY_US}, 6) AS latency_sec
FROM onsets o JOIN rows r ON r.is_target AND r.subject = o.subject AND r.failure = o.true_failure AND r.severity = o.severity AND r.node = o.node GROUP BY o.dataset, o.subject, o.true_failure, o.severity, o.node, o.onset""",
    ),
)
def detection_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.detection_latency(scored_rows(spark, sf_dir), per_second=DAY_US))


@query("network_rollup", sql_with(last="SELECT dataset, subject, node, count(*) AS n, sum(flagged::INT)::BIGINT AS flagged, NEAR(avg(trust_weight), 6) AS mean_trust FROM verdicts GROUP BY ROLLUP (dataset, subject, node)"))
def network_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = event_verdicts(spark, sf_dir).rollup("dataset", "subject", "node").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("flagged").cast("long")).alias("flagged"), near(F.avg("trust_weight"), 6).alias("mean_trust"))
    return per


# --- temporal -----------------------------------------------------------------------------------

_STREAM = """
  SELECT dataset, subject, node, seg, win, CASE WHEN len > 1e-9 THEN mx / len END AS gx, CASE WHEN len > 1e-9 THEN my / len END AS gy, CASE WHEN len > 1e-9 THEN mz / len END AS gz
  FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS len FROM aggregated)"""


def gravity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_signals(spark, sf_dir)
    return s.select("dataset", "subject", "node", "seg", "win", *[F.col(f"gravity_{a}").alias(f"g{a}") for a in "xyz"])


def _angle_sql(a: str, b: str) -> str:
    dot = " + ".join(f"{a}{c} * {b}{c}" for c in "xyz")
    la, lb = (f"sqrt({v}x * {v}x + {v}y * {v}y + {v}z * {v}z)" for v in (a, b))
    return f"degrees(acos(greatest(-1.0, least(1.0, ({dot}) / ({la} * {lb})))))"


@query(
    "rolling_baseline",
    sql_with(
        stream=_STREAM,
        based="SELECT *, avg(gx) OVER w AS bx, avg(gy) OVER w AS by_, avg(gz) OVER w AS bz, count(gx) OVER w AS held FROM stream WHERE gx IS NOT NULL WINDOW w AS (PARTITION BY dataset, subject, node ORDER BY seg, win ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
        last=f"""SELECT dataset, subject, node, seg, win, CASE WHEN held = 3 AND sqrt(bx * bx + vy * vy + bz * bz) > 1e-9 THEN NEAR({_angle_sql('g', 'v')}, 4) + 0.0 END AS delta_deg FROM (SELECT *, bx AS vx, by_ AS vy, bz AS vz FROM based)
UNION ALL SELECT dataset, subject, node, seg, win, NULL FROM stream WHERE gx IS NULL""",
    ),
)
def rolling_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.rolling_delta(gravity_stream(spark, sf_dir), 3, ("dataset", "subject", "node"), ("seg", "win"))
    return rows.select("dataset", "subject", "node", "seg", "win", near("delta_deg", 4).alias("delta_deg"))


@query(
    "recall_at_k",
    sql_with(
        stream=_STREAM,
        placed="SELECT *, row_number() OVER (PARTITION BY dataset, subject, node ORDER BY seg, win) - 1 AS pos FROM stream WHERE node = 'ankle'",
        moved="SELECT * EXCLUDE (gy, gz), CASE WHEN pos >= 2 THEN gy * cos(radians(45.0)) - gz * sin(radians(45.0)) ELSE gy END AS gy, CASE WHEN pos >= 2 THEN gy * sin(radians(45.0)) + gz * cos(radians(45.0)) ELSE gz END AS gz FROM placed",
        based="SELECT *, avg(gx) OVER w AS vx, avg(gy) OVER w AS vy, avg(gz) OVER w AS vz, count(gx) OVER w AS held FROM moved WHERE gx IS NOT NULL WINDOW w AS (PARTITION BY dataset, subject, node ORDER BY seg, win ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)",
        deltas=f"SELECT *, CASE WHEN held = 2 AND sqrt(vx * vx + vy * vy + vz * vz) > 1e-9 THEN {_angle_sql('g', 'v')} END AS delta, acos(greatest(-1.0, least(1.0, abs(gx / sqrt(gx * gx + gy * gy + gz * gz))))) AS phi FROM based",
        hits="SELECT *, CASE WHEN delta IS NOT NULL THEN (delta > greatest(greatest(4.0, 0.5 * degrees(acos(greatest(-1.0, least(1.0, pow(cos(phi), 2) + pow(sin(phi), 2) * cos(radians(15.0))))))), 10.0))::INT END AS hit FROM deltas",
        last="""SELECT dataset, node, NEAR(coalesce(avg(hit) FILTER (WHERE pos - 2 < 1), 0.0), 6) AS recall_at_1, NEAR(coalesce(avg(hit) FILTER (WHERE pos - 2 < 2), 0.0), 6) AS recall_at_2,
  NEAR(coalesce(avg(hit), 0.0), 6) AS pooled_recall, count(hit) AS n_pooled, NEAR(avg(delta) FILTER (WHERE pos - 2 < 2), 4) AS mean_delta_first FROM hits WHERE pos >= 2 GROUP BY dataset, node""",
    ),
)
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = gravity_stream(spark, sf_dir).where(F.col("node") == TARGET)
    keys, order = ("dataset", "subject", "node"), ("seg", "win")
    rows = T.with_onset(stream, keys, order, TARGET, 45.0, prefix=2)
    rows = T.over_threshold(T.rolling_delta(rows, 2, keys, order), F.lit(10.0))
    out = T.recall_at(rows, ("dataset", "node"), 2, prefix=2, horizons=(1, 2))
    return out.select("dataset", "node", near("recall_at_1", 6).alias("recall_at_1"), near("recall_at_2", 6).alias("recall_at_2"), near("pooled_recall", 6).alias("pooled_recall"), "n_pooled", near("mean_delta_first", 4).alias("mean_delta_first"))


# --- features, samples, profiles ----------------------------------------------------------------


def _corr_sql(p: str, q: str) -> str:
    both = f"NOT isnan(a{p}) AND NOT isnan(a{q})"
    parts = ", ".join(f"{expr} FILTER (WHERE {both}) AS {p}{q}_{name}" for name, expr in (("n", "count(*)"), ("x", f"avg(a{p})"), ("y", f"avg(a{q})"), ("xx", f"avg(a{p} * a{p})"), ("yy", f"avg(a{q} * a{q})"), ("xy", f"avg(a{p} * a{q})")))
    return parts


def _corr_out(p: str, q: str) -> str:
    k = p + q
    sx, sy = f"sqrt(greatest({k}_xx - {k}_x * {k}_x, 0.0))", f"sqrt(greatest({k}_yy - {k}_y * {k}_y, 0.0))"
    return f"CASE WHEN has_data AND {k}_n >= 3 AND {sx} >= 1e-12 AND {sy} >= 1e-12 THEN NEAR(({k}_xy - {k}_x * {k}_y) / ({sx} * {sy}), 5) + 0.0 END AS corr_{k}"


def _ranges_sql(p: str, q: str) -> str:
    both = f"NOT isnan(a{p}) AND NOT isnan(a{q})"
    return f"coalesce(min(a{p}) FILTER (WHERE {both}) < max(a{p}) FILTER (WHERE {both}) AND min(a{q}) FILTER (WHERE {both}) < max(a{q}) FILTER (WHERE {both}), false) AND count(*) FILTER (WHERE {both}) >= 3 AS {p}{q}_varies"


_RANGES = ", ".join(_ranges_sql(p, q) for p, q in Fe.PAIRS)


_CORR = sql_with(
    sums=f"SELECT {KEYS}, node, avg((NOT (isnan(ax) OR isnan(ay) OR isnan(az)))::INT) >= 0.2 AS has_data, {_corr_sql('x', 'y')}, {_corr_sql('y', 'z')}, {_corr_sql('x', 'z')}, {_RANGES} FROM frames GROUP BY {KEYS}, node",
    last=f"SELECT {KEYS}, node, " + ", ".join(f"CASE WHEN {p}{q}_varies THEN corr_{p}{q} END AS corr_{p}{q}" for p, q in Fe.PAIRS) + f" FROM (SELECT *, {_corr_out('x', 'y')}, {_corr_out('y', 'z')}, {_corr_out('x', 'z')} FROM sums)",
)


@query("axis_corr", _CORR)
def axis_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every subject: a constant axis is told by its range, exactly, on both sides."""
    f = Fe.node_features(blind(event_frames(spark, sf_dir)))
    return f.select(*NODE_KEY, *[near(f"corr_{p}{q}", 5).alias(f"corr_{p}{q}") for p, q in Fe.PAIRS])


_STATS = ", ".join(
    f"NEAR(avg(CASE WHEN isnan(a{a}) THEN NULL ELSE a{a} END), 6) + 0.0 AS acc_{a}_mean, NEAR(stddev_pop(CASE WHEN isnan(a{a}) THEN NULL ELSE a{a} END), 6) + 0.0 AS acc_{a}_std, min(CASE WHEN isnan(a{a}) THEN NULL ELSE a{a} END) AS acc_{a}_min, max(CASE WHEN isnan(a{a}) THEN NULL ELSE a{a} END) AS acc_{a}_max, NEAR(avg(CASE WHEN isnan(a{a}) THEN NULL ELSE a{a} * a{a} END), 6) + 0.0 AS acc_{a}_energy"
    for a in "xyz"
)


@query("plain_features", sql_with(last=f"SELECT {KEYS}, node, count(*) AS n_frames, {_STATS} FROM frames GROUP BY {KEYS}, node"))
def plain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fe.plain_features(event_frames(spark, sf_dir))
    return f.select(*NODE_KEY, "n_frames", *[near(c, 6).alias(c) if c.endswith(("mean", "std", "energy")) else F.col(c) for c in f.columns if c.startswith("acc_")])


_VALID = "NOT (isnan(ax) OR isnan(ay) OR isnan(az))"
_MOTION = {
    "motions": f"""
  SELECT {KEYS}, node, avg(({_VALID})::INT) AS valid_fraction, count(*) AS n, (stddev_pop(ax) FILTER (WHERE {_VALID}) + stddev_pop(ay) FILTER (WHERE {_VALID}) + stddev_pop(az) FILTER (WHERE {_VALID})) / 3.0 AS motion FROM frames GROUP BY {KEYS}, node""",
}


@query(
    "motion_level",
    sql_with(
        **_MOTION,
        last=f"""SELECT {KEYS}, node, valid_fraction >= 0.2 AS has_data, CASE WHEN valid_fraction >= 0.2 THEN NEAR(motion, 6) END AS motion_sd_g,
  CASE WHEN valid_fraction >= 0.2 THEN CASE WHEN motion < 0.08 THEN 'still' WHEN motion < 0.35 THEN 'moderate' WHEN motion IS NOT NULL THEN 'vigorous' END END AS motion_level FROM motions""",
    ),
)
def motion_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Fe.node_features(blind(event_frames(spark, sf_dir)), as_summed=True)
    return f.select(*NODE_KEY, "has_data", near("motion_sd_g", 6).alias("motion_sd_g"), "motion_level")


def _steady(expr: str) -> str:
    return f"(round({expr}, {Fe.STEADY}) + 0.0)"


def _stat_sql(column: str, known_if: str, name: str) -> str:
    return ", ".join(f"{f}({column}) FILTER (WHERE {known_if}) AS {name}_{s}" for f, s in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max")))


def _pair_sql(p: str, q: str) -> str:
    both = f"NOT isnan(a{p}) AND NOT isnan(a{q})"
    return f"CASE WHEN count(*) FILTER (WHERE {both}) >= 3 AND min(a{p}) FILTER (WHERE {both}) < max(a{p}) FILTER (WHERE {both}) AND min(a{q}) FILTER (WHERE {both}) < max(a{q}) FILTER (WHERE {both}) THEN covar_pop(a{p}, a{q}) FILTER (WHERE {both}) / (stddev_pop(a{p}) FILTER (WHERE {both}) * stddev_pop(a{q}) FILTER (WHERE {both})) END AS corr_{p}{q}"


def _format_sql(pattern: str, *values: str) -> str:
    return f"format('{pattern}', {', '.join(_steady(v) for v in values)})"


_AXIS_LINES = ", ".join(f"CASE WHEN acc_{a}_mean IS NOT NULL THEN {_format_sql(a + ' mean {:+.2f} std {:.2f} min {:+.2f} max {:+.2f}', *[f'acc_{a}_{s}' for s in ('mean', 'std', 'min', 'max')])} END" for a in "xyz")
_GYRO_LINES = ", ".join(f"CASE WHEN gyro_{a}_mean IS NOT NULL THEN {_format_sql(a + ' mean {:+.1f} std {:.1f}', f'gyro_{a}_mean', f'gyro_{a}_std')} END" for a in "xyz")
_CORR_LINES = ", ".join(f"CASE WHEN corr_{p}{q} IS NOT NULL THEN {_format_sql(p + q + ' {:+.2f}', f'corr_{p}{q}')} END" for p, q in Fe.PAIRS)


@query(
    "render_features",
    sql_with(
        stats=f"""
  SELECT {KEYS}, node, 1.0 - avg(({_VALID})::INT) AS nf, avg(({_VALID})::INT) AS vf, bool_or(has_gyro) AS gyro, {', '.join(f'avg(a{a}) FILTER (WHERE {_VALID}) AS m{a}, stddev_pop(a{a}) FILTER (WHERE {_VALID}) AS s{a}' for a in 'xyz')},
    {', '.join(_stat_sql(f'a{a}', f'NOT isnan(a{a})', f'acc_{a}') for a in 'xyz')}, {', '.join(_stat_sql(f'g{a}', f'g{a} IS NOT NULL AND NOT isnan(g{a})', f'gyro_{a}') for a in 'xyz')}, {', '.join(_pair_sql(p, q) for p, q in Fe.PAIRS)} FROM frames GROUP BY {KEYS}, node""",
        texts=f"""
  SELECT *, rpad(node, 6, ' ') AS name, sqrt(mx * mx + my * my + mz * mz) AS len, (sx + sy + sz) / 3.0 AS motion, concat_ws(' | ', {_AXIS_LINES}) AS axes, concat_ws(' ', {_CORR_LINES}) AS corrs, concat_ws(' | ', {_GYRO_LINES}) AS rates FROM stats""",
        last=f"""SELECT {KEYS}, node, CASE WHEN vf < 0.2 THEN name || ' NO DATA -- node reported no usable data (' || {_format_sql('{:.0f}', '100 * nf')} || '% of samples missing)' ELSE concat_ws(chr(10),
    CASE WHEN len > 1e-9 THEN name || {_format_sql(' ORIENTATION ({:+.2f}, {:+.2f}, {:+.2f})  magnitude {:.2f} g', 'mx / len', 'my / len', 'mz / len', 'len')} ELSE name || ' ORIENTATION unavailable' END,
    CASE WHEN motion IS NOT NULL THEN {_format_sql('       MOTION      {:.3f} g  (', 'motion')} || CASE WHEN motion < 0.08 THEN 'still' WHEN motion < 0.35 THEN 'moderate' ELSE 'vigorous' END || ')' ELSE '       MOTION      unavailable' END,
    CASE WHEN {_steady('nf')} > 0.01 THEN {_format_sql('       MISSING     {:.0f}', '100 * nf')} || '% of samples absent' END,
    CASE WHEN axes <> '' THEN '       ACCEL       ' || axes END, CASE WHEN corrs <> '' THEN '       CORR        ' || corrs END,
    CASE WHEN rates <> '' THEN '       GYRO        ' || rates || ' (deg/s)' WHEN NOT gyro THEN '       GYRO        none on this node' END) END AS lines FROM texts""",
    ),
)
def render_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every node's rendering."""
    return Fe.node_features(blind(event_frames(spark, sf_dir)), as_summed=True).select(*NODE_KEY, Fe.render_node().alias("lines"))


_LABELS = ("lying", "sitting", "walking", "running")
_LETTERS = [chr(65 + i) for i in range(len(_LABELS))]
_TEMPLATE = "Activities:\n{legend}\n\n{query}\nAnswer:"


def digest_scorer(prompts: list[str]) -> list[str]:
    """A model without a network: each letter's log-probability is read off the prompt's digest, the last digit names no letter."""
    import hashlib
    import json

    out = []
    for p in prompts:
        digits = hashlib.md5(p.encode()).hexdigest()
        found = [{"token": f" {x}", "logprob": -ord(digits[i]) / 10} for i, x in enumerate(_LETTERS)] + [{"token": "The", "logprob": -ord(digits[-1]) / 10}]
        out.append(json.dumps({"choices": [{"logprobs": {"content": [{"top_logprobs": found}]}}]}))
    return out


_RENDER_SQL = QUERIES["render_features"][1]
_P_SQL = ", ".join(f"exp(l{i} - top) / total AS p{i}" for i in range(len(_LETTERS)))


@query(
    "score_windows",
    f"""
WITH lines AS ({_RENDER_SQL}),
texts AS (SELECT {KEYS}, string_agg(lines, chr(10) ORDER BY list_position(['wrist', 'chest', 'ankle'], node)) AS text FROM lines GROUP BY {KEYS}),
prompts AS (SELECT *, md5('Activities:' || chr(10) || '{Fe.legend(_LABELS)}' || chr(10) || chr(10) || text || chr(10) || 'Answer:') AS digest FROM texts),
logs AS (SELECT *, {', '.join(f"-ascii(substr(digest, {i + 1}, 1)) / 10.0::DOUBLE AS l{i}" for i in range(len(_LETTERS)))} FROM prompts),
tops AS (SELECT *, greatest({', '.join(f'l{i}' for i in range(len(_LETTERS)))}) AS top FROM logs),
totals AS (SELECT *, {' + '.join(f'exp(l{i} - top)' for i in range(len(_LETTERS)))} AS total FROM tops),
shares AS (SELECT *, {_P_SQL}, list_sort([{', '.join(f'l{i}' for i in range(len(_LETTERS)))}], 'DESC') AS ordered FROM totals)
SELECT {KEYS}, digest AS prompt_md5, CASE {' '.join(f"WHEN l{i} = top THEN '{x}'" for i, x in enumerate(_LETTERS))} END AS predicted, NEAR(1 / total, 6) AS max_p, NEAR(ordered[1] - ordered[2], 6) AS log_margin, NEAR(-({' + '.join(f'p{i} * ln(p{i})' for i in range(len(_LETTERS)))}), 6) AS entropy, 'logprob' AS confidence_method FROM shares""",
)
def score_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain from frames to a label: render, prompt, answers (kept as they come), distribution, confidence."""
    text = Fe.render(Fe.node_features(blind(event_frames(spark, sf_dir)), as_summed=True))
    prompts = text.select(*WINDOW_KEY, Fe.fill_prompt(_TEMPLATE, legend=Fe.legend(_LABELS), query=F.col("text")).alias("prompt"))
    store = held(f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}")
    rows = Ag.readouts(An.score_once(prompts, store, digest_scorer, "openai", "digest"), "openai", _LETTERS, "offline", "digest")
    return rows.select(*WINDOW_KEY, F.md5("prompt").alias("prompt_md5"), "predicted", *[near(c, 6).alias(c) for c in ("max_p", "log_margin", "entropy")], "confidence_method")


@query(
    "rank_median_window",
    sql_with(
        energies=f"""
  SELECT {KEYS}, coalesce(list_avg(list_filter([CASE WHEN count(*) FILTER (WHERE NOT isnan(ax)) > 1 THEN stddev_pop(ax) FILTER (WHERE NOT isnan(ax)) END, CASE WHEN count(*) FILTER (WHERE NOT isnan(ay)) > 1 THEN stddev_pop(ay) FILTER (WHERE NOT isnan(ay)) END,
    CASE WHEN count(*) FILTER (WHERE NOT isnan(az)) > 1 THEN stddev_pop(az) FILTER (WHERE NOT isnan(az)) END], lambda v: v IS NOT NULL)), 0.0) AS motion FROM frames WHERE node = 'wrist' GROUP BY {KEYS}""",
        last=f"SELECT {KEYS}, motion FROM (SELECT {KEYS}, NEAR(motion, 6) AS motion, row_number() OVER (PARTITION BY subject ORDER BY NEAR(motion, 6), seg, win) AS place, count(*) OVER (PARTITION BY subject) AS n_of FROM energies) WHERE place = n_of // 2 + 1",
    ),
)
def rank_median_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    motion = Fe.motion_energy(event_frames(spark, sf_dir).where(F.col("node") == "wrist"), WINDOW_KEY)
    return Sa.rank_median(motion.withColumn("motion", near("motion", 6)), ["subject"], "motion", ["seg", "win"])


@query(
    "stratified_sample",
    """
WITH k AS (SELECT event_id, user_id, event_type, (event_id * 7919 + 13) % 104729 AS lot FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY lot, event_id) AS turn FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY turn, user_id) AS place FROM t WHERE turn <= 20)
SELECT event_id, user_id, event_type FROM p WHERE place <= 20""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    classes = ["click", "error", "purchase", "signup", "view"]
    lot = (F.col("event_id") * 7919 + 13) % 104729
    return Sa.round_robin(events, 100, classes, 0, label="event_type", subject="user_id", identity=("event_id",), draw_by=lot)


@query(
    "profile_rollup",
    sql_with(
        last="""SELECT dataset, subject, activity, count(*) AS n_rows, min(t) AS first_t, max(t) AS last_t, sum((isnan(ax) OR isnan(ay) OR isnan(az))::INT)::BIGINT AS n_nan,
  NEAR(100.0 * avg((isnan(ax) OR isnan(ay) OR isnan(az))::INT), 6) AS pct_nan, grouping_id(dataset, subject, activity)::BIGINT AS level FROM samples GROUP BY ROLLUP (dataset, subject, activity)"""
    ),
)
def profile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rows_profile(event_samples(spark, sf_dir)).withColumn("pct_nan", near("pct_nan", 6))


@query("window_rollup", sql_with(last="SELECT dataset, subject, count(*) AS n_windows, grouping_id(dataset, subject)::BIGINT AS level FROM windows GROUP BY ROLLUP (dataset, subject)"))
def window_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.window_counts(G.sliding_windows(segmented(spark, sf_dir), WIDTH), ("dataset", "subject"))


@query("first_windows", sql_with(last='SELECT dataset, subject, seg, win, "start" FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seg, win) AS place FROM windows) WHERE place <= 2'))
def first_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two windows of each subject in stream order."""
    return Sa.first_n(G.sliding_windows(segmented(spark, sf_dir), WIDTH), 2, ["subject"], ["seg", "win"]).select(*WINDOW_KEY, "start")


@query(
    "paired_effect",
    sql_with(
        sides=f"""
  SELECT node, {KEYS}, avg(CASE WHEN NOT isnan(ax) THEN ax END) AS a, avg(CASE WHEN NOT isnan(ax) AND t < "start" + 0.5 * ("end" - "start") - 1e-12 THEN ax END) AS b FROM frames GROUP BY {KEYS}, node""",
        last="""SELECT node, n_pairs, NEAR(mean_delta, 6) AS mean_delta, NEAR(sd_delta, 6) AS sd_delta, n_increased, n_decreased,
  CASE WHEN n_pairs >= 3 AND sd_delta > 1e-12 THEN NEAR(mean_delta / sd_delta, 6) END AS cohens_d, CASE WHEN n_pairs >= 3 THEN NEAR(greatest(n_increased, n_decreased) / n_pairs, 6) END AS consistency
FROM (SELECT node, count(*) AS n_pairs, avg(b - a) AS mean_delta, stddev_pop(b - a) AS sd_delta, count(*) FILTER (WHERE b - a > 1e-9) AS n_increased, count(*) FILTER (WHERE b - a < -1e-9) AS n_decreased FROM sides WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY node)""",
    ),
)
def paired_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = event_frames(spark, sf_dir)
    late = F.col("t") >= F.col("start") + 0.5 * (F.col("end") - F.col("start")) - 1e-12
    mean = F.avg(known("ax"))
    a = clean.groupBy(*NODE_KEY).agg(mean.alias("v")).withColumn("condition", F.lit("clean"))
    b = clean.withColumns(I.blanked(late)).groupBy(*NODE_KEY).agg(mean.alias("v")).withColumn("condition", F.lit("dropout"))
    rows = a.unionByName(b).withColumn("v", F.round("v", 9))
    out = X.paired_effect(rows, WINDOW_KEY, "condition", "clean", "dropout", "v", keys=("node",))
    return rounded(out.drop("moves"))


@query(
    "blanked_samples",
    sql_with(last="SELECT node, count(*) AS n, sum((isnan(ax) AND isnan(ay) AND isnan(az))::INT)::BIGINT AS n_blank, sum((isnan(ax) OR isnan(ay) OR isnan(az))::INT)::BIGINT AS n_missing, count(gx) AS n_gyro FROM samples GROUP BY node"),
)
def blanked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(all_nan().cast("long")).alias("n_blank"), F.sum(any_nan().cast("long")).alias("n_missing"), F.count("gx").alias("n_gyro"))




# --- further breakdowns -------------------------------------------------------------------------


@query(
    "displacement_by_activity",
    sql_with(
        rows="""
  SELECT v.* EXCLUDE (alignment), CASE WHEN seg % 2 = 0 THEN 'even' ELSE 'odd' END AS activity, 10.0::DOUBLE * (win + 1) AS realised_magnitude, 1.0::DOUBLE / (win + 2) AS alignment FROM verdicts v WHERE node = 'ankle' AND (subject + win) % 3 = 1""",
        last="""SELECT node, activity, count(*) AS n, sum(flagged::INT)::BIGINT AS detected, sum((diagnosis = 'displacement')::INT)::BIGINT AS diagnosed, NEAR(avg(realised_magnitude), 6) AS mean_realised, NEAR(avg(alignment), 6) AS mean_alignment,
  NEAR(avg(flagged::INT), 6) AS recall, NEAR(avg((diagnosis = 'displacement')::INT), 6) AS diagnosis_accuracy, avg(flagged::INT) < 0.5 AS undetectable FROM rows GROUP BY node, activity""",
    ),
)
def displacement_by_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = event_verdicts(spark, sf_dir)
    windows = G.sliding_windows(segmented(spark, sf_dir), WIDTH)
    effects = F.create_map(F.lit("realised_angle_deg"), 10.0 * (F.col("win") + 1), F.lit("gravity_axis_alignment"), 1.0 / (F.col("win") + 2))
    truth = windows.where((F.col("subject") + F.col("win")) % 3 == 1).select(*WINDOW_KEY, F.lit(TARGET).alias("target_node"), F.lit("displacement").alias("failure"), F.lit(1).alias("severity"), effects.alias("realised"))
    labels = windows.select(*WINDOW_KEY, F.when(F.col("seg") % 2 == 0, "even").otherwise("odd").alias("label"))
    return rounded(S.displacement_by_activity(S.tally(verdicts, truth, labels)))


@query(
    "temporal_fpr",
    sql_with(
        stream=_STREAM,
        based="SELECT *, avg(gx) OVER w AS vx, avg(gy) OVER w AS vy, avg(gz) OVER w AS vz, count(gx) OVER w AS held FROM stream WHERE gx IS NOT NULL WINDOW w AS (PARTITION BY dataset, subject, node ORDER BY seg, win ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)",
        deltas=f"SELECT *, CASE WHEN held = 2 AND sqrt(vx * vx + vy * vy + vz * vz) > 1e-9 THEN {_angle_sql('g', 'v')} END AS delta, acos(greatest(-1.0, least(1.0, abs((CASE WHEN node = 'chest' THEN gy ELSE gx END) / sqrt(gx * gx + gy * gy + gz * gz))))) AS phi FROM based",
        hits="SELECT *, CASE WHEN delta IS NOT NULL THEN (delta > greatest(greatest(4.0, 0.5 * degrees(acos(greatest(-1.0, least(1.0, pow(cos(phi), 2) + pow(sin(phi), 2) * cos(radians(15.0))))))), 20.0))::INT END AS hit FROM deltas",
        last="SELECT node, count(hit) AS n, coalesce(sum(hit), 0)::BIGINT AS fp, NEAR(coalesce(avg(hit), 0.0), 6) AS rate FROM hits GROUP BY node",
    ),
)
def temporal_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.rolling_delta(gravity_stream(spark, sf_dir), 2, ("dataset", "subject", "node"), ("seg", "win"))
    return rounded(T.false_positive_rate(T.over_threshold(rows.where("gx is not null"), F.lit(20.0)), "node"))


_COUNT = sql_with(
    counts=f"""
  SELECT {KEYS}, node, avg(({_VALID})::INT) >= 0.2 AS has_data, bool_or(has_gyro) AS gyro, count(*) FILTER (WHERE NOT isnan(ax)) AS nx, count(*) FILTER (WHERE NOT isnan(ay)) AS ny, count(*) FILTER (WHERE NOT isnan(az)) AS nz,
    count(*) FILTER (WHERE has_gyro AND NOT isnan(gx)) AS ng, count(*) FILTER (WHERE {_VALID}) AS nv, {_RANGES} FROM frames GROUP BY {KEYS}, node""",
    last=f"""SELECT {KEYS}, sum(CASE WHEN has_data THEN 5 * ((nx > 0)::INT + (ny > 0)::INT + (nz > 0)::INT) + CASE WHEN gyro AND ng > 0 THEN 15 ELSE 0 END + CASE WHEN nv > 0 THEN 5 ELSE 0 END
  + xy_varies::INT + yz_varies::INT + xz_varies::INT ELSE 0 END)::BIGINT AS n_features FROM counts GROUP BY {KEYS}""",
)


@query("feature_count", _COUNT)
def feature_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature, correlations too."""
    return Fe.feature_count(Fe.node_features(blind(event_frames(spark, sf_dir))))


@query(
    "longest_missing_run",
    """
WITH i AS (SELECT user_id, event_id % 11 < 4 AS miss, sum(CASE WHEN event_id % 11 < 4 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT user_id, max(n)::BIGINT AS run FROM (SELECT user_id, island, sum(miss::INT) AS n FROM i GROUP BY user_id, island) GROUP BY user_id""",
)
def longest_missing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    return G.longest_run(events, F.col("event_id") % 11 < 4, ["user_id"], ["ts", "event_id"])


@query(
    "few_shot_pick",
    """
WITH k AS (SELECT event_id, user_id, event_type, (event_id * 104729 + 7) % 99991 AS lot FROM events WHERE event_type <> 'error')
SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY lot, event_id) AS place FROM k) WHERE place <= 2""",
)
def few_shot_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    return Sa.few_shot(events, 2, ["click", "purchase", "signup", "view"], 0, label="event_type", identity=("event_id",), draw_by=(F.col("event_id") * 104729 + 7) % 99991)


@query(
    "middle_of_run_pick",
    """
WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n_of FROM events),
t AS (SELECT *, ((place - n_of // 2) % n_of + n_of) % n_of AS turn FROM n)
SELECT event_id, event_type, pick::INTEGER AS pick FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY turn, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)) AS pick FROM t WHERE turn < 3) WHERE pick <= 12""",
)
def middle_of_run_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts")
    return Sa.middle_of_run(events, 12, ["click", "error", "purchase", "signup", "view"], label="event_type", order=("ts", "event_id")).select("event_id", "event_type", "pick")


# --- what the ladder saw, silent nodes, faults on faults, headroom -------------------------------

_SEEN = " UNION ALL ".join(f"SELECT '{dx}' AS diagnosis, unnest({list(names)}) AS name" for dx, names in D.EVIDENCE.items())


@query(
    "evidence_of_verdicts",
    sql_with(
        seen=_SEEN,
        every="""
  SELECT v.*, s.name, CASE s.name WHEN 'nan_fraction' THEN nan_fraction WHEN 'nan_trailing_run' THEN nan_trailing_run WHEN 'nan_run_max' THEN nan_run_max WHEN 'repeat_fraction' THEN repeat_fraction
    WHEN 'unique_value_ratio' THEN unique_value_ratio WHEN 'max_repeat_run' THEN max_repeat_run WHEN 'effective_unique_rate_hz' THEN effective_unique_rate_hz WHEN 'cross_node_offset_ms' THEN cross_node_offset_ms
    WHEN 'angle_deg' THEN angle_deg WHEN 'threshold_deg' THEN threshold_deg WHEN 'estimated_alignment' THEN CASE WHEN there THEN alignment END END AS value
  FROM verdicts v JOIN seen s ON s.diagnosis = v.diagnosis""",
        last=f"SELECT {KEYS}, node, diagnosis, name, {r6('value')} FROM every WHERE value IS NOT NULL",
    ),
)
def evidence_of_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = event_verdicts(spark, sf_dir).select(*NODE_KEY, "diagnosis", F.explode("evidence").alias("name", "value"))
    return rounded(seen)


_SHORT_WINDOWS = STEPS["windows"].replace(str(WIDTH), str(SHORT)).replace(str(WIDTH / 2), str(SHORT / 2))


@query(
    "silent_nodes",
    sql_with(
        steps={"windows": _SHORT_WINDOWS},
        expected=f"SELECT DISTINCT {KEYS}, unnest(['wrist', 'chest', 'ankle']) AS node FROM frames",
        last=f"SELECT e.dataset, e.subject, e.seg, e.win, e.node, coalesce(n_frames, 0) AS n_frames, NEAR(coalesce(completeness, 0.0), 6) AS completeness, NEAR(temporal, 6) AS temporal FROM expected e LEFT JOIN scored s ON s.dataset = e.dataset AND s.subject = e.subject AND s.seg = e.seg AND s.win = e.win AND s.node = e.node",
    ),
)
def silent_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nodes are expected in every short window; those that sent nothing have a row."""
    rows = segmented(spark, sf_dir)
    frames = written(G.frames(rows, G.sliding_windows(rows, SHORT), CELL, least=5), "short-frames")
    expected = frames.select(*WINDOW_KEY).distinct().withColumn("node", F.explode(F.array(*[F.lit(n) for n in ("wrist", "chest", "ankle")])))
    return rounded(Si.with_silent_nodes(Si.window_signals(blind(frames), per_second=DAY_US), expected).select(*NODE_KEY, "n_frames", "completeness", "temporal"))


@query(
    "injection_stack",
    sql_with(
        last=f"""SELECT {KEYS}, count(*) AS n_frames, sum((isnan(ax) OR t >= "start" + 0.75 * ("end" - "start") - 1e-12)::INT)::BIGINT AS n_blanked, min(t) + {0.2 * DAY_US} AS first_t, 'dropout:sev1,clock_desync:sev2,displacement:sev4' AS stack FROM ({_TARGET}) GROUP BY {KEYS}"""
    ),
)
def injection_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three faults on top of each other, and the tags of all in order."""
    first, a = I.inject(written(event_frames(spark, sf_dir), "stack-frames"), "dropout", 1, TARGET)
    second, b = I.inject(first, I.ClockDesync(per_second=DAY_US), 2, TARGET)
    third, c = I.inject(second, "displacement", 4, TARGET)
    per = third.where(F.col("node") == TARGET).groupBy(*WINDOW_KEY).agg(F.count(F.lit(1)).alias("n_frames"), F.sum(F.isnan("ax").cast("long")).alias("n_blanked"), F.min("t").alias("first_t"))
    return per.join(I.stacked(a, b, c).select(*WINDOW_KEY, F.array_join("injection_stack", ",").alias("stack")), list(WINDOW_KEY))


@query(
    "headroom",
    sql_with(
        sides=f"""
  SELECT node, {KEYS}, avg(CASE WHEN NOT isnan(ax) THEN ax END) AS a, avg(CASE WHEN NOT isnan(ax) AND t < "start" + 0.5 * ("end" - "start") - 1e-12 THEN ax END) AS b, min(CASE WHEN NOT isnan(az) THEN az END) AS p, min(CASE WHEN NOT isnan(az) AND t < "start" + 0.5 * ("end" - "start") - 1e-12 THEN az END) AS q FROM frames GROUP BY {KEYS}, node""",
        moved=" UNION ALL ".join(f"SELECT node, '{m}' AS measure, {y} - {x} AS d FROM (SELECT node, round({x}, 9) AS {x}, round({y}, 9) AS {y} FROM sides) WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for m, x, y in (("max_p", "a", "b"), ("log_margin", "p", "q"))),
        effects="SELECT node, measure, count(*) >= 3 AND stddev_pop(d) > 1e-12 AND coalesce(abs(avg(d) / nullif(stddev_pop(d), 0)) >= 0.5, false) AND greatest(count(*) FILTER (WHERE d > 0), count(*) FILTER (WHERE d < 0)) / count(*) >= 0.7 AS moves FROM moved GROUP BY node, measure",
        last="SELECT node, CASE WHEN bool_or(moves) FILTER (WHERE measure = 'max_p') THEN 'max_p_usable' WHEN bool_or(moves) FILTER (WHERE measure = 'log_margin') THEN 'use_log_margin' ELSE 'no_headroom' END AS verdict FROM effects GROUP BY node",
    ),
)
def headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a dropout moves either of two readouts (a mean and a minimum stand for them) consistently, a node."""
    clean = event_frames(spark, sf_dir)
    late = F.col("t") >= F.col("start") + 0.5 * (F.col("end") - F.col("start")) - 1e-12
    readouts = [F.round(F.avg(known("ax")), 9).alias("max_p"), F.round(F.min(known("az")), 9).alias("log_margin")]
    a = clean.groupBy(*NODE_KEY).agg(*readouts).withColumn("condition", F.lit("clean"))
    b = clean.withColumns(I.blanked(late)).groupBy(*NODE_KEY).agg(*readouts).withColumn("condition", F.lit("dropout"))
    rows = written(a.unionByName(b), "readouts")
    moves = [X.paired_effect(rows, WINDOW_KEY, "condition", "clean", "dropout", m, keys=("node",)).select("node", F.col("moves").alias(f"{m}_moves")) for m in ("max_p", "log_margin")]
    return moves[0].join(moves[1], "node").select("node", X.headroom_verdict(F.col("max_p_moves"), F.col("log_margin_moves")).alias("verdict"))
