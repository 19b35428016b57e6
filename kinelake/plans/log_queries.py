"""Raw logs written from the event stream and read back.

Three files a dataset, one for each residue of the user; each is read in at least four ranges.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from ..sources import logs as L
from ..sources.raw import DatasetReplay
from ..tables import held, shared_dir
from .rounding import near, near_sql, nudged

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}

_TYPES = ("click", "error", "purchase", "signup", "view")
#: The first subject's number, as the datasets count theirs.
_FIRST = {"pamap2": 101, "mhealth": 1}
_GRAVITY = 9.80665


def _place_of(dataset: str) -> dict[int, str]:
    """Cells with a meaning of their own, in SQL over (t, value, k, event_id, event_type)."""
    label = f"array_position(array({', '.join(repr(t) for t in _TYPES)}), event_type)"
    lost = "event_id % 11 = 0"
    if dataset == "pamap2":
        return {0: "t", 1: f"double({label})", 2: "if(event_id % 9 = 0, 60 + k, double('NaN'))", L.LAYOUTS[dataset].accel["wrist"]: f"if({lost}, double('NaN'), value)"}
    return {L.LAYOUTS[dataset].label: f"double({label})", L.LAYOUTS[dataset].accel["wrist"]: f"if({lost}, double('NaN'), value)"}


def log_rows(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    """subject, t, event_id and the cells of a line; a cell is the event's value and, as often as its place says, its k."""
    own = _place_of(dataset)
    cells = ", ".join(own.get(i, f"value + {i} * k") for i in range(L.LAYOUTS[dataset].width))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.concat(F.lit("subject"), (_FIRST[dataset] + F.col("user_id") % 3).cast("string")).alias("subject"), "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    return events.select("subject", "t", "event_id", F.expr(f"array({cells})").alias("cells"))


def read_back(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    path = held(f"{shared_dir(spark)}/logs-{dataset}-{uuid.uuid4().hex}")
    L.write_logs(log_rows(spark, sf_dir, dataset), dataset, path, ["t", "event_id"])
    rows = L.read_logs(spark, dataset, path, leastSplits=4)
    return rows.select("subject", "t", "activity", *[near(c, 6).alias(c) for c, kind in rows.dtypes if kind == "double" and c != "t"])


def _sql(dataset: str) -> str:
    layout = L.LAYOUTS[dataset]
    accel = layout.accel["wrist"]
    columns = []
    for name, place, kind in layout.columns():
        cell = "CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END" if place == accel else f"value + {place} * k"
        cell = f"({cell}) / {_GRAVITY}" if kind == "acc" else f"degrees({cell})" if kind == "gyr" and not layout.gyro_in_degrees else cell
        columns.append(f"{near_sql(cell)} AS {name}")
    if layout.clock is not None:
        extra = [f"CASE WHEN event_id % 9 = 0 THEN {near_sql('60 + k')} END AS heart_rate"]
    else:
        extra = [f"{near_sql(f'value + {i} * k')} AS ecg_lead{n}" for n, i in enumerate(L.raw.MHEALTH_ECG, 1)]
    t = "epoch_us(ts) / 1e6" if layout.clock is not None else f"(row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1) / {layout.rate_hz}"
    return nudged(f"""
SELECT 'subject' || ({_FIRST[dataset]} + user_id % 3) AS subject, ({t})::DOUBLE AS t, list_position({list(_TYPES)}, event_type)::INTEGER AS activity, {', '.join(extra + columns)}
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)""")


def read_pamap2_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(spark, sf_dir, "pamap2")


def read_mhealth_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(spark, sf_dir, "mhealth")


QUERIES["read_pamap2_back"] = (read_pamap2_back, _sql("pamap2"))
QUERIES["read_mhealth_back"] = (read_mhealth_back, _sql("mhealth"))


#: Rows of a stretch with one activity, and of one without a gap; the stretches' activities, of which two have a label.
_ACTIVITY_ROWS, _GAP_ROWS, _STRETCHES = 700, 450, (4, 0, 5, 24)


def replay_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a replayed dataset: events on a 100 Hz clock, with gaps, dropped samples, and activities without a label."""
    rows = log_rows(spark, sf_dir, "pamap2").withColumnRenamed("t", "ts")
    placed = numbered(rows, ["subject"], ["ts", "event_id"]).withColumn("i", F.col("at"))
    activity = F.element_at(F.array(*[F.lit(float(a)) for a in _STRETCHES]), (F.floor(F.col("i") / _ACTIVITY_ROWS) % len(_STRETCHES) + 1).cast("int"))
    cells = F.concat(F.array(F.col("i") / F.lit(100.0) + F.floor(F.col("i") / _GAP_ROWS) * F.lit(0.5), activity), F.slice("cells", 3, L.LAYOUTS["pamap2"].width - 2))
    path = held(f"{shared_dir(spark)}/logs-replay-{uuid.uuid4().hex}")
    L.write_logs(placed.select("subject", "i", cells.alias("cells")), "pamap2", path, ["i"])
    windows, _ = DatasetReplay(spark, "pamap2", path).windows()
    return windows.select("dataset", "subject", "seg", "win", "start", "end", "label", "n_samples")


QUERIES["replay_windows"] = (
    replay_windows,
    f"""
WITH RECURSIVE placed AS (SELECT *, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) - 1 AS i FROM events),
logged AS (SELECT 'subject' || ({_FIRST['pamap2']} + user_id % 3) AS subject, i / 100.0::DOUBLE + (i // {_GAP_ROWS}) * 0.5::DOUBLE AS t, {list(_STRETCHES)}[(i // {_ACTIVITY_ROWS}) % {len(_STRETCHES)} + 1] AS activity, event_id FROM placed),
usable AS (SELECT * FROM logged WHERE activity IN (4, 5) AND event_id % 11 <> 0),
marked AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 0.1 OR activity <> lag(activity) OVER w THEN 1 ELSE 0 END AS brk FROM usable WINDOW w AS (PARTITION BY subject ORDER BY t)),
segmented AS (SELECT *, sum(brk) OVER (PARTITION BY subject ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM marked),
bounds AS (SELECT subject, seg, min(t) AS t0, max(t) AS t1, any_value(activity) AS activity FROM segmented GROUP BY subject, seg),
found AS (
  SELECT subject, seg, activity, t1, 0::BIGINT AS win, t0 AS "start" FROM bounds WHERE t1 - t0 >= 2.56 AND t0 + 2.56 <= t1 + 1e-9
  UNION ALL SELECT subject, seg, activity, t1, win + 1, "start" + 1.28::DOUBLE FROM found WHERE ("start" + 1.28::DOUBLE) + 2.56 <= t1 + 1e-9
)
SELECT 'pamap2' AS dataset, f.subject, f.seg, f.win, f."start", f."start" + 2.56::DOUBLE AS "end", CASE f.activity WHEN 4 THEN 'walking' ELSE 'running' END AS label, count(*) AS n_samples
FROM found f JOIN segmented s ON s.subject = f.subject AND s.seg = f.seg AND s.t >= f."start" AND s.t < f."start" + 2.56::DOUBLE GROUP BY f.subject, f.seg, f.win, f."start", f.activity HAVING count(*) >= 154""",
)
