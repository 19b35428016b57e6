"""Nested JSON exports of windows, pairs and verdicts, and small text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import slug
from ..functions.samples import ACCEL, AXES, GYRO, known
from . import NODE_KEY, WINDOW_KEY


def _series(names: Sequence[str]) -> Column:
    """x, y, z as arrays in sample order, 5 decimals, NaN as null."""

    def axis(name: str) -> Column:
        return F.transform(F.col("s"), lambda r: F.round(known(r[name]), 5))

    return F.struct(*[axis(c).alias(a) for c, a in zip(names, AXES, strict=True)])


def node_payload(frames: DataFrame, relative: bool = True) -> DataFrame:
    """NODE_KEY, start, end, label and one struct a node: has_gyro, t (4 decimals), accel_g, gyro_dps (null for an absent gyroscope)."""
    extra = [c for c in ("label",) if c in frames.columns]
    per = frames.groupBy(*NODE_KEY).agg(F.first("start").alias("start"), F.first("end").alias("end"), *[F.first(c).alias(c) for c in extra], F.first("has_gyro").alias("has_gyro"), F.sort_array(F.collect_list(F.struct("idx", "t", *ACCEL, *GYRO))).alias("s"))
    origin = F.col("start") if relative else F.lit(0.0)
    times = F.transform(F.col("s"), lambda r: F.round(r["t"] - origin, 4))
    payload = F.struct(F.col("has_gyro"), times.alias("t"), _series(ACCEL).alias("accel_g"), F.when(F.col("has_gyro"), _series(GYRO)).alias("gyro_dps"))
    return per.select(*NODE_KEY, "start", "end", *extra, payload.alias("payload"))


def waveforms(frames: DataFrame) -> DataFrame:
    """WINDOW_KEY and a JSON text a window; nulls are written out."""
    per = node_payload(frames)
    nodes = per.groupBy(*WINDOW_KEY).agg(F.first("start").alias("start"), F.first("end").alias("end"), F.first("label").alias("label"), F.map_from_entries(F.collect_list(F.struct("node", "payload"))).alias("nodes"))
    body = F.struct("dataset", "subject", F.col("label").alias("activity"), F.round("start", 4).alias("start_sec"), F.round("end", 4).alias("end_sec"), "nodes")
    return nodes.select(*WINDOW_KEY, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def pairs(clean: DataFrame, injected: DataFrame, truth: DataFrame) -> DataFrame:
    """WINDOW_KEY, failure, severity, the truth, all clean nodes and, of the injected, the target alone."""
    before = node_payload(clean, relative=False).groupBy(*WINDOW_KEY).agg(F.first("start").alias("start"), F.first("end").alias("end"), F.collect_list(F.struct("node", "payload")).alias("clean"))
    after = node_payload(injected, relative=False).join(truth.select(*WINDOW_KEY, F.col("target_node").alias("node")), list(NODE_KEY), "left_semi")
    after = after.select(*WINDOW_KEY, F.struct("node", "payload").alias("injected"))
    return truth.join(before, list(WINDOW_KEY)).join(after, list(WINDOW_KEY))


def pair_documents(paired: DataFrame, levels: Sequence[str] = ("dataset", "subject", "activity")) -> DataFrame:
    """``pairs`` rows (and ``activity``) as documents for ``sources.documents``: the columns of ``levels``, file and json.

    A pair's file is named by its window, failure and severity.
    """
    name = F.format_string("%s_%s_%s_%d_%d_%s_sev%d.json", F.col("dataset"), F.col("subject").cast("string"), F.col("activity"), F.col("seg"), F.col("win"), F.col("failure"), F.col("severity"))
    nodes = F.map_from_entries(F.transform("clean", lambda r: F.struct(r["node"], r["payload"])))
    body = F.struct(
        "dataset", F.col("subject").cast("string").alias("subject"), "activity", "seg", "win", F.round("start", 4).alias("start_sec"), F.round("end", 4).alias("end_sec"),
        "failure", "severity", "target_node", "realised", nodes.alias("clean"), F.col("injected.payload").alias("injected"),
    )
    return paired.select(*[F.col(x).cast("string").alias(x) for x in levels], name.alias("file"), F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def slim_verdicts(verdicts: DataFrame) -> DataFrame:
    """The columns of a verdict that an export carries."""
    return verdicts.select(*NODE_KEY, "diagnosis", "rule", "state", "trust_weight", F.round("min_sub_score", 4).alias("min_sub_score"), F.transform_values("evidence", lambda k, v: F.round(v, 5)).alias("evidence"))


def manifest(files: DataFrame, levels: Sequence[str] = ("dataset", "subject", "activity"), name: str = "file") -> DataFrame:
    """One JSON text: dataset, then subject, then activity, then the sorted files. ``files`` is a listing, not data."""
    rows = files.groupBy(*levels).agg(F.sort_array(F.collect_list(name)).alias("v"))
    for i in reversed(range(len(levels))):
        rows = rows.groupBy(*levels[:i]).agg(F.map_from_entries(F.collect_list(F.struct(F.col(levels[i]), F.col("v")))).alias("v"))
    return rows.select(F.to_json("v").alias("json"))


def write_results(results: DataFrame, path: str) -> None:
    """Results by provider and model, folder names made safe; a provider's numbers are never mixed with another's."""
    named = results.withColumns({"provider": slug(F.col("provider")), "model": slug(F.col("model"))})
    named.write.partitionBy("provider", "model").mode("append").json(path)


def markdown_table(rows: DataFrame, headers: Sequence[str] | None = None, most: int = 1000) -> str:
    """A small result as a text table; refused beyond ``most`` rows."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows are no table")
    names = list(headers or rows.columns)

    def shown(v) -> str:
        return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)

    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(shown(v) for v in r) + " |" for r in found])
