"""Readers of the two public sensor datasets' raw logs, as samples.

Both files are split freely: rows of the first carry their time; rows of the
second have none, and get it from their place in the file, which is the number of
rows in the splits before plus the place in the own split, so that no file need be
read by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.samples import AXES, NAN, STANDARD_GRAVITY, known
from ..labels import id_map

# The files' layouts and rates.
PAMAP2_COLUMNS, PAMAP2_RATE_HZ = 54, 100.0
PAMAP2_BLOCK = {"wrist": 3, "chest": 20, "ankle": 37}
PAMAP2_ACCEL, PAMAP2_GYRO, PAMAP2_MAG = 1, 7, 10
MHEALTH_COLUMNS, MHEALTH_RATE_HZ, MHEALTH_LABEL = 24, 50.0, 23
MHEALTH_ACCEL = {"chest": 0, "ankle": 5, "wrist": 14}
MHEALTH_GYRO = {"chest": None, "ankle": 8, "wrist": 17}
MHEALTH_MAG = {"chest": None, "ankle": 11, "wrist": 20}
MHEALTH_ECG = (3, 4)
NODES = ("wrist", "chest", "ankle")
CHANNELS = {
    "pamap2": {n: ("accel", "gyro", "mag") for n in NODES},
    "mhealth": {"wrist": ("accel", "gyro", "mag"), "chest": ("accel", "ecg"), "ankle": ("accel", "gyro", "mag")},
}


class SourceError(ValueError):
    """No files, unknown subjects or a file of another layout."""


def _stem(name: Column) -> Column:
    return F.regexp_extract(name, r"(subject\d+)", 1)


def subjects(spark: SparkSession, path: str, dataset: str) -> list[str]:
    """Subjects with a file in ``path``; by name for the first dataset, by number for the second."""
    pattern = {"pamap2": "subject*.dat", "mhealth": "mHealth_subject*.log"}[dataset]
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(_stem(F.col("path")).alias("s"))  # names only, no contents
    names = [r["s"] for r in listed.distinct().collect()]
    return sorted(names) if dataset == "pamap2" else sorted(names, key=lambda s: int(s.removeprefix("subject")))


def choose_subjects(available: Sequence[str], wanted: Sequence[str] | None) -> list[str]:
    """All of them, or the wanted ones; refuses what isn't there."""
    if not available:
        raise SourceError("no subject files found")
    unknown = [s for s in wanted or () if s not in available]
    if unknown:
        raise SourceError(f"unknown subjects {unknown}; there are {list(available)}")
    return list(wanted) if wanted else list(available)


def read_pamap2(spark: SparkSession, path: str, in_g: bool = True) -> DataFrame:
    """Wide rows: t, ord, activity, heart_rate, {node}_{acc,gyr,mag}_{x,y,z}, subject. Only these columns are parsed.

    Accelerations in g and rates in degrees a second; ``in_g`` false leaves m/s2.
    """
    schema = StructType([StructField(f"c{i}", DoubleType()) for i in range(PAMAP2_COLUMNS)])
    rows = spark.read.schema(schema).option("sep", " ").option("nanValue", "NaN").option("pathGlobFilter", "subject*.dat").csv(path)
    unit = 1.0 / STANDARD_GRAVITY if in_g else None

    def axis(node: str, offset: int, i: int) -> Column:
        return F.coalesce(F.col(f"c{PAMAP2_BLOCK[node] + offset + i}"), F.lit(NAN))

    out = [F.col("c0").alias("t"), F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("ord"), F.col("c1").cast("int").alias("activity"), known("c2").alias("heart_rate")]
    for node in NODES:
        for i, a in enumerate(AXES):
            acc = axis(node, PAMAP2_ACCEL, i)
            out.append((acc / F.lit(STANDARD_GRAVITY) if unit else acc).alias(f"{node}_acc_{a}"))
            out.append(F.degrees(axis(node, PAMAP2_GYRO, i)).alias(f"{node}_gyr_{a}"))
            out.append(axis(node, PAMAP2_MAG, i).alias(f"{node}_mag_{a}"))
    return rows.select(*out, _stem(F.col("_metadata.file_name")).alias("subject")).withColumn("dataset", F.lit("pamap2"))


def numbered_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, row, value): every line with its place in its file, from 0; the parts of a file count as one."""
    meta = F.col("_metadata")
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(meta["file_name"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = F.regexp_replace("file", r"-part\d+", "")
    before = F.sum("n").over(Window.partitionBy(whole).orderBy("file", "split")) - F.col("n")
    offsets = splits.select("file", "split", "first", before.alias("before"))  # a row a split
    return lines.join(offsets, ["file", "split"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("row"), "value")


def read_mhealth(spark: SparkSession, path: str) -> DataFrame:
    """Wide rows as ``read_pamap2``, with ecg_lead1 and ecg_lead2 and a time derived from the row; refuses lines of another width."""
    lines = numbered_lines(spark, path, "mHealth_subject*.log").where(F.trim("value") != "")
    cells = F.split(F.trim("value"), r"\s+")
    good = F.when(F.size(cells) == MHEALTH_COLUMNS, cells).otherwise(F.raise_error(F.lit(f"a line has not {MHEALTH_COLUMNS} columns")))
    rows = lines.select("file", "row", good.alias("c"))

    def cell(i: int) -> Column:
        return F.get("c", F.lit(i)).cast("double")

    out = [(F.col("row") / F.lit(MHEALTH_RATE_HZ)).alias("t"), F.col("row").alias("ord"), cell(MHEALTH_LABEL).cast("int").alias("activity"), cell(MHEALTH_ECG[0]).alias("ecg_lead1"), cell(MHEALTH_ECG[1]).alias("ecg_lead2")]
    for node in NODES:
        for i, a in enumerate(AXES):
            out.append((cell(MHEALTH_ACCEL[node] + i) / F.lit(STANDARD_GRAVITY)).alias(f"{node}_acc_{a}"))
            if MHEALTH_GYRO[node] is not None:
                out.append(cell(MHEALTH_GYRO[node] + i).alias(f"{node}_gyr_{a}"))
                out.append(cell(MHEALTH_MAG[node] + i).alias(f"{node}_mag_{a}"))
    return rows.select(*out, _stem(F.col("file")).alias("subject")).withColumn("dataset", F.lit("mhealth"))


def usable_rows(wide: DataFrame, activities: Sequence[int]) -> DataFrame:
    """Rows of the wanted activities with all nine acceleration axes; a missing gyroscope reading does not matter.

    Before segmentation: what is dropped here leaves gaps that break segments.
    """
    lost = F.lit(False)
    for node in NODES:
        for a in AXES:
            c = F.col(f"{node}_acc_{a}")
            lost = lost | c.isNull() | F.isnan(c)
    return wide.where(F.col("activity").isin(list(activities)) & ~lost)


def to_samples(wide: DataFrame) -> DataFrame:
    """One row a node and sample; a node without a gyroscope has NULL rates, heart rate and ECG stay where they belong."""
    there = set(wide.columns)
    null = F.lit(None).cast("double")
    heart = F.col("heart_rate") if "heart_rate" in there else null
    ecg = F.struct(F.col("ecg_lead1").alias("lead1"), F.col("ecg_lead2").alias("lead2")) if "ecg_lead1" in there else F.lit(None).cast("struct<lead1:double,lead2:double>")
    parts = []
    for node in NODES:
        has = f"{node}_gyr_x" in there
        parts.append(
            F.struct(
                F.lit(node).alias("node"),
                *[F.col(f"{node}_acc_{a}").alias(f"a{a}") for a in AXES],
                *[(F.col(f"{node}_gyr_{a}") if has else null).alias(f"g{a}") for a in AXES],
                F.lit(has).alias("has_gyro"),
                heart.alias("heart_rate"),
                (ecg if node == "chest" else F.lit(None).cast("struct<lead1:double,lead2:double>")).alias("ecg"),
            )
        )
    own = [c for c in ("dataset", "subject", "seg", "t", "ord", "activity") if c in there]
    return wide.select(*own, F.explode(F.array(*parts)).alias("s")).select(*own, "s.*")


class DatasetReplay:
    """One dataset, some subjects and a label set, as frames."""

    GAP_SEC, COVERAGE = 0.1, 0.6

    def __init__(self, spark: SparkSession, dataset: str, path: str, wanted: Sequence[str] | None = None, label_set: str = "PAMAP2_8"):
        if dataset not in CHANNELS:
            raise SourceError(f"no dataset {dataset!r}; there are {sorted(CHANNELS)}")
        self.spark, self.dataset, self.path = spark, dataset, path
        self.activities = id_map(dataset, label_set)
        self.subjects = choose_subjects(subjects(spark, path, dataset), wanted)
        self.node_ids = NODES
        self.sampling_rate_hz = PAMAP2_RATE_HZ if dataset == "pamap2" else MHEALTH_RATE_HZ

    def wide(self) -> DataFrame:
        rows = read_pamap2(self.spark, self.path) if self.dataset == "pamap2" else read_mhealth(self.spark, self.path)
        return rows.where(F.col("subject").isin(self.subjects))

    def segmented(self, wide: DataFrame | None = None) -> DataFrame:
        from ..operators.segment import segments

        rows = usable_rows(wide if wide is not None else self.wide(), list(self.activities))
        return segments(rows, self.GAP_SEC, bucket=600.0)

    def windows(self, wide: DataFrame | None = None, window_sec: float = 2.56, overlap: float = 0.5) -> tuple[DataFrame, DataFrame]:
        """(windows that hold enough samples, segmented samples); labels are names."""
        from ..operators.segment import least_samples, sliding_windows

        rows = self.segmented(wide)
        cell = window_sec / 2
        found = sliding_windows(rows, window_sec, overlap)
        spread = found.select("subject", "seg", "win", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell))).alias("cell"))
        hit = rows.select("subject", "seg", "t", F.floor(F.col("t") / cell).alias("cell")).join(spread, ["subject", "seg", "cell"]).where("t >= start and t < end")
        full = hit.groupBy("subject", "seg", "win").agg(F.count(F.lit(1)).alias("n_samples")).where(F.col("n_samples") >= least_samples(window_sec, self.sampling_rate_hz, self.COVERAGE))
        names = F.create_map(*[x for k, v in self.activities.items() for x in (F.lit(k), F.lit(v))])
        return found.join(full, ["subject", "seg", "win"]).withColumn("label", names[F.col("label")]), rows

    def frames(self, wide: DataFrame | None = None, window_sec: float = 2.56, overlap: float = 0.5) -> DataFrame:
        from ..operators.segment import frames

        windows, rows = self.windows(wide, window_sec, overlap)
        return frames(to_samples(rows).drop("heart_rate", "ecg"), windows.drop("n_samples"), window_sec / 2)
