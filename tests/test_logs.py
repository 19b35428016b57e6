import numpy as np
import pytest

from kinelake.sources import logs as L
from kinelake.sources import raw as R

from .test_sources import mhealth_file, pamap2_file


def same(a, b, order):
    columns = [c for c in b.columns if c not in ("ord", "dataset")]
    rows = [[r[c] for c in columns] for r in a.orderBy(*order).collect()]
    want = [[r[c] for c in columns] for r in b.orderBy(*order).collect()]
    assert len(rows) == len(want) > 0
    for x, y in zip(rows, want, strict=True):
        for c, p, q in zip(columns, x, y, strict=True):
            assert p == q or p == pytest.approx(q, rel=1e-12, nan_ok=True), (c, p, q)


@pytest.mark.parametrize("split", [5_000, 1 << 30])
def test_first_dataset_is_what_the_reader_gives_however_split(spark, tmp_path, split):
    pamap2_file(tmp_path / "subject101.dat", n=300)
    pamap2_file(tmp_path / "subject102.dat", n=40)
    (tmp_path / "notes.txt").write_text("other\n")
    rows = L.read_logs(spark, "pamap2", str(tmp_path), splitBytes=split)
    same(rows, R.read_pamap2(spark, str(tmp_path)), ("subject", "t"))
    assert [r["t"] for r in rows.where("subject = 'subject101'").orderBy("ord").collect()] == [round(5 + i / 100, 4) for i in range(300)]
    assert L.read_logs(spark, "pamap2", str(tmp_path), inG="false").orderBy("t").first()["wrist_acc_x"] == R.read_pamap2(spark, str(tmp_path), in_g=False).orderBy("t").first()["wrist_acc_x"]


@pytest.mark.parametrize("split", [1_500, 1 << 30])
def test_second_dataset_numbers_lines_over_splits(spark, tmp_path, split):
    mhealth_file(tmp_path / "mHealth_subject2.log", n=500)
    mhealth_file(tmp_path / "mHealth_subject10.log", n=60)
    with open(tmp_path / "mHealth_subject10.log", "a") as f:
        f.write("\n" + "\t".join(["1"] * 24))  # a blank line counts, and the last line may lack its end
    rows = L.read_logs(spark, "mhealth", str(tmp_path), splitBytes=split)
    same(rows, R.read_mhealth(spark, str(tmp_path)), ("subject", "t"))
    same(spark.read.format("mhealth").load(str(tmp_path)), rows, ("subject", "t"))
    if split == 1_500:
        assert rows.rdd.getNumPartitions() > 20


def test_subjects_are_chosen_before_files_are_opened(spark, tmp_path):
    pamap2_file(tmp_path / "subject101.dat", n=30)
    (tmp_path / "subject102.dat").write_text("not a log\n")
    assert L.read_logs(spark, "pamap2", str(tmp_path), subjects=["subject101", "subject999"]).count() == 30
    assert L.read_logs(spark, "pamap2", str(tmp_path), subjects=["subject999"]).count() == 0
    rows = L.read_logs(spark, "pamap2", str(tmp_path))
    with pytest.raises(Exception, match="3 columns, not 54"):
        rows.where("subject = 'subject101'").collect()
    with pytest.raises(Exception, match="3 columns, not 54"):
        rows.collect()


def test_every_byte_range_gives_each_line_once():
    import io

    text = b"a\nbb\n\nccc\r\nd" + b"x" * 40 + b"\nlast"
    for step in range(1, len(text) + 1):
        got = [x for a in range(0, len(text), step) for at, lines in L.lines_of(io.BytesIO(text), a, min(a + step, len(text))) for x in lines]
        assert got == text.splitlines(keepends=True), step


@pytest.mark.parametrize("dataset", ["pamap2", "mhealth"])
def test_what_is_written_is_read_back_with_its_manifest(spark, tmp_path, dataset):
    width = L.LAYOUTS[dataset].width
    rng = np.random.default_rng(3)
    data = [(f"subject{1 + i % 3}", i, [float("nan") if c == 5 and i % 7 == 0 else float(x) for c, x in enumerate(rng.normal(0, 5, width))]) for i in range(400)]
    data = [(s, i, [float(i) if c == 0 else float(i % 5) if c == L.LAYOUTS[dataset].label else x for c, x in enumerate(cells)]) for s, i, cells in data]
    L.write_logs(spark.createDataFrame(data, "subject string, i long, cells array<double>").repartition(6), dataset, str(tmp_path / "out"), ["i"])
    listed = L.manifest(str(tmp_path / "out"))
    assert [(f["subject"], f["rows"]) for f in listed["files"]] == [("subject1", 134), ("subject2", 133), ("subject3", 133)]
    rows = L.read_logs(spark, dataset, str(tmp_path / "out"), leastSplits=5).orderBy("subject", "ord").collect()
    want = sorted(data)
    acc = L.LAYOUTS[dataset].accel["wrist"]
    assert [r["subject"] for r in rows] == [w[0] for w in want] and [r["activity"] for r in rows] == [w[1] % 5 for w in want]
    assert [r["wrist_acc_z"] for r in rows] == pytest.approx([w[2][acc + 2] / 9.80665 for w in want], nan_ok=True)


def test_a_failed_task_leaves_no_file_and_no_manifest(spark, tmp_path):
    good, bad = [0.0] * 54, [0.0] * 53
    rows = spark.createDataFrame([("subject1", 1, good), ("subject1", 2, good), ("subject2", 1, bad)], "subject string, i long, cells array<double>")
    with pytest.raises(Exception, match="53 cells"):
        L.write_logs(rows, "pamap2", str(tmp_path / "out"), ["i"])
    assert L.manifest(str(tmp_path / "out")) is None
    assert not [p for p in (tmp_path / "out").iterdir()]


@pytest.mark.parametrize("dataset", ["pamap2", "mhealth"])
def test_no_task_writes_all_of_a_long_log(spark, tmp_path, dataset):
    from pyspark.sql import functions as F

    width, n = L.LAYOUTS[dataset].width, 2000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(n).select(F.lit("subject7").alias("subject"), F.col("id").alias("i"), F.array(*[F.col("id").cast("double")] * width).alias("cells"))
        L.write_logs(rows.repartition(5), dataset, str(tmp_path / "out"), ["i"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    listed = L.manifest(str(tmp_path / "out"))["files"]
    assert len(listed) == 4 and sum(f["rows"] for f in listed) == n and max(f["rows"] for f in listed) < n / 2
    got = L.read_logs(spark, dataset, str(tmp_path / "out"), leastSplits=7).orderBy("ord").collect()
    assert [r["activity"] for r in got] == list(range(n)) and {r["subject"] for r in got} == {"subject7"}
    rate = 1 if dataset == "pamap2" else L.LAYOUTS[dataset].rate_hz
    assert [r["t"] for r in got] == [i / rate for i in range(n)]
    again = (L.raw.read_pamap2 if dataset == "pamap2" else L.raw.read_mhealth)(spark, str(tmp_path / "out")).orderBy("t").collect()
    assert [r["t"] for r in again] == [i / rate for i in range(n)] and [r["activity"] for r in again] == list(range(n))
