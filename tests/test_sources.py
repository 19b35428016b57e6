import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake import labels as L
from kinelake.operators import profile as P
from kinelake.sources import raw as R


def pamap2_file(path, n=2000, activity=lambda i: 4 if i < 1500 else 5):
    rng = np.random.default_rng(1)
    lines = []
    for i in range(n):
        c = rng.normal(9.8, 1, 54)
        c[0], c[1] = 5 + i / 100, activity(i)
        c = [f"{v:.4f}" for v in c]
        c[1] = str(activity(i))
        c[2] = "NaN" if i % 9 else "100"
        if i == 700:
            c[4] = "NaN"
        if i == 800:
            c[10] = "NaN"
        lines.append(" ".join(c))
    path.write_text("\n".join(lines) + "\n")
    return [list(map(float, x.split())) for x in lines]


def mhealth_file(path, n=3000):
    rng = np.random.default_rng(2)
    rows = rng.normal(0, 5, (n, 24)).round(3)
    rows[:, 23] = np.where(np.arange(n) < n // 2, 4, 5)
    path.write_text("\n".join("\t".join(f"{v:g}" for v in r) for r in rows) + "\n")
    return rows


def test_first_dataset(spark, tmp_path):
    raw = pamap2_file(tmp_path / "subject101.dat")
    assert R.subjects(spark, str(tmp_path), "pamap2") == ["subject101"]
    rows = R.read_pamap2(spark, str(tmp_path)).orderBy("t").collect()
    assert len(rows) == 2000 and rows[0]["subject"] == "subject101"
    assert rows[3]["wrist_acc_x"] == pytest.approx(raw[3][4] / 9.80665) and rows[3]["ankle_gyr_z"] == pytest.approx(np.degrees(raw[3][37 + 9]))
    assert np.isnan(rows[700]["wrist_acc_x"]) and rows[1]["heart_rate"] is None and rows[0]["heart_rate"] == 100.0
    assert R.read_pamap2(spark, str(tmp_path), in_g=False).orderBy("t").first()["wrist_acc_x"] == pytest.approx(raw[0][4])
    pruned = R.read_pamap2(spark, str(tmp_path)).select("t", "wrist_acc_x")._jdf.queryExecution().executedPlan().toString()
    assert "c53" not in pruned.split("ReadSchema")[1]


def reference_windows(t, act, length=2.56, step=1.28, least=154):
    brk = np.r_[True, (act[1:] != act[:-1]) | (np.diff(t) > 0.1)]
    seg = np.cumsum(brk)
    out = []
    for s in np.unique(seg):
        own = t[seg == s]
        if own[-1] - own[0] < length:
            continue
        start, k = own[0], 0
        while start + length <= own[-1] + 1e-9:
            n = int(((own >= start) & (own < start + length)).sum())
            if n >= least:
                out.append((s, k, start, n))
            start, k = start + step, k + 1
    return out


def test_replay_windows_are_the_plain_ones(spark, tmp_path):
    raw = np.array(pamap2_file(tmp_path / "subject101.dat"))
    source = R.DatasetReplay(spark, "pamap2", str(tmp_path))
    good = ~np.isnan(raw[:, 4])
    expected = reference_windows(raw[good, 0], raw[good, 1])
    windows, _ = source.windows()
    got = sorted((r["seg"], r["win"], r["start"], r["n_samples"]) for r in windows.collect())
    assert got == [tuple(e) for e in expected] and len(got) > 8
    assert {r["label"] for r in windows.collect()} == {"walking", "running"}
    frames = source.frames()
    assert frames.count() == 3 * sum(e[3] for e in expected)
    lost = frames.where(F.isnan("gx"))
    assert lost.count() > 0 and lost.where("node <> 'wrist'").count() == 0
    assert P.require_window_count(windows, len(expected)) == len(expected)
    with pytest.raises(P.WindowCountError):
        P.require_window_count(windows, 2 * len(expected))


def test_second_dataset_gets_its_clock_from_the_row_however_it_is_split(spark, tmp_path):
    for subject in (2, 10):
        mhealth_file(tmp_path / f"mHealth_subject{subject}.log")
    raw = mhealth_file(tmp_path / "mHealth_subject10.log")
    assert R.subjects(spark, str(tmp_path), "mhealth") == ["subject2", "subject10"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        wide = R.read_mhealth(spark, str(tmp_path)).where("subject = 'subject10'")
        rows = wide.orderBy("t").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["t"] for r in rows] == [i / 50.0 for i in range(3000)]
    assert rows[1234]["wrist_acc_y"] == pytest.approx(raw[1234, 15] / 9.80665) and rows[1234]["ankle_gyr_x"] == pytest.approx(raw[1234, 8])
    samples = R.to_samples(wide.limit(5))
    by = {r["node"]: r for r in samples.collect()}
    assert by["chest"]["gx"] is None and not by["chest"]["has_gyro"] and by["chest"]["ecg"] is not None and by["wrist"]["ecg"] is None
    assert R.DatasetReplay(spark, "mhealth", str(tmp_path), ["subject2"], "CANONICAL_6").windows()[0].count() > 0


def test_refusals(spark, tmp_path):
    (tmp_path / "mHealth_subject1.log").write_text("1 2 3\n")
    with pytest.raises(Exception, match="24 columns"):
        R.read_mhealth(spark, str(tmp_path)).collect()
    with pytest.raises(L.LabelSetError):
        R.DatasetReplay(spark, "mhealth", str(tmp_path), label_set="PAMAP2_8")
    with pytest.raises(R.SourceError):
        R.DatasetReplay(spark, "mhealth", str(tmp_path), ["subject7"], "CANONICAL_6")
    with pytest.raises(R.SourceError):
        R.DatasetReplay(spark, "other", str(tmp_path))
    with pytest.raises(L.LabelSetError):
        L.resolve_label_set("pamap2", "NOPE")
    with pytest.raises(L.LabelSetError):
        L.permitted_label_sets("nope")
    assert L.permitted_label_sets("mhealth") == ("CANONICAL_6",) and len(L.id_map("pamap2", "CANONICAL_6")) == 6
    dim = L.label_dimension(spark)
    assert dim.where("dataset = 'pamap2' and role = 'mapped'").count() == 8 and dim.where("activity_id = 5 and dataset = 'mhealth'").first()["role"] == "excluded"
