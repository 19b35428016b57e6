import json

import pytest
from pyspark.sql import functions as F

from kinelake.operators import export as E
from kinelake.operators import inject as I
from kinelake.sources import documents as D
from kinelake.sources.results import read_pairs, read_waveforms

from .frames import NAN, frames, window


def rows(spark, n=30):
    return spark.range(n).select(F.lit("d").alias("dataset"), (F.col("id") % 3).cast("string").alias("subject"), F.when(F.col("id") % 2 == 0, "walking").otherwise("lying").alias("activity"), F.format_string("f%03d.json", "id").alias("file"), F.format_string('{"id": %d}', "id").alias("json")).repartition(4)


def test_files_and_manifest_appear_together(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert D.read_manifest(spark, folder) is None
    D.write_documents(rows(spark), folder)
    made = D.read_manifest(spark, folder)
    assert made["d"]["0"]["walking"] == ["f000.json", "f006.json", "f012.json", "f018.json", "f024.json"] and set(made["d"]) == {"0", "1", "2"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([*[f"f{i:03d}.json" for i in range(30)], D.MANIFEST])
    assert json.loads((tmp_path / "out" / "f007.json").read_text()) == {"id": 7}
    D.write_documents(rows(spark, 31), folder)
    assert sum(len(f) for s in D.read_manifest(spark, folder)["d"].values() for f in s.values()) == 31


def test_a_failed_task_leaves_no_manifest_and_no_file(spark, tmp_path):
    folder = str(tmp_path / "out")
    bad = rows(spark).withColumn("json", F.when(F.col("file") == "f011.json", F.raise_error(F.lit("broken document"))).otherwise(F.col("json")))
    with pytest.raises(Exception, match="broken document"):
        D.write_documents(bad, folder)
    assert D.read_manifest(spark, folder) is None and not [p for p in (tmp_path / "out").glob("f*")]
    with pytest.raises(Exception, match="one file name"):
        D.write_documents(rows(spark).withColumn("file", F.lit("same.json")), folder)
    assert D.read_manifest(spark, folder) is None and not list((tmp_path / "out").glob("*"))
    D.write_documents(rows(spark), folder)
    with pytest.raises(Exception, match="broken document"):
        D.write_documents(bad, folder)
    assert D.read_manifest(spark, folder)["d"]["1"]["lying"]  # what was there stays


def test_pairs_go_out_and_come_back(spark, tmp_path):
    df = frames(spark, window(n=6, accel=lambda node, i: (NAN, NAN, NAN) if i == 1 else (0.5 + i, 1.0, 2.0)))
    after, truth = I.inject(df, "dropout", 2, "ankle")
    documents = E.pair_documents(E.pairs(df, after, truth).withColumn("activity", F.lit("walking")))
    D.write_documents(documents, str(tmp_path / "pairs"))
    pair = read_pairs(spark, str(tmp_path / "pairs")).first()
    assert pair["failure"] == "dropout" and pair["severity"] == 2 and set(pair["clean"]) == {"wrist", "chest", "ankle"}
    assert pair["clean"]["chest"]["gyro_dps"] is None and pair["clean"]["ankle"]["accel_g"]["x"][:3] == [0.5, None, 2.5]
    lost = [x is None for x in pair["injected"]["accel_g"]["x"]]
    assert lost[1] and lost[-1] and pair["realised"]["n_blanked"] == sum(lost)


def test_waveforms_can_be_read_back(spark, tmp_path):
    df = frames(spark, window(n=4, accel=lambda node, i: (NAN, NAN, NAN) if i == 1 else (0.5 + i, 1.0, 2.0))).withColumn("label", F.lit("walking"))
    D.write_documents(E.waveforms(df).select("dataset", F.col("subject").cast("string").alias("subject"), F.lit("walking").alias("activity"), F.lit("w.json").alias("file"), "json"), str(tmp_path / "w"))
    back = read_waveforms(spark, str(tmp_path / "w" / "w.json"))
    assert back.count() == 12 and back.where("node = 'chest' and (gx is not null or has_gyro)").count() == 0 and back.where(F.isnan("ax")).count() == 3
