import tempfile

import numpy as np
from pyspark.sql import functions as F

from kinelake.operators import segment as G
from kinelake.streaming.windows import anchored_windows, epoch_windows


def stream_of(spark, rows, schema, files=4):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i, part in enumerate(np.array_split(np.arange(len(rows)), files)):
        spark.createDataFrame([rows[j] for j in part], schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def drained(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def test_anchored_stream_windows_are_the_batch_ones(spark):
    rng = np.random.default_rng(4)
    rows = []
    for subject in (1, 2, 3):
        t = np.cumsum(rng.choice([0.02, 0.02, 0.02, 0.3], 250, p=[0.33, 0.33, 0.33, 0.01]))
        rows += [(subject, float(x), float(v)) for x, v in zip(t, rng.normal(0, 1, 250), strict=True)]
    rows.sort(key=lambda r: r[1])
    schema = "subject long, t double, value double"
    got = drained(anchored_windows(stream_of(spark, rows, schema), 0.1, 1.0, least=20), "anchored")
    batch = spark.createDataFrame(rows, schema).select(F.lit("d").alias("dataset"), "subject", "t", F.lit(0).alias("ord"), F.lit(1).alias("activity"), F.lit("n").alias("node"), "value")
    seg = G.segments(batch, 0.1, 2.0, by_activity=False)
    frames = G.frames(seg, G.sliding_windows(seg, 1.0), 0.5, least=20)
    expected = frames.groupBy("subject", "seg", "win").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 9).alias("mean"))
    a = sorted(map(tuple, got.select("subject", "seg", "win", "n", F.round("mean", 9)).collect()))
    assert a == sorted(map(tuple, expected.collect())) and len(a) > 10


def test_epoch_windows_close_behind_the_watermark(spark):
    rows = [(1, 1_700_000_000 + i, float(i)) for i in range(100)]
    events = stream_of(spark, rows, "subject long, s long, value double").select("subject", F.timestamp_seconds("s").alias("ts"), "value")
    got = drained(epoch_windows(events, "ts", "10 seconds", "5 seconds", "5 seconds"), "epoch").collect()
    assert got and all(r["n"] <= 10 for r in got) and any(r["n"] == 10 for r in got)
