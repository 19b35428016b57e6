"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Tables of the scratches that are open.
_HELD: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset: a fresh local one in local mode (tests), else one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        else:
            _OWN[app] = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate-{app}"
    return _OWN[app]


def held(path: str) -> str:
    """``path``, which the open scratches delete in the end."""
    for own in _HELD:
        own.append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files go through Spark's commit protocol, so a lost executor costs a
    retried task and never a half-written table. The reader's schema is ``df``'s.
    """
    spark = df.sparkSession
    path = held(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_table(spark: SparkSession, source: str, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, stored once an application and state of ``source`` (names, sizes and times of its files)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(source)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = store.listFiles(where, True)
    state = hashlib.sha256(spark.sparkContext.applicationId.encode())
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    state.update("\n".join(sorted(seen)).encode())
    path = f"{shared_dir(spark)}/{label}-{state.hexdigest()[:32]}"
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        with scratch(spark):
            make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def parts_of(spark: SparkSession, source: str, rows: int) -> int:
    """Into how many partitions the Parquet table ``source`` goes with at most ``rows`` rows each; at least one a core. Rows are counted by the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(source).count() // rows))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes in the end the tables ``written`` inside: for work whose result is stored before it ends."""
    own: list[str] = []
    _HELD.append(own)
    try:
        yield
    finally:
        _HELD[:] = [h for h in _HELD if h is not own]
        for path in own:
            remove(spark, path)
