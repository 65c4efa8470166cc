"""Results written once to the shared folder and read back: lineage ends there and survives the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Only where that is unset (tests, one machine), a folder of our own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back (no cache in executors, so nothing to lose)."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"
    if folder not in _used:
        _used.add(folder)
        atexit.register(discard_all, spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path  # type: ignore[attr-defined]
    return out


def discard_all(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; called by itself when the driver ends.

    Results that still read from it can no longer be computed."""
    try:
        folder = f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"
        _delete(spark, folder)
    except Exception:  # noqa: BLE001  (the session is gone, or the folder is)
        pass


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a result of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_factloom_path", None)
    if path is None:
        return
    _delete(df.sparkSession, path)


#: Bytes in memory up to which a table is broadcast.
BROADCAST_BYTES = 64_000_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a result of ``materialize``, marked for broadcast if its rows fit in ``most`` bytes for sure.

    Rows count with the widths of their types and, for texts and arrays, ten times the bytes of their files.  A larger table
    is returned as it is, and the join is shuffled."""
    path = getattr(df, "_factloom_path", None)
    if path is None:
        raise ValueError("only the size of a written table is known")
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    if 10 * files > most:
        return df
    return F.broadcast(df) if df.count() * (16 + 16 * len(df.columns)) + 10 * files <= most else df
