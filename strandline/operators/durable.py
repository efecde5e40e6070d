"""Results written to the shared folder, so that iterations start from files and not from lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``; a machine's own one only where Spark is one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base.rstrip('/')}/strandline/{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_forget, spark.sparkContext._jvm, path)
    return path


_folders: set[str] = set()
_written: dict[int, tuple] = {}


def _delete(jvm, path: str, conf) -> None:
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def _forget(jvm, path: str) -> None:
    try:
        _delete(jvm, path, jvm.org.apache.hadoop.conf.Configuration())
    except Exception:  # noqa: BLE001 - the driver's JVM may have ended; what it leaves costs space only
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, which is deleted when the driver ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing unwritten depends on any more."""
    for df in tables:
        ref, path = _written.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            _delete(df.sparkSession._jvm, path, df.sparkSession._jsparkSession.sessionState().newHadoopConf())
