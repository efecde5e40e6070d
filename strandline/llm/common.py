"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
import weakref
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

REPO = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``.  Only where that is unset and
    Spark runs in one process (tests) a folder of this machine is taken.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", spark.sparkContext.applicationId)


def session_dir(spark: SparkSession) -> str:
    """Folder of this application's tables; deleted when the driver ends."""
    path = f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}"
    if path not in _sessions:
        _sessions.add(path)
        atexit.register(_delete, spark.sparkContext._jvm, path)
    return path


_sessions: set[str] = set()


def _delete(jvm, path: str) -> None:
    try:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)
    except Exception:  # noqa: BLE001 - the driver's JVM may have ended; what it leaves costs space only
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def materialize(df: DataFrame, name: str, thin: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage at files that outlive any executor.  ``thin`` tables
    (ids, links, counts) are written in as many files as the cluster has cores,
    however many partitions the shuffle before them had.
    """
    spark = df.sparkSession
    if thin:
        df = df.coalesce(max(2, spark.sparkContext.defaultParallelism))
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out), path)
    return out


_written: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing unwritten depends on any more."""
    for df in tables:
        ref, path = _written.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Make this repository importable in Python workers that share its folder."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])
    # whole texts travel to Python: batches are bounded by bytes, and by rows where the rows are short
    for key, default, value in (("maxRecordsPerBatch", "10000", "2000"), ("maxBytesPerBatch", None, str(4 << 20))):
        name = f"spark.sql.execution.arrow.{key}"
        if default is None or spark.conf.get(name, default) == default:
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- vectorised 64-bit hashing over one byte buffer --------------------------

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (the splitmix64 output function)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base & ((1 << 64) - 1), np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


class SpanHash:
    """Hashes of any spans of a byte buffer from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.sums[1:])
        self.inverse = powers(INVERSE, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of ``width`` bytes, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than space and 0x09-0x0D."""
    black = np.zeros(len(data) + 2, np.int8)
    black[1:-1] = ~WHITE[data]
    edge = np.diff(black)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


# ---- Arrow batches -------------------------------------------------------------


def trim() -> None:
    """Give memory that this worker no longer uses back to the system; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches, column: str, max_bytes: int = 1 << 20):
    """Cut Arrow batches so that each piece holds about ``max_bytes`` of a column at most (one row at least)."""
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.zeros(n, np.int64)
        col = batch.column(batch.schema.get_field_index(column))
        if not pa.types.is_null(col.type):
            import pyarrow.compute as pc

            sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        total = np.concatenate(([0], np.cumsum(sizes)))
        while at < n:
            to = max(at + 1, int(np.searchsorted(total, total[at] + max_bytes, side="right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at)
            at = to
    trim()


def utf8_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its n+1 offsets; null is empty."""
    import pyarrow as pa

    col = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def add_columns(batch, columns: dict, drop: tuple = ()):
    """A batch without ``drop`` and with the given Arrow arrays appended."""
    import pyarrow as pa

    names = [n for n in batch.schema.names if n not in drop and n not in columns]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays(arrays + list(columns.values()), names=names + list(columns))
