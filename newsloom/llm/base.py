"""What the operators of this subpackage share: the shared folder, written tables, worker imports."""

from __future__ import annotations

import atexit
import ctypes.util
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_ROOT = str(Path(__file__).resolve().parents[2])
#: Rows that go to a Python worker at once.
BATCH_ROWS = 2000
_written: list[tuple[SparkSession, str]] = []
_libc = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and ctypes.util.find_library("c") == "libc.so.6" else None


def prepare(spark: SparkSession) -> str:
    """Make workers able to import this package and return the shared checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``; a folder of our own is set only
    where that setting is missing and all tasks run on this machine.
    """
    sc = spark.sparkContext
    path = sc.environment.get("PYTHONPATH", "")
    if REPO_ROOT not in path.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, path) if x)
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.getCheckpointDir() and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = sc.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # as nobody set it; rows are whole texts here
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; removed when the session's process ends."""
    path = f"{prepare(spark)}/newsloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again.

    Unlike a local checkpoint the rows outlive the executors that made them.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._newsloom_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove written tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_newsloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = [x for x in _written if x[1] != path]


def _clean() -> None:
    for spark, path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is then the cluster's to clean
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables of a data folder, by a path that only Spark needs to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bytes_of(text: Column) -> Column:
    """A text's UTF-8 bytes; a null text is empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; afterwards the worker, which stays for other tasks, gives free memory back to the machine."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def row_chunks(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes of text; a longer text is a range of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def folded(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts with each byte replaced by table's; null texts are empty. Bytes beyond ASCII have to stay."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]] if len(texts) else b""
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((ends - ends[:1]).tobytes()), pa.py_buffer(bytes(data).translate(table))])


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
