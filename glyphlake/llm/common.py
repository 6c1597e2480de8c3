"""What the operators of this subpackage share: batches of texts, digests, written intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder of each application, and where each table of ``cut`` lies.
_OWN_DIR: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Rows handed to a kernel at a time. A batch of Spark's may hold thousands of long texts.
ROWS = 256
#: And bytes of text.
BYTES = 2_000_000
#: Bytes that Spark hands to a Python worker at a time while ``cut`` writes a table: rows may hold sets of large documents.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, whatever else the table holds and however its other columns are called."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                ends += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(ends)
        at = 0
        while at < batch.num_rows:
            fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
            n = max(1, min(rows, fit - at))
            yield batch.slice(at, n)
            at += n


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    """Each text; null is empty, bytes that are no UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in raw_texts(column)]


def map_texts(docs: DataFrame, kernel: Callable[[], Callable[[str], tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """One row out for each row in: doc_id, then what the kernel makes of the text.

    ``kernel`` builds the per-task function, so automata and models are made once in a task, on the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = kernel()
        for batch in small_batches(batches):
            rows = [one(x) for x in texts_of(batch.column(1))]
            columns = [batch.column(0), *(pa.array(c, type=arrow.field(i + 1).type) for i, c in enumerate(zip(*rows, strict=True)))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, kernel: Callable[[], Callable[[list[bytes]], list[bool]]], text_col: str = "text") -> DataFrame:
    """The rows whose texts the kernel keeps, with all their columns and without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = kernel()
        for batch in small_batches(batches):
            yield batch.filter(pa.array(keep(raw_texts(batch.column(at))), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def release() -> None:
    """Give what a finished task has freed back to the system: Python workers live on from task to task."""
    gc.collect()
    trim()


def trim() -> None:
    """The same for large arrays that are already gone, after each group of a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names. A session on one machine without it gets a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="glyphlake-")
        _OWN_DIR[app] = f"{found.rstrip('/')}/glyphlake-{app}"
        atexit.register(_delete, spark, _OWN_DIR[app])
    return _OWN_DIR[app]


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends here, and losing an executor loses nothing.

    Tables go when the application ends, or earlier by ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))  # holds while this table is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``cut`` that no later plan reads."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            _delete(t.sparkSession, path)
