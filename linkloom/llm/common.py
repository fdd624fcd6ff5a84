"""Shared pieces of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every contract here, as Java and RE2 read it.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def pick(df: DataFrame, **want: str) -> DataFrame:
    """``df`` with only the columns ``new=old``, found by exact name.

    Columns are addressed by position, so extra columns that differ by case, that repeat a name or that
    clash with an operator's own column names are harmless.
    """
    flat = positions(df)
    return flat.select(*(F.col(f"_{place(df, old)}").alias(new) for new, old in want.items()))


def positions(df: DataFrame) -> DataFrame:
    """``df`` with its columns named _0, _1 and so on."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> int:
    """Position of a column by exact name, or else by its name in any case."""
    names = df.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a folder of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="linkloom-"))
    return spark.conf.get("spark.checkpoint.dir")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: ``df`` written as Parquet to the shared folder and read again.

    The files hold what was computed once, so a lost executor neither repeats the work nor changes row
    ids made on the way, and the optimiser sees their true size when it decides on a broadcast.
    """
    spark = df.sparkSession
    path = f"{_SCRATCH[-1] if _SCRATCH else own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the scratch blocks that are open.
_SCRATCH: list[str] = []


def own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/linkloom/{spark.sparkContext.applicationId}"


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block at whose end everything that was stashed in it is deleted; what is made of that must be written before."""
    _SCRATCH.append(f"{own_folder(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete(spark, _SCRATCH.pop())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete every table that ``stash`` wrote for this application; results not yet written are lost."""
    delete(spark, own_folder(spark))


#: Bytes and rows of the Arrow batches in which texts go to Python, where the session leaves Spark's defaults.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, as 10,000 texts at once would take much of an executor's memory.

    Settings that differ from Spark's defaults are left as they are.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bucket_of_id(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to about ``limit``, or one row beyond it."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_RESIDENT: dict = {}


def resident(key, make: Callable[[], Any]) -> Any:
    """The one thing that a Python worker keeps from task to task; what it kept under another key is freed first.

    Workers are used again by later stages, so what each stage keeps would otherwise add up.
    """
    if key not in _RESIDENT:
        vacate()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def vacate() -> None:
    """Free what the worker keeps, back to the system where that is possible."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def sized_parts(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with the bytes of a text column, null as empty: about ``limit`` bytes, or one row beyond it."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = [n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()]
        for a, b in slices(sizes, limit):
            part = batch.slice(a, b - a)
            yield part, [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
