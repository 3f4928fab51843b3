"""What the training-data operators share: tables in the shared folder, and column helpers."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Character class of the white space that separates words, in Java's and Python's syntax.
SPACE = r"\x20\x09-\x0D"

_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where driver and executors are one process may it be unset, as in tests: it then is a temporary folder.
    Elsewhere that would lose data without a word, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='meshlake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def table_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; what is written there goes with :func:`drop_tables`, at the latest when the driver ends."""
    if not _tables:
        atexit.register(_drop_at_exit, spark)
    _tables.append(f"{shared_dir(spark)}/meshlake/{uuid.uuid4().hex}/{label}")
    return _tables[-1]


#: Rows to a file of a table whose size is known.
ROWS_PER_FILE = 100_000


def cut(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The lineage ends there: a lost executor costs a re-read, and values that
    depend on row placement (generated ids) can't change between two reads.
    ``rows`` is a bound on the number of rows, if known and they are small: then there
    are as few files as that takes, instead of one from each shuffle partition.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))
    path = table_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables that :func:`cut` has left and the archives; call it when all results that read them have been written."""
    n, jvm = len(_tables), spark._jvm
    while _tables:
        path = jvm.org.apache.hadoop.fs.Path(_tables.pop()).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def _drop_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        drop_tables(spark)


def small_batches(spark: SparkSession, mb: int = 2) -> None:
    """Bound what one Arrow batch holds, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches, after which the worker, which waits for its next task, gives freed memory back to the system."""

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_of(column: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
