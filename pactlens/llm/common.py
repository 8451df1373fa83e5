"""What the operators of this subpackage share: tables, staged results, caches of a worker."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.functions.staging import scratch_folder

# Helpers travel with the task, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: White space of the contracts, as a character class of Java, Python and RE2.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared folder of ``spark.checkpoint.dir``, reread, and its path.

    Lineage ends there, lost executors cost nothing that is already written.
    """
    path = scratch_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete staged tables that no later plan reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice finished plans, so that the executors delete their shuffle files.

    Spark does so at each collection of the driver's heap, which a job of many small stages may not reach for long.
    """
    spark._jvm.System.gc()


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; a null id counts as learnable."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bound_batches(spark: SparkSession) -> None:
    """Batches of texts for Python hold 8 MB (or one row), unless the session has a bound of its own.

    The usual bound is a number of rows, or 64 MB; a task holds a batch some four times, in both processes.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(8 << 20))


def give_back(batches: Iterator, *kept: str, done: Callable[[], None] | None = None) -> Iterator:
    """The same batches; then the worker, which Spark keeps for other stages, returns its free memory.

    Before them the worker drops what other operators cached in it, all but those whose names begin with one of ``kept``;
    ``done`` is called behind them and lets go what the task itself holds.
    """
    holder = sys.modules.get("_pactlens_worker_cache")
    for name in [n for n in getattr(holder, "__dict__", ()) if not n.startswith(("__", *kept))]:
        del holder.__dict__[name]
    trim_memory()
    yield from batches
    if done is not None:
        done()
    trim_memory()


def trim_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library of Linux
    if trim is not None:
        trim(0)


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker process, made at first use and kept over tasks.

    The functions of this package reach workers by value, so module globals would not last.
    """
    holder = sys.modules.setdefault("_pactlens_worker_cache", types.ModuleType("_pactlens_worker_cache"))
    if name not in holder.__dict__:
        holder.__dict__[name] = make()
    return holder.__dict__[name]
