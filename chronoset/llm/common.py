"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (local runs and tests) a temporary
    folder is made and set as the checkpoint folder.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark.sparkContext, "_chronoset_shared_dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.sparkContext._chronoset_shared_dir = folder
    return folder


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and gives the optimizer the true size of the table, so
    that it broadcasts the table only below its threshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The session's bound of the bytes of a batch that a task hands to Python, and what it is set to where texts are handed over.
BATCH_BYTES, SHORT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "2m"


def short_batches(spark: SparkSession) -> None:
    """Hand about 2 MB of rows at once to Python from now on, unless the session has a bound of its own.

    A batch has up to 10,000 rows otherwise, which are tens of MB of texts on either side of each task.
    """
    spark.conf.set(BATCH_BYTES, spark.conf.get(BATCH_BYTES, SHORT_BATCH))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as fold 0 of nothing (null)."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def uniform(*columns: str, seed: int = 7) -> Column:
    """A number in [0, 1) that depends on the given columns only, for samples that reruns repeat."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in columns], F.lit(seed)), 11) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, bound: int, *key: str, seed: int = 7) -> DataFrame:
    """About ``bound`` rows at most: rows whose hash of ``key`` lies below bound / count; all rows if there are fewer."""
    n = df.count()
    return df if n <= bound else df.where(uniform(*key, seed=seed) < bound / n)


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's columns, nulls included; repeated rows share it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows (of a few numbers each), else as it is.

    Beyond that size the join shuffles both sides. Give it a settled table: its rows are counted.
    """
    return F.broadcast(df) if df.count() <= most_rows else df


#: Slots of a sieve, as a power of two: 2**20 words of 64 bits, whatever the number of keys.
SIEVE_BITS = 26


def sieve(df: DataFrame, key: str, wanted: DataFrame, *, bits: int = SIEVE_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose ``key`` may be in ``wanted``, rows whose key is not there).

    ``key`` is a 64-bit hash and the only column of ``wanted``. A bit stands for each slot of hashes, so what is
    broadcast has at most 2**(bits - 6) rows of two numbers. A join with ``wanted`` settles the first part; rows of
    the second need no shuffle. With more keys than slots the first part grows; results stay the same.
    """
    slot = F.pmod(F.col(key), F.lit(1 << bits))
    word, bit = F.shiftright(slot, 6).alias("__word"), F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))")
    words = settle(wanted.select(word, bit.alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits")), "sieve")
    marked = df.withColumn("__word", F.shiftright(slot, 6)).join(F.broadcast(words), "__word", "left")
    marked = marked.withColumn("__in", F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False)))
    part = lambda inside: marked.where(F.col("__in") if inside else ~F.col("__in")).drop("__word", "__bits", "__in").select(*df.columns)
    return part(True), part(False)


def give_back() -> None:
    """Return freed memory of this process to the system, where the system's C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``function`` of batches, after whose last batch the task's freed memory goes back to the system.

    Spark keeps idle Python workers beside the executor; without this each holds what its largest task needed.
    """

    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        give_back()

    return run
