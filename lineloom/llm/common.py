"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII letters for case folding that leaves all other letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lineloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search("-[0-9a-f]{32}$", path):  # a folder that materialize has named
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release() -> None:
    """Gives back to the system what the allocators of this process keep of freed memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema). Workers outlive their tasks: what a task has freed, they give back at its end, so that it doesn't add to the memory of later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(whole, schema)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with column name, computed once: the optimizer copies no expression across a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(text: Column) -> Column:
    """Tells apart rows that repeat an id with another text."""
    return F.xxhash64(text)


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to every executor if it is known to have no more rows than that; otherwise a join shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fits_broadcast(df: DataFrame, column: str, limit_bytes: int) -> bool:
    """Whether the texts of a side input are small enough, by their measured size, to be sent to every executor."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0]
    return (total or 0) <= limit_bytes
