"""Annotated spans: overlaps, merging, agreement; and samples of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import checkpointed

CELL = 4096


def overlaps(spans: DataFrame, doc: str = "doc_id", key: str = "id") -> DataFrame:
    """doc, a, b: pairs of spans (start, end exclusive) of a document that share a character.

    Spans meet in the cells of the text that they cover; a pair counts in the cell where the later one starts.
    """
    cells = spans.select(F.col(doc).alias("doc"), F.col(key).alias("k"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / CELL))).alias("cell"))
    a, b = cells.alias("a"), cells.alias("b")
    meet = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.k") < F.col("b.k")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    first = F.floor(F.greatest("a.start", "b.start") / CELL) == F.col("a.cell")
    return a.join(b, meet & first).select(F.col("a.doc").alias(doc), F.col("a.k").alias("a"), F.col("b.k").alias("b"))


def merged(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, label, start, end: spans of a label that overlap or touch become one."""
    by = Window.partitionBy(doc, "label").orderBy("start", "end")
    far = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", (F.col("start") > F.coalesce(far, F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(by))
    return islands.groupBy(doc, "label", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def kappa(a: Column, b: Column, df: DataFrame) -> DataFrame:
    """kappa, observed, expected: agreement of two labels of each row beyond chance."""
    pairs = df.select(a.cast("string").alias("a"), b.cast("string").alias("b")).filter("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    total = pairs.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = pairs.groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("x")), pairs.groupBy(F.col("b").alias("l")).agg(F.sum("n").alias("y"))
    chance = left.join(right, "l").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    scored = total.join(F.broadcast(chance)).select((F.col("same") / F.col("t")).alias("observed"), (F.coalesce("c", F.lit(0)) / (F.col("t") * F.col("t"))).alias("expected"))  # one row each
    return scored.select(F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).otherwise(1.0).alias("kappa"), "observed", "expected")


def random_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, by a seeded hash of key: each task keeps n, the driver none."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


reservoir = random_sample


def systematic(df: DataFrame, step: int, seed: int, key: str) -> DataFrame:
    """Every step-th row in order of key, from a seeded start. Rows are numbered in ranges of key, not in one task.

    Rows and the number of their range are written once, so that a repeated task deals no row elsewhere.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = checkpointed(df.repartitionByRange(ranges, key).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))  # a row for each range
    numbered = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key))).join(F.broadcast(before), "_p")
    return numbered.filter((F.col("_b") + F.col("_r") - 1 - seed % step) % step == 0).select(*df.columns)


def stratified(df: DataFrame, stratum: str, n: int, seed: int, key: str) -> DataFrame:
    """n rows of each stratum by a seeded hash."""
    picked = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_n", F.row_number().over(picked)).filter(F.col("_n") <= n).drop("_n")


def weighted(df: DataFrame, weight: Column, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, likelier by weight: the largest ln(u) / weight for seeded u."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) + 1) / float(1 << 53)
    return df.orderBy((F.log(u) / weight).desc(), key).limit(n)
