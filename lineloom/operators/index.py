"""A trigram index of texts as a table, which narrows searches to texts that can match.

Rows are (tri, id), sorted by trigram when saved, so that a search reads only the row groups of its own trigrams.
A search compares the texts that are left. Texts without id aren't found; null texts have no trigrams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text_rules import java_regex
from .batches import pieces
from .search import glob_regex

#: Pairs of trigrams and texts that are made at once (those of one text at least).
TRIGRAMS = 1 << 18
_GROUPED = re.compile(r"[(|]")
_PIECE = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\{[^}]*\}|[.*+?^$]|[^\\\[{.*+?^$]+", re.S)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different runs of three characters of lower-cased texts, each as one number until all of some texts are known."""
    def numbers(text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        return c[:-2] << 42 | c[1:-1] << 21 | c[2:]

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            sets, held = [], 0
            while at + len(sets) < batch.num_rows and held < TRIGRAMS:
                made = [numbers(t) for t in batch["texts"][at + len(sets)].as_py()]
                sets.append(np.unique(np.concatenate([np.empty(0, np.int64), *made])))
                held += len(sets[-1])
            different, which = np.unique(np.concatenate(sets), return_inverse=True)
            whole = np.stack([different >> 42, different >> 21 & 0x1FFFFF, different & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
            names = pa.array([whole[i : i + 3] for i in range(0, len(whole), 3)], pa.string())
            rows = np.repeat(np.arange(at, at + len(sets)), [len(s) for s in sets])
            yield from pieces({"tri": names.take(pa.array(which)), "id": batch["id"].take(pa.array(rows))})
            at += len(sets)


def build(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """tri, id: every pair once. The texts of an id are brought together first, so that no pair has to be shuffled."""
    known = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.lower(text_col)).alias("texts"))
    return known.mapInArrow(_trigrams, T.StructType([T.StructField("tri", T.StringType()), *known.select("id").schema]))


def save(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    index.repartitionByRange("tri", "id").sortWithinPartitions("tri", "id").write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def literals(pattern: str) -> list[str]:
    """Texts that every match of a regular expression holds; none where it has groups or alternatives."""
    if _GROUPED.search(pattern):
        return []
    out, run = [], ""
    pieces = _PIECE.findall(pattern)
    for i, p in enumerate(pieces):
        follows = pieces[i + 1] if i + 1 < len(pieces) else ""
        plain = p[1] if re.fullmatch(r"\\[^A-Za-z0-9]", p) else p if re.match(r"[^\\\[{.*+?^$]", p) else None
        if plain is None:
            out, run = [*out, run], ""
        elif follows and follows[0] in "*+?{":  # its last character may be missing or come again
            out, run = [*out, run + plain[:-1]], ""
        else:
            run += plain
    return [x for x in (*out, run) if len(x) >= 3]


def candidates(index: DataFrame, needed: list[str]) -> DataFrame | None:
    """id: texts with all trigrams of the needed texts; None if that excludes nothing."""
    wanted = sorted({t[i : i + 3] for t in map(str.lower, needed) for i in range(len(t) - 2)})
    if not wanted:
        return None
    return index.filter(F.col("tri").isin(wanted)).groupBy("id").agg(F.count_distinct("tri").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def _narrowed(index: DataFrame, docs: DataFrame, id_col: str, needed: list[str]) -> DataFrame:
    known = docs.filter(F.col(id_col).isNotNull())
    found = candidates(index, needed)
    return known if found is None else known.join(found.withColumnRenamed("id", id_col), id_col, "left_semi")


def search(index: DataFrame, docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """Rows of docs whose text holds the pattern, whatever its case."""
    return _narrowed(index, docs, id_col, [pattern]).filter(F.contains(F.lower(text_col), F.lit(pattern.lower())))


def search_regex(index: DataFrame, docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    return _narrowed(index, docs, id_col, literals(pattern)).filter(F.col(text_col).rlike(java_regex(pattern)))


def search_glob(index: DataFrame, docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """Rows with a line that a glob describes as a whole."""
    return _narrowed(index, docs, id_col, re.split(r"[*?]+", pattern)).filter(F.col(text_col).rlike("(?m)" + glob_regex(pattern)))


def entries(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sha256, size: what an index was built from, to be kept beside it."""
    return df.select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("sha256"), F.octet_length(text_col).alias("size")).filter("id is not null")


def stale(held: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, change (added, changed, removed): texts that differ from the entries of an index."""
    now = entries(df, id_col, text_col).select("id", F.col("sha256").alias("now"), F.lit(1).alias("here"))
    both = held.select("id", "sha256", F.lit(1).alias("there")).join(now, "id", "full")
    change = F.when(F.col("there").isNull(), "added").when(F.col("here").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("sha256")), "changed")
    return both.select("id", change.alias("change")).filter("change is not null").distinct()


def updated(index: DataFrame, changes: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The index without texts that were changed or removed, and with the present ones."""
    fresh = df.join(changes.filter("change <> 'removed'").select(F.col("id").alias(id_col)), id_col, "left_semi")
    return index.join(changes.select("id"), "id", "left_anti").select("tri", "id").unionByName(build(fresh, id_col, text_col))


def stats(index: DataFrame) -> DataFrame:
    """texts, trigrams, postings."""
    return index.agg(F.count_distinct("id").alias("texts"), F.count_distinct("tri").alias("trigrams"), F.count("*").alias("postings"))
