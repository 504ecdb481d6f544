"""Functions of whole small documents: tables and headings in them, differences, summaries, commits, archives and formats."""

from __future__ import annotations

import configparser
import difflib
import io
import json
import re
import tarfile
import tomllib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import coded, pieces, ranks, slices
from .text import BREAK, spaced, words

STRING = T.StringType()


def headings(lines: DataFrame) -> DataFrame:
    """source_file, source_line, level, title, anchor: markdown headings."""
    title = F.trim(F.regexp_extract("content", r"^#{1,6}\s+(.*?)\s*#*$", 1))
    anchor = F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s-]", ""), r"\s+", "-")
    return lines.filter(F.col("content").rlike(r"^#{1,6}\s+\S")).select("source_file", "source_line", F.length(F.regexp_extract("content", r"^(#+)", 1)).alias("level"), title.alias("title"), anchor.alias("anchor"))


def links(lines: DataFrame) -> DataFrame:
    """source_file, source_line, text, target: markdown links."""
    p = r"\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("text"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("target"))
    return lines.filter(F.col("content").rlike(p)).select("source_file", "source_line", F.explode(both).alias("x")).select("source_file", "source_line", "x.text", "x.target")


def table_rows(lines: DataFrame) -> DataFrame:
    """source_file, table, row, cells: rows of markdown tables (row 0 is the header). Tables are runs of lines with bars."""
    by = Window.partitionBy("source_file").orderBy("source_line")
    bars = lines.filter(F.col("content").rlike(r"^\s*\|.*\|\s*$"))
    cut = bars.withColumn("new", (F.col("source_line") - F.coalesce(F.lag("source_line").over(by), F.lit(-9)) > 1).cast("int")).withColumn("table", F.sum("new").over(by))
    rule = F.col("content").rlike(r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$")
    cells = F.transform(F.split(F.regexp_replace("content", r"^\s*\||\|\s*$", ""), r"\|", -1), lambda c: F.trim(c))
    numbered = cut.filter(~rule).withColumn("row", F.row_number().over(Window.partitionBy("source_file", "table").orderBy("source_line")) - 1)
    return numbered.select("source_file", "table", "row", cells.alias("cells"))


@F.pandas_udf(STRING)
def text_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """A unified difference of two texts."""
    return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), lineterm="")) for x, y in zip(a, b, strict=True)])


def _changes(a, b, path: str) -> list[tuple[str, str, str | None]]:
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in sorted(a.keys() | b.keys()):
            at = f"{path}/{k}"
            out += [("remove", at, None)] if k not in b else [("add", at, json.dumps(b[k]))] if k not in a else _changes(a[k], b[k], at)
        return out
    if isinstance(a, list) and isinstance(b, list):
        out = [c for i, (x, y) in enumerate(zip(a, b, strict=False)) for c in _changes(x, y, f"{path}/{i}")]
        out += [("add", f"{path}/{i}", json.dumps(b[i])) for i in range(len(a), len(b))]
        return out + [("remove", f"{path}/{i}", None) for i in range(len(b), len(a))]
    return [] if a == b and type(a) is type(b) else [("replace", path, json.dumps(b))]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("op", STRING), T.StructField("path", STRING), T.StructField("value", STRING)])))
def json_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Additions, removals and replacements by path; arrays by position."""
    return pd.Series([[{"op": o, "path": p, "value": v} for o, p, v in _changes(json.loads(x), json.loads(y), "")] for x, y in zip(a, b, strict=True)])


def sentences_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, at, sentence."""
    cut = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"(?<=[.!?])\s+", -1), lambda s: F.trim(s) != "")
    return df.select(F.col(id_col).alias("id"), F.posexplode(cut).alias("at", "sentence"))


def _said(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, s: all sentences of an id (at, sentence, and words with spaces between them) in one row. Rows without id take no part."""
    known = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.collect_list(text_col).alias("texts"))
    cut = lambda t: F.filter(F.split(t, r"(?<=[.!?])\s+", -1), lambda s: F.trim(s) != "")
    return known.select("id", F.flatten(F.transform("texts", lambda t: F.transform(cut(t), lambda s, i: F.struct(i.alias("at"), s.alias("sentence"), spaced(F.lower(s), BREAK).alias("words"))))).alias("s"))


def _counted(some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of rows of _said: the row of each sentence; its place (row, then at); for each place and word of it the place, the word and how often it is said; the words; and how many places make up a row."""
    owners = pc.list_parent_indices(some["s"]).to_numpy().astype(np.int64)
    at, _, said = some["s"].flatten().flatten()
    at = at.to_numpy().astype(np.int64)
    wide = int(at.max(initial=0)) + 1
    places = owners * wide + at
    which, codes, terms = coded(said)
    many = max(len(terms), 1)
    keys, c = np.unique(places[which] * many + codes, return_counts=True)
    return owners, places, keys // many, keys % many, c, terms, wide


def _best_sentences(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "s"):
                owners, places, where, codes, c, terms, wide = _counted(some)
                if not len(where):
                    continue
                total, many = np.bincount(owners, minlength=some.num_rows), len(terms)
                _, pair, df = np.unique(where // wide * many + codes, return_inverse=True, return_counts=True)
                idf = np.log(total[where // wide] / df[pair]) + 1
                begins = np.flatnonzero(np.diff(where, prepend=-1))
                scored, score = where[begins], np.round(np.add.reduceat(c * idf, begins) / np.add.reduceat(c, begins), 12)  # sums differ by their order
                found = np.searchsorted(scored, places).clip(max=len(scored) - 1)
                rated = np.flatnonzero(scored[found] == places)  # sentences with words
                order = rated[np.lexsort((places[rated], -score[found[rated]], owners[rated]))]
                begins = np.flatnonzero(np.diff(owners[order], prepend=-1))
                nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
                chosen = np.sort(order[nth < n])
                chosen = chosen[np.argsort(places[chosen], kind="stable")]
                begins = np.flatnonzero(np.diff(owners[chosen], prepend=-1))
                lists = pa.ListArray.from_arrays(np.append(begins, len(chosen)).astype(np.int32), some["s"].flatten().flatten()[1].take(pa.array(chosen)))
                yield from pieces({"id": some["id"].take(pa.array(owners[chosen[begins]])), "summary": pc.binary_join(lists, " ")})

    return run


def summary(df: DataFrame, id_col: str, text_col: str, n: int = 3, method: str = "tf_idf") -> DataFrame:
    """id, summary: the n best sentences of each text, in their order. method: tf_idf (sentences are the documents), or lead.

    By tf_idf, the texts of an id are brought together once and worked on as a whole, with equal scores in order.
    """
    if method != "lead":
        kind = df.select(F.col(id_col).alias("id")).schema
        return _said(df, id_col, text_col).mapInArrow(_best_sentences(n), T.StructType([*kind, T.StructField("summary", STRING)]))
    ranked = sentences_of(df, id_col, text_col).withColumn("score", -F.col("at"))
    best = ranked.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "at"))).filter(F.col("r") <= n)
    return best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"]), " ").alias("summary"))


def sentence_graph(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, a, b, weight: sentences of a text that share words, by Jaccard; they meet on each shared word, which are counted."""
    s = sentences_of(df, id_col, text_col).select("id", "at", F.array_distinct(words(F.lower("sentence"))).alias("w")).select("id", "at", F.size("w").alias("n"), F.explode("w").alias("word"))
    met = s.toDF("id", "a", "na", "word").join(s.toDF("id", "b", "nb", "word"), ["id", "word"]).filter("a < b")
    both = met.groupBy("id", "a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return both.select("id", "a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("weight"))


def commit(message: Column) -> Column:
    """kind, scope, breaking, description of a conventional commit; null if it is none."""
    p = r"^(\w+)(?:\(([^)]*)\))?(!)?:\s+([^\n]+)"
    part = lambda i: F.regexp_extract(message, p, i)
    made = F.struct(F.lower(part(1)).alias("kind"), F.nullif(part(2), F.lit("")).alias("scope"), ((part(3) == "!") | message.contains("BREAKING CHANGE")).alias("breaking"), part(4).alias("description"))
    return F.when(message.rlike(p), made)


def version_bump(commits: DataFrame, message_col: str) -> DataFrame:
    """bump: major, minor, patch or none, by the greatest of the commits."""
    c = commit(F.col(message_col))
    rank = F.when(c["breaking"], 3).when(c["kind"] == "feat", 2).when(c["kind"].isin("fix", "perf", "refactor"), 1).otherwise(0)
    return commits.agg(F.element_at(F.array(*map(F.lit, ("none", "patch", "minor", "major"))), F.coalesce(F.max(rank), F.lit(0)) + 1).alias("bump"))


def tar_entries(files: DataFrame) -> DataFrame:
    """path, name, size, content of the files in tar archives (plain, gzip, bzip2, xz) of a binaryFile table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as archive:
                    for m in archive:
                        if m.isfile():
                            data = archive.extractfile(m).read()
                            yield pa.RecordBatch.from_pydict({"path": [path.as_py()], "name": [m.name], "size": [m.size], "content": [data]})

    return files.select("path", "content").mapInArrow(run, "path string, name string, size long, content binary")


def format_of(text: Column) -> Column:
    """json, xml, csv, toml, ini, yaml or text, by how it begins."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), "json").when(t.startswith("<"), "xml").when(t.rlike(r"(?m)^\[[\w.-]+\]\s*$") & t.rlike(r"(?m)^\w+\s*=\s*[\"\d\[]"), "toml").when(t.rlike(r"(?m)^\[[^\]]+\]\s*$"), "ini").when(t.rlike(r"^---|(?m)^\w[\w -]*:\s"), "yaml").when(t.rlike(r"^[^\n,]+(?:,[^\n,]*)+"), "csv").otherwise("text")


@F.pandas_udf(STRING)
def toml_to_json(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else json.dumps(tomllib.loads(t), sort_keys=True, default=str))


@F.pandas_udf(STRING)
def ini_to_json(x: pd.Series) -> pd.Series:
    def one(t):
        if t is None:
            return None
        c = configparser.ConfigParser(interpolation=None)
        c.read_string(t)
        return json.dumps({s: dict(c[s]) for s in c.sections()}, sort_keys=True)

    return x.map(one)


def rendered(template: str):
    """A function of a JSON text: the template with {{name}} (escaped) and {{{name}}} (plain) filled in."""
    @F.pandas_udf(STRING)
    def f(x: pd.Series) -> pd.Series:
        from html import escape

        def one(t):
            values = json.loads(t or "{}")
            get = lambda name: str(values.get(name, ""))
            return re.sub(r"\{\{(\w+)\}\}", lambda m: escape(get(m[1])), re.sub(r"\{\{\{(\w+)\}\}\}", lambda m: get(m[1]), template))

        return x.map(one)

    return f


def learn_pairs(df: DataFrame, text_col: str, merges: int) -> list[tuple[str, str]]:
    """The most frequent adjacent pairs of symbols, merged one after the other; ties to the smaller pair. The vocabulary is a table of words and counts."""
    vocabulary = df.select(F.explode(words(F.lower(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).select(F.filter(F.split("w", ""), lambda c: c != "").alias("s"), "n").cache()
    out: list[tuple[str, str]] = []
    state = vocabulary
    for _ in range(merges):
        pairs = F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda a, i: F.struct(a.alias("a"), F.get("s", i + 1).alias("b")))
        top = state.filter(F.size("s") > 1).select(F.explode(pairs).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "p").first()
        if top is None or top["n"] < 2:
            break
        a, b = top["p"]["a"], top["p"]["b"]
        out.append((a, b))
        joined = F.array_join("s", "\u0001")
        merged = F.regexp_replace(F.concat(F.lit("\u0001"), joined, F.lit("\u0001")), f"(?<=\u0001)\\Q{a}\\E\u0001\\Q{b}\\E(?=\u0001)", F.lit((a + b).replace("\\", "\\\\").replace("$", "\\$")))
        state = state.select(F.filter(F.split(merged, "\u0001"), lambda c: c != "").alias("s"), "n")
    vocabulary.unpersist()
    return out


def _likely_keywords(top: int):
    """id, word, c, df, words, sentences of words that can be among the top of an id: those of scores from just below its top-th, and of words that count alike the first in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "s"):
                owners, _, where, codes, c, terms, wide = _counted(some)
                total, many = np.bincount(owners, minlength=some.num_rows), max(len(terms), 1)
                keys, pair, df = np.unique(where // wide * many + codes, return_inverse=True, return_counts=True)
                c, rows, codes = np.bincount(pair, c, len(keys)).astype(np.int64), keys // many, keys % many
                words = np.bincount(rows, c, some.num_rows).astype(np.int64)[rows]
                score = c / words * (np.log(total[rows] / df) + 1)
                order = np.lexsort((ranks(terms)[codes], df, c, -score, rows))
                rows, codes, c, df, words, score = (x[order] for x in (rows, codes, c, df, words, score))
                nth = lambda new: np.arange(len(rows)) - np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
                new = np.diff(rows, prepend=-1) != 0
                alike = nth(new | (np.diff(c, prepend=-1) != 0) | (np.diff(df, prepend=-1) != 0))
                last = np.full(some.num_rows, -np.inf)
                is_last = nth(new) == top - 1
                last[rows[is_last]] = score[is_last]
                keep = np.flatnonzero((alike < top) & (score >= last[rows] - 1e-9))
                yield from pieces({"id": some["id"].take(pa.array(rows[keep])), "word": terms.take(pa.array(codes[keep])), "c": c[keep], "df": df[keep], "words": words[keep], "sentences": total[rows[keep]]})

    return run


def keywords(df: DataFrame, id_col: str, text_col: str, top: int = 10) -> DataFrame:
    """id, word, score: words by their share of a text times how few of its sentences have them; ties by word.

    The texts of an id are brought together once; its words are counted there, and only those that can be among the top are ranked.
    """
    kind = df.select(F.col(id_col).alias("id")).schema
    found = _said(df, id_col, text_col).mapInArrow(_likely_keywords(top), T.StructType([*kind, T.StructField("word", STRING), *[T.StructField(k, T.LongType()) for k in ("c", "df", "words", "sentences")]]))
    scored = found.select("id", "word", (F.col("c") / F.col("words") * (F.log(F.col("sentences") / F.col("df")) + 1)).alias("score"))
    by = Window.partitionBy("id").orderBy(F.round("score", 12).desc(), "word")
    return scored.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= top).drop("r")
