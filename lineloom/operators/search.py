"""Search: a row for each match, with byte columns and context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_rules import escaped, java_regex
from ..sources.lines import Lines


def glob_regex(glob: str) -> str:
    return "^" + escaped(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def build(pattern: str, kind: str = "regex", *, whole_word: bool = False, ignore_case: bool = False, multiline: bool = False) -> str:
    """A pattern of a kind (regex, literal, glob) in the engine's dialect."""
    made = {"regex": lambda: pattern, "semantic": lambda: pattern, "literal": lambda: escaped(pattern), "glob": lambda: glob_regex(pattern)}[kind]()
    return java_regex(rf"\b{made}\b" if whole_word else made, ignore_case, multiline)


def occurrences(line: Column, regex: str) -> Column:
    """begin, stop (bytes from 1, the end exclusive) and text of every match.

    The text between matches and the matches alternate, so that offsets are running sums of lengths.
    """
    # both are worked out once, not for each match
    beside = F.filter(F.arrays_zip(F.split(line, F.lit(regex), -1).alias("b"), F.regexp_extract_all(line, F.lit(regex), F.lit(0)).alias("m")), lambda x: x["m"].isNotNull())
    step = lambda acc, x: F.struct(
        (acc["at"] + F.octet_length(x["b"]) + F.octet_length(x["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.octet_length(x["b"]) + 1).alias("begin"), (acc["at"] + F.octet_length(x["b"]) + F.octet_length(x["m"]) + 1).alias("stop"), x["m"].alias("text")))).alias("out"),
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,stop:int,text:string>>").alias("out"))
    return F.aggregate(beside, begin, step, lambda acc: acc["out"])


def any_match(line: Column, regexes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [line.rlike(r) for r in regexes])


def search(lines: Lines, patterns: list[str], *, invert: bool = False, before: int = 0, after: int = 0, only_matching: bool = False, max_per_file: int | None = None, max_total: int | None = None) -> DataFrame:
    """source_file, source_line, begin, stop, match, content, byte_offset, context_before, context_after.

    patterns: from build(). A line has a row for each match of each pattern, pattern by pattern.
    """
    df = lines.df
    order = [F.col(c) for c, _ in lines.order]
    by_file = Window.partitionBy("source_file").orderBy(*order)
    df = df.withColumn("_offset", F.sum(F.octet_length("content") + 1).over(by_file) - F.octet_length("content") - 1)
    around = F.struct(F.col("source_line").alias("line_number"), F.col("content"))
    if before:
        df = df.withColumn("context_before", F.collect_list(around).over(by_file.rowsBetween(-before, -1)))
    if after:
        df = df.withColumn("context_after", F.collect_list(around).over(by_file.rowsBetween(1, after)))
    hit = any_match(F.col("content"), patterns)
    if invert:
        df = df.filter(~hit).withColumn("m", F.struct(F.lit(1).alias("begin"), (F.octet_length("content") + 1).alias("stop"), F.col("content").alias("text"))).withColumn("_k", F.lit(0))
    else:
        df = df.filter(hit).select("*", F.posexplode(F.concat(*[occurrences(F.col("content"), p) for p in patterns])).alias("_k", "m"))
    if max_per_file is not None:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy("source_file").orderBy(*order, "_k"))).filter(F.col("_n") <= max_per_file)
    if max_total is not None:
        df = df.orderBy(*order, "_k").limit(max_total)
    context = [F.col(c) for c, n in (("context_before", before), ("context_after", after)) if n]
    shown = F.col("m.text") if only_matching else F.col("content")
    return df.select("source_file", "source_line", F.col("m.begin").alias("begin"), F.col("m.stop").alias("stop"), F.col("m.text").alias("match"), shown.alias("content"), (F.col("_offset") + F.col("m.begin") - 1).alias("byte_offset"), *context)


def count_per_file(lines: Lines, patterns: list[str]) -> DataFrame:
    """source_file, matches: lines that match, in files that have any."""
    return lines.df.filter(any_match(F.col("content"), patterns)).groupBy("source_file").agg(F.count("*").alias("matches"))


def files_with_match(lines: Lines, patterns: list[str]) -> DataFrame:
    return count_per_file(lines, patterns).select("source_file")


def files_without_match(lines: Lines, patterns: list[str]) -> DataFrame:
    """One aggregation tells files with and without a match apart."""
    return lines.df.groupBy("source_file").agg(F.max(any_match(F.col("content"), patterns).cast("int")).alias("hit")).filter("hit = 0").select("source_file")
