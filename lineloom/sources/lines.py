"""Lines with an order: the data that query stages work on, and the sources they come from."""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATA = ["source_file", "source_line", "content", "fields"]
EMPTY_FIELDS = "array<string>"


@dataclass(frozen=True)
class Lines:
    """df has DATA and the order's columns; order: column names with True where descending; separator: a regular expression."""

    df: DataFrame
    order: tuple[tuple[str, bool], ...] = ()
    separator: str = r"\s+"
    variables: dict = field(default_factory=dict)
    #: What skip left, what it was left of, and how many lines went.
    skipped: tuple[DataFrame, DataFrame, int] | None = None

    def put(self, **columns: Column) -> Lines:
        return replace(self, df=self.df.withColumns(columns))

    def keep(self, condition: Column) -> Lines:
        return replace(self, df=self.df.filter(condition))

    def keys(self, backwards: bool = False) -> list[Column]:
        return [F.col(c).desc_nulls_last() if down != backwards else F.col(c).asc_nulls_first() for c, down in self.order]

    def sorted(self) -> DataFrame:
        """In order, for ordered sinks."""
        return (self.df.orderBy(*self.keys()) if self.order else self.df).select(*DATA)

    def rows(self) -> DataFrame:
        return self.df.select(*DATA)

    def first_key(self) -> Column | None:
        """What grows with the order, where all of it ascends: a minimum of it needs no window."""
        return None if any(down for _, down in self.order) else F.struct(*[F.col(c) for c, _ in self.order])

    def first_of(self, key: Column) -> DataFrame:
        """_key and the order's columns of the first line of each key, by grouped extremes that are combined before a shuffle.

        Columns of one direction in a row are compared at once, the last of them first: within a key and the columns in front
        of them there is one extreme, which the next aggregate picks by the columns in front.
        """
        runs: list[tuple[bool, list[str]]] = []
        for c, down in self.order:
            if not runs or runs[-1][0] != down:
                runs.append((down, []))
            runs[-1][1].append(c)
        df = self.df.select(key.alias("_key"), *[F.struct(*cs).alias(f"_r{i}") for i, (_, cs) in enumerate(runs)])
        for i in range(len(runs) - 1, -1, -1):
            held = F.struct(*[f"_r{j}" for j in range(i, len(runs))])
            pick = F.max_by if runs[i][0] else F.min_by
            df = df.groupBy("_key", *[f"_r{j}" for j in range(i)]).agg(pick(held, f"_r{i}").alias("_h")).select("_key", *[f"_r{j}" for j in range(i)], "_h.*")
        return df.select("_key", *[f"_r{i}.*" for i in range(len(runs))])

    def new_order(self) -> str:
        n = 0
        while f"_o{n}" in self.df.columns:
            n += 1
        return f"_o{n}"


def split_lines(text: Column) -> Column:
    """Lines end at \\n, of which one \\r in front is part; a last empty line is none."""
    whole = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    lines = F.transform(F.split(whole, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(F.length(text) > 0, lines).otherwise(F.array().cast("array<string>"))


def from_table(df: DataFrame, id_col: str, text_col: str) -> Lines:
    """The lines of every text; the id takes the place of the file."""
    cut = df.select(F.col(id_col).alias("_o0"), F.posexplode(split_lines(F.col(text_col))).alias("_o1", "content"))
    return _numbered(cut, F.col("_o0").cast("string"))


def from_column(df: DataFrame, order_col: str, content: Column) -> Lines:
    """A line for each row, ordered by a column of distinct values, which also stands for the line number."""
    return replace(_numbered(df.select(F.col(order_col).alias("_o1"), content.alias("content")), F.lit("")), order=(("_o1", False),))


def _numbered(cut: DataFrame, file: Column) -> Lines:
    df = cut.select("*", file.alias("source_file"), (F.col("_o1") + 1).cast("long").alias("source_line"), F.array().cast(EMPTY_FIELDS).alias("fields"))
    return Lines(df, (("_o0", False), ("_o1", False)) if "_o0" in cut.columns else (("_o1", False),))


def from_files(spark: SparkSession, *paths: str, include: list[str] | None = None, exclude: list[str] | None = None, max_depth: int | None = None) -> Lines:
    """The lines of text files below paths, in order of path components. Globs apply to file names, exclusion wins. Lines keep their number per file."""
    files = spark.read.option("recursiveFileLookup", "true").text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    name = F.element_at(F.split("path", "/"), -1)
    if include:
        files = files.filter(_any_glob(name, include))
    if exclude:
        files = files.filter(~_any_glob(name, exclude))
    if max_depth is not None:
        roots = min(p.rstrip("/").count("/") for p in paths)
        files = files.filter(F.size(F.split(F.regexp_replace("path", "^[a-z]+:/*", "/"), "/")) - 1 - roots <= max_depth)
    cut = files.select(F.split("path", "/").alias("_o0"), "path", F.posexplode(split_lines(F.col("value"))).alias("_o1", "content"))
    return _numbered(cut, F.col("path"))


def _any_glob(name: Column, globs: list[str]) -> Column:
    return F.lit(False) if not globs else name.rlike("|".join(f"(?:{fnmatch.translate(g).replace(chr(92) + 'Z', '$').replace(chr(92) + 'z', '$')})" for g in globs))


def from_local(spark: SparkSession, lines: list[str], name: str = "") -> Lines:
    """Lines at hand, such as standard input."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "_o1 int, content string")
    return replace(_numbered(df, F.lit(name)), order=(("_o1", False),))


def listing(spark: SparkSession, *paths: str) -> DataFrame:
    """path, bytes: the files below paths."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", F.col("length").alias("bytes"))
