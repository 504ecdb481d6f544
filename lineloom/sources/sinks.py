"""Tables as texts in the formats of outputs, and their writers. Writers never touch what they read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import Lines


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def json_lines(df: DataFrame) -> DataFrame:
    """value: a JSON object for each row, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def pretty_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("value"))


def csv_lines(df: DataFrame) -> DataFrame:
    """value: a row of CSV for each row; cells with commas, quotes or line ends are quoted, nulls are empty."""
    quoted = [F.when(_text(F.col(c)).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(_text(F.col(c)), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(_text(F.col(c))) for c in df.columns]
    return df.select(F.concat_ws(",", *quoted).alias("value"))


def yaml_lines(df: DataFrame) -> DataFrame:
    """value: an item of a YAML list for each row. Texts are written as JSON strings, which YAML takes as they are."""
    def scalar(c: str) -> Column:
        return F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)

    lines = [F.concat(F.lit(("- " if i == 0 else "  ") + c + ": "), scalar(c)) for i, c in enumerate(df.columns)]
    return df.select(F.array_join(F.array(*lines), "\n").alias("value"))


def human_lines(df: DataFrame) -> DataFrame:
    """value: name: value, side by side, without nulls."""
    return df.select(F.concat_ws("  ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), _text(F.col(c)))) for c in df.columns]).alias("value"))


FORMATS = {"json": json_lines, "jsonl": json_lines, "json-pretty": pretty_json, "csv": csv_lines, "yaml": yaml_lines, "human": human_lines}


def save(df: DataFrame, path: str, kind: str = "jsonl", compression: str | None = None) -> None:
    """df below a new folder; one that exists is an error. CSV files begin with their names."""
    options = {"compression": compression} if compression else {}
    if kind == "csv":
        df.write.options(header="true", escape='"', **options).csv(path)
    elif kind == "parquet":
        df.write.options(**options).parquet(path)
    else:
        FORMATS[kind](df).write.options(**options).text(path)


def save_lines(lines: Lines, path: str) -> None:
    """Lines in order, as text files whose names sort like them."""
    lines.sorted().select("content").write.text(path)
