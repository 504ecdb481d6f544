"""Relational tables with loosely typed keys: keys are compared as text, and null is the text NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_text(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def filter_eq(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows with the value, null included; an unknown column filters nothing."""
    return df.filter(F.col(column).eqNullSafe(F.lit(value))) if column in df.columns else df


def sort_by(df: DataFrame, column: str, descending: bool = False, then: tuple[str, ...] = ()) -> DataFrame:
    """Nulls first, descending last; then: what keeps equal rows in order."""
    return df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_first(), *then)


def group_by(df: DataFrame, key: str, column: str, function: str) -> DataFrame:
    """key (text) and the aggregate of the numbers of column; keys without a number vanish."""
    v = F.col(column).try_cast("double")
    made = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[function](v).cast("double")
    return df.filter(v.isNotNull()).groupBy(key_text(key).alias(key)).agg(made.alias(column if column != key else f"{function}_{column}"))


def inner_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Columns of the left and, with the prefix r_, those of the right without its key."""
    other = right.select(key_text(right_key).alias("_k"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != right_key])
    return left.withColumn("_l", key_text(left_key)).join(other, F.col("_l") == F.col("_k")).drop("_l", "_k")


def pivot(df: DataFrame, key: str, column: str, value: str, order: Column, values: list | None = None) -> DataFrame:
    """A row for each key, a column for each value of column (values: which, else all in text order); the last row by order wins."""
    grouped = df.groupBy(key_text(key).alias(key))
    spread = grouped.pivot(column, values) if values is not None else grouped.pivot(column)
    return spread.agg(F.max_by(value, order))


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unknown names are left out."""
    return df.select(*[c for c in columns if c in df.columns])


def aggregate(df: DataFrame, column: str, function: str) -> DataFrame:
    v = F.col(column).try_cast("double")
    return df.agg({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[function](v).alias(function))


def from_csv(lines: DataFrame, column: str, header: list[str], separator: str = ",") -> DataFrame:
    """Plain comma splitting, trimmed, all text; a row of another width is an error."""
    parts = F.transform(F.split(column, separator.replace("|", r"\|"), -1), lambda x: F.trim(x))
    checked = F.when(F.size(parts) == len(header), parts).otherwise(F.raise_error(F.concat(F.lit("row of another width: "), F.col(column))))
    return lines.select(checked.alias("_p")).select(*[F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(header)])


def to_csv(df: DataFrame, separator: str = ",") -> DataFrame:
    """value: rows without quotes."""
    return df.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))
