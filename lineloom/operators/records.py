"""Records: lines as numbered fields, rules that pick and compute, and aggregations over what they emit."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_rules import java_regex, number, split_fields
from ..plans.compiler import condition
from ..sources.lines import Lines

BLANK = r"^[\s\x{0085}\p{Z}]+|[\s\x{0085}\p{Z}]+$"


@dataclass(frozen=True)
class Rule:
    """pattern: on the untrimmed line; condition: as in queries; fields: which to keep (none: all); computed: name to a function of the fields' column."""

    pattern: str | None = None
    condition: tuple | None = None
    fields: tuple[int, ...] = ()
    computed: dict = field(default_factory=dict)


def records(lines: Lines, rules: list[Rule] | None = None, *, skip_lines: int = 0, skip_header: bool = False, max_records: int | None = None) -> DataFrame:
    """source_file, source_line, nr, nf, rule, fields, computed: a row for each rule that a record meets. nr counts records in a file."""
    rules = rules or [Rule()]
    skipped = skip_lines + skip_header
    trimmed = F.regexp_replace("content", BLANK, "")
    df = lines.df.filter(F.col("source_line") > skipped).withColumn("_f", split_fields(trimmed, lines.separator))
    df = df.withColumn("nr", F.col("source_line") - skipped).withColumn("nf", F.size("_f"))
    emitted = []
    shadow = Lines(df, lines.order, lines.separator)
    for i, r in enumerate(rules):
        holds = F.lit(True)
        if r.pattern:
            holds = holds & F.col("content").rlike(java_regex(r.pattern))
        if r.condition:
            holds = holds & condition(shadow, r.condition)
        fields = F.array(*[F.coalesce(F.get("_f", F.lit(max(n, 1) - 1)), F.lit("")) for n in r.fields]) if r.fields else F.col("_f")
        computed = F.map_from_arrays(F.array(*map(F.lit, r.computed)), F.array(*[f(F.col("_f")) for f in r.computed.values()])) if r.computed else F.lit(None).cast("map<string,string>")
        emitted.append(F.when(holds, F.struct(F.lit(i).alias("rule"), fields.alias("fields"), computed.alias("computed"))))
    df = df.withColumn("_e", F.explode(F.array_compact(F.array(*emitted))))
    if max_records is not None:
        by = Window.partitionBy("source_file").orderBy(*[F.col(c) for c, _ in lines.order], "_e.rule")
        df = df.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= max_records)
    return df.select("source_file", "source_line", "nr", "nf", "_e.rule", "_e.fields", "_e.computed")


def aggregation(kind: str, n: int | None = None, where: Column | None = None) -> Column:
    """count, sum, avg, min, max, distinct (sorted list), freq (map) of field n of what rules emitted; count with where."""
    if kind == "count":
        return F.count("*") if where is None else F.count_if(where)
    x = F.get("fields", F.lit(max(n or 1, 1) - 1))
    v = number(x)
    return {"sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)), "avg": lambda: F.coalesce(F.avg(v), F.lit(0.0)), "min": lambda: F.min(v), "max": lambda: F.max(v), "distinct": lambda: F.array_sort(F.collect_set(x))}[kind]()


def frequencies(found: DataFrame, n: int) -> DataFrame:
    """value, n."""
    x = F.get("fields", F.lit(max(n, 1) - 1))
    return found.filter(x.isNotNull()).groupBy(x.alias("value")).agg(F.count("*").alias("n"))


def aggregation_from(spec: str) -> tuple[str, int | None]:
    """count, or kind:field."""
    kind, _, n = spec.partition(":")
    if kind not in ("count", "sum", "avg", "min", "max", "distinct", "freq") or kind != "count" and not n.isdigit():
        raise ValueError(f"not an aggregation: {spec}")
    return kind, int(n) if n else None
