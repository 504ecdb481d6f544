"""Log lines: formats, severities, filters, statistics and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities from low to high, other spellings, and the keys under which formats keep what.
SEVERITIES = ["trace", "debug", "info", "warn", "error", "fatal"]
SPELLINGS = {"warning": "warn", "err": "error", "critical": "fatal", "crit": "fatal", "panic": "fatal", "emerg": "fatal", "notice": "info", "information": "info"}
LEVEL_KEYS, MESSAGE_KEYS, TIME_KEYS = ["level", "lvl", "severity"], ["msg", "message"], ["ts", "timestamp", "time", "t"]
FIELDS = "map<string,string>"


def severity_of(word: Column) -> Column:
    w = F.lower(F.trim(word))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv]), w), w)
    return F.when(named.isin(SEVERITIES), named)


def rank(severity: Column) -> Column:
    """Place in the order of severities, null for unknown ones."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0))


def severity_in(text: Column) -> Column:
    """By words in the text: the first that occurs of fatal, error, warn, debug, trace, info."""
    t = F.lower(text)
    made = F.lit(None).cast("string")
    for word in reversed(["fatal", "error", "warn", "debug", "trace", "info"]):
        made = F.when(t.contains(word), F.lit(word)).otherwise(made)
    return made


def _record(format_: str, severity: Column, timestamp: Column, message: Column, fields: Column) -> Column:
    return F.struct(F.lit(format_).alias("format"), severity.alias("severity"), timestamp.alias("timestamp"), message.alias("message"), fields.alias("fields"))


def _picked(fields: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at(fields, F.lit(k)) for k in keys])


def _from_fields(name: str, fields: Column, line: Column) -> Column:
    rest = F.map_filter(fields, lambda k, _: ~k.isin(LEVEL_KEYS + MESSAGE_KEYS + TIME_KEYS))
    return _record(name, severity_of(_picked(fields, LEVEL_KEYS)), _picked(fields, TIME_KEYS), F.coalesce(_picked(fields, MESSAGE_KEYS), F.lit("")), rest)


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def parse_json(line: Column) -> Column:
    fields = F.transform_keys(F.from_json(line, FIELDS), lambda k, _: F.lower(k))
    return F.when(line.rlike(r"^\s*\{"), _bound(fields, lambda f: F.when(f.isNotNull(), _from_fields("json", f, line))))


def parse_pairs(line: Column) -> Column:
    pattern = r"([A-Za-z_][\w.-]*)=(\"(?:[^\"\\]|\\.)*\"|\S*)"
    keys = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(2)), lambda v: F.regexp_replace(v, '^"|"$', ""))
    entries = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.element_at(values, F.array_position(keys, k).cast("int")).alias("value")))
    return F.when(line.rlike(pattern), _bound(F.map_from_entries(entries), lambda f: _from_fields("key=value", f, line)))


def parse_syslog(line: Column) -> Column:
    p = r"^(?:<\d+>)?([A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2})\s(\S+)\s([^\s:\[]+)(?:\[(\d+)\])?:\s?(.*)$"
    part = lambda i: F.regexp_extract(line, p, i)
    fields = F.map_filter(F.create_map(F.lit("host"), part(2), F.lit("process"), part(3), F.lit("pid"), part(4)), lambda _, v: v != "")
    return F.when(line.rlike(p), _record("syslog", severity_in(part(5)), part(1), part(5), fields))


def parse_access(line: Column) -> Column:
    p = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\S+)'
    part = lambda i: F.regexp_extract(line, p, i)
    status = part(7).try_cast("int")
    severity = F.when(status >= 500, "error").when(status >= 400, "warn").otherwise("info")
    fields = F.create_map(F.lit("host"), part(1), F.lit("method"), part(5), F.lit("path"), part(6), F.lit("status"), part(7), F.lit("bytes"), part(8))
    return F.when(line.rlike(p), _record("access", severity, part(4), F.concat(part(5), F.lit(" "), part(6), F.lit(" → "), part(7)), fields))


def parse(line: Column) -> Column:
    """The record of a line by the first format that fits: JSON, access log, syslog, key=value; null if none."""
    return F.coalesce(parse_json(line), parse_access(line), parse_syslog(line), parse_pairs(line))


def parse_all(lines: DataFrame, column: str = "content") -> DataFrame:
    """lines that aren't blank, with their record (null where no format fits)."""
    # a generator, across which no expression is copied into each use
    held = lines.select(*[c for c in lines.columns if c != column], F.explode(F.array(column)).alias(column)).filter(F.trim(column) != "").select(*lines.columns)
    return held.select("*", F.explode(F.array(parse(F.col(column)))).alias("record"))


def filtered(records: DataFrame, *, least: str | None = None, contains: str | None = None, has_field: str | None = None, field_equals: tuple[str, str] | None = None) -> DataFrame:
    """records: severity, message, fields."""
    if least:
        records = records.filter(rank(F.col("severity")) >= SEVERITIES.index(least) + 1)
    if contains:
        records = records.filter(F.col("message").contains(contains))
    if has_field:
        records = records.filter(F.map_contains_key("fields", has_field))
    if field_equals:
        records = records.filter(F.try_element_at("fields", F.lit(field_equals[0])) == field_equals[1])
    return records


def top_messages(records: DataFrame, n: int = 10) -> DataFrame:
    return records.groupBy("message").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "message").limit(n)


def alerts(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (name, least, contains) met by records. The rules are configuration, a few rows, and go to every executor."""
    r = F.broadcast(rules.select(F.col("name").alias("rule"), F.col("least"), F.col("contains").alias("_c")))
    met = (rank(F.col("severity")) >= rank(F.col("least"))) & F.col("message").contains(F.col("_c"))
    return records.join(r, met).drop("_c", "least")


def statistics(parsed: DataFrame, top: int = 10) -> DataFrame:
    """kind, value, n over parsed lines (record): records, errors (lines that no format fits), by severity, by format, top messages."""
    kinds = F.array(
        F.struct(F.when(F.col("record").isNull(), "errors").otherwise("records").alias("kind"), F.lit("").alias("value")),
        F.when(F.col("record").isNotNull(), F.struct(F.lit("severity").alias("kind"), F.coalesce("record.severity", F.lit("unknown")).alias("value"))),
        F.when(F.col("record").isNotNull(), F.struct(F.lit("format").alias("kind"), F.col("record.format").alias("value"))),
        F.when(F.col("record").isNotNull(), F.struct(F.lit("message").alias("kind"), F.col("record.message").alias("value"))),
    )
    counts = parsed.select(F.explode(F.array_compact(kinds)).alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))
    messages = counts.filter("kind = 'message'").orderBy(F.col("n").desc(), "value").limit(top)
    return counts.filter("kind <> 'message'").unionByName(messages)
