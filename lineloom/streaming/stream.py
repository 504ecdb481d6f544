"""Streams of lines and events: what works on each line as in a batch, and windows with watermarks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compiler import STEPS, QueryError
from ..plans.language import parse
from ..sources.lines import EMPTY_FIELDS, Lines

#: Stages that need no other line.
STATELESS = {"find", "replace", "delete", "select", "filter", "separator", "let"}


def lines_from(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """source_file, content: the lines of text files as they arrive in a folder."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", "\r$", "").alias("content"))


def query_stream(lines: DataFrame, text: str) -> DataFrame:
    """The stages of a query over a stream of lines; only stages that look at one line at a time, and a last count or group over all so far."""
    held = Lines(lines.withColumns({"source_line": F.lit(0).cast("long"), "fields": F.array().cast(EMPTY_FIELDS)}))
    stages = parse(text)
    for i, s in enumerate(stages):
        limited = {"max", "between", "lines"} & s.args.keys()
        last = i == len(stages) - 1 and s.name in ("count", "aggregate")
        if not (s.name in STATELESS and not limited or last):
            raise QueryError(f"{s.name} needs the order of all lines, which a stream doesn't have")
        held = STEPS[s.name](replace(held, order=()), s.args)
    return held.rows()


def buckets(events: DataFrame, width: str, late: str, ts: str = "ts", value: str = "value", slide: str | None = None) -> DataFrame:
    """start, end, count, sum, min, max of event-time windows; events later than `late` are left out."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    made = events.withWatermark(ts, late).groupBy(window.alias("w")).agg(F.count("*").alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return made.select("w.start", "w.end", "count", "sum", "min", "max")


def sessions(events: DataFrame, key: str, gap: str, late: str, ts: str = "ts") -> DataFrame:
    """key, start, end, count: runs of a key's events without a pause of gap."""
    made = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("count"))
    return made.select(key, "w.start", "w.end", "count")


def first_seen(events: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
