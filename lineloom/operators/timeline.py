"""Events in time: buckets without gaps, anomalies, gaps, sparklines and duration histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
GLYPHS = "▁▂▃▄▅▆▇█"


def parse_timestamp(line: Column) -> Column:
    """Seconds since 1970 at the begin of a line: a whole number of the years 2000 to 2100, or date and time; offsets are ignored."""
    epoch = F.regexp_extract(line, r"^\s*(\d{9,10})(?:\D|$)", 1).try_cast("long")
    iso = F.regexp_extract(line, r"^\s*(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})", 1)
    parsed = F.unix_timestamp(F.try_to_timestamp(F.replace(iso, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.when((epoch > 946684800) & (epoch < 4102444800), epoch).otherwise(F.when(iso != "", parsed))


def events_of(lines: DataFrame, column: str = "content") -> DataFrame:
    """ts, label, value: lines that begin with a time."""
    return lines.select(parse_timestamp(F.col(column)).alias("ts"), F.col(column).alias("label"), F.lit(1.0).alias("value")).filter("ts is not null")


def buckets(events: DataFrame, granularity: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """start, end, count, sum, min, max: tumbling buckets from the first event to the last, empty ones with 0.

    The grid is made from two numbers; its size is the span, whatever the number of events.
    """
    step = STEPS[granularity]
    start = F.expr(f"({ts} div {step}) * {step}")
    found = events.groupBy(start.cast("long").alias("start")).agg(F.count("*").alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    grid = found.agg(F.min("start").alias("lo"), F.max("start").alias("hi")).filter("lo is not null").select(F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("start"))
    joined = grid.join(found, "start", "left")
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return joined.select("start", (F.col("start") + step).alias("end"), zero("count", 0), zero("sum", 0.0), zero("min", 0.0), zero("max", 0.0))


def average(bucketed: DataFrame) -> DataFrame:
    return bucketed.withColumn("avg", F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0))


def spikes(bucketed: DataFrame, threshold: float) -> DataFrame:
    """start, count, z, kind: buckets whose count lies more than threshold deviations from the mean, of three buckets or more."""
    whole = bucketed.agg(F.avg("count").alias("mean"), F.stddev_pop("count").alias("sd"), F.count("*").alias("n")).filter("n >= 3 and sd >= 1e-9")
    z = (F.col("count") - F.col("mean")) / F.col("sd")
    scored = bucketed.join(F.broadcast(whole)).withColumn("z", z)  # one row
    return scored.filter(F.abs("z") > threshold).select("start", "count", "z", F.when(F.col("z") > 0, "spike").otherwise("drop").alias("kind"))


def gaps(bucketed: DataFrame, least: int = 3) -> DataFrame:
    """start, end, buckets: runs of least empty buckets or more in front of one that isn't; the buckets with events are what is ordered."""
    step = F.col("end") - F.col("start")
    full = bucketed.filter("count > 0").select("start", "end", step.alias("step"))
    before = F.lag("end").over(Window.orderBy("start"))
    return full.withColumn("from", before).filter((F.col("start") - F.col("from")) / F.col("step") >= least).select(F.col("from").alias("start"), F.col("start").alias("end"), ((F.col("start") - F.col("from")) / F.col("step")).cast("long").alias("buckets"))


def sparkline(bucketed: DataFrame) -> DataFrame:
    """line: a glyph for each bucket, by count."""
    counts = F.transform(F.array_sort(F.collect_list(F.struct("start", "count"))), lambda x: x["count"])
    glyph = lambda top: lambda c: F.element_at(F.array(*map(F.lit, GLYPHS)), (F.round(c / top * 7) + 1).cast("int"))
    return bucketed.agg(counts.alias("c")).select(F.array_join(F.transform("c", glyph(F.greatest(F.array_max("c"), F.lit(1)))), "").alias("line"))


SPAN = 3600


def durations(events: DataFrame, ts: str, key: str | None) -> DataFrame:
    """d, n: the time between one event and the next (of a key), and how often.

    Events of a moment are counted first. What is ordered in one task is the moments of an hour; hours meet in a table
    with a row for each.
    """
    by = [F.col(key).alias("k")] if key else [F.lit(0).alias("k")]
    moments = events.filter(F.col(ts).isNotNull()).groupBy(*by, F.col(ts).alias("t")).agg(F.count("*").alias("n")).withColumn("hour", F.floor(F.col("t") / SPAN))
    within = moments.select("n", (F.col("t") - F.lag("t").over(Window.partitionBy("k", "hour").orderBy("t"))).alias("d"))
    hours = moments.groupBy("k", "hour").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    between = hours.select((F.col("lo") - F.lag("hi").over(Window.partitionBy("k").orderBy("hour"))).alias("d"), F.lit(1).cast("long").alias("n"))
    steps = within.select("d", F.lit(1).cast("long").alias("n")).unionByName(between).filter("d is not null")
    same = moments.filter("n > 1").select((F.col("t") - F.col("t")).alias("d"), (F.col("n") - 1).alias("n"))
    return steps.unionByName(same).select(F.col("d").cast("double").alias("d"), "n").groupBy("d").agg(F.sum("n").alias("n"))


def duration_histogram(events: DataFrame, bins: int, ts: str = "ts", key: str | None = None) -> DataFrame:
    """bin, low, high, n: the time between one event and the next (of a key), in bins of equal width; the last one is closed."""
    deltas = durations(events, ts, key)
    range_ = F.broadcast(deltas.agg(F.min("d").alias("lo"), F.max("d").alias("hi")))  # one row
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    at = F.least(F.floor((F.col("d") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    placed = deltas.join(range_).select("n", at.alias("bin"), (F.col("lo") + at * width).alias("low"), (F.col("lo") + (at + 1) * width).alias("high"))
    return placed.groupBy("bin").agg(F.min("low").alias("low"), F.min("high").alias("high"), F.sum("n").alias("n"))


def cumulative_histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """le, n: how many values are at most each bound, and all; with the sum and the count of values beside each."""
    counts = [F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds]
    made = df.agg(F.array(*counts, F.struct(F.lit("+Inf").alias("le"), F.count(value).alias("n"))).alias("x"), F.sum(value).alias("total"), F.count(value).alias("count"))
    return made.select(F.explode("x").alias("x"), "total", "count").select("x.le", "x.n", "total", "count")
