"""Multi-party perspective rotation: each dialogue once for every participant, with that speaker as the assistant.

The other speakers become users named by their role; system turns stay system turns and are nobody's perspective.
The mask holds the character ranges of what the assistant says, which are what a model is trained on.

A rendering comes in segments of SEGMENT_TURNS turn numbers, which follow one another; a segment with more turns
than that (turns that share a number) is dealt on into parts by the turns' hash, so that no task collects an unbounded dialogue.

Defined results: rows equal in dialogue, turn, role and text are one turn; turns that share a number are ordered by
their hash; a null text is empty, a null role is "unknown", a null turn comes first, null dialogues form one
dialogue; a dialogue of system turns only has no rendering; other columns play no part. The markers of the format
are escaped where texts or roles hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT_TURNS = 64
OPEN, END = "<|", "<|end|>\n"


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, perspective, segment, part, n_turns, text, mask (array of start and stop in characters)."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(OPEN), F.lit("<\\|")).alias("said")).distinct()
    rows = rows.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), F.lit(-1).cast("long"))).withColumn("h", F.xxhash64("role", "said"))
    crowded = rows.groupBy("conv", "segment").agg(F.count("*").alias("n")).filter(F.col("n") > SEGMENT_TURNS).select(F.col("conv").alias("c"), F.col("segment").alias("s"), F.ceil(F.log2(F.col("n") / SEGMENT_TURNS)).cast("int").alias("bits"))
    rows = rows.join(crowded, F.col("conv").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")), "left")
    # within a turn number parts follow the order of hashes; a crowded segment has parts for each turn number
    part = F.when(F.col("bits").isNull(), F.struct(F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("bucket"))).otherwise(F.struct("turn", F.call_function("shiftright", F.expr("h"), F.lit(64) - F.least(F.col("bits"), F.lit(62))).alias("bucket")))
    rows = rows.select("conv", "segment", part.alias("part"), "turn", "h", "role", "said")
    cast = rows.filter("role <> 'system'").select(F.col("conv").alias("c"), F.col("role").alias("perspective")).distinct()
    seen = rows.join(cast, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    name = F.replace(F.replace(F.col("role"), F.lit(OPEN), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))
    header = F.when(F.col("role") == "system", F.lit("<|system|>")).when(F.col("role") == F.col("perspective"), F.lit("<|assistant|>")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>")))
    shown = seen.select("conv", "perspective", "segment", "part", "turn", "h", F.concat(header, "said", F.lit(END)).alias("line"), F.length(header).alias("skip"), (F.col("role") == F.col("perspective")).alias("own"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "h", "line", "skip", "own")))
    grouped = shown.groupBy("conv", "perspective", "segment", "part").agg(lines.alias("lines"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("mask"))

    def step(acc, x):
        stop = acc["at"] + F.length(x["line"])
        span = F.array(F.struct((acc["at"] + x["skip"]).alias("start"), (stop - len(END)).alias("stop")))
        return F.struct(stop.alias("at"), F.when(x["own"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("lines", begin, step)["mask"]
    return grouped.select("conv", "perspective", "segment", "part", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("text"), mask.alias("mask"))


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '<\\|') AS said, turn // 64 AS segment FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT *, CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || name || '|>' END || said || '<|end|>' || chr(10) AS line FROM (SELECT t.*, replace(replace(t.role, '<|', '<\\|'), '|>', '|\\>') AS name FROM t) JOIN p USING (conv_id)),
l AS (SELECT *, CAST(sum(length(line)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn) AS BIGINT) AS stop FROM r)
SELECT conv_id, perspective, segment, CAST(-1 AS BIGINT) AS part_turn, CAST(0 AS BIGINT) AS part_bucket, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn)) AS text_sha256,
       sha256(coalesce(string_agg((stop - length(line) + 13) || '-' || (stop - 8), ',' ORDER BY turn) FILTER (WHERE role = perspective), '')) AS mask_sha256,
       CAST(sum(CASE WHEN role = perspective THEN 1 ELSE 0 END) AS BIGINT) AS n_masks, CAST(sum(CASE WHEN role = perspective THEN length(said) ELSE 0 END) AS BIGINT) AS masked_chars
FROM l GROUP BY conv_id, perspective, segment
"""
