"""Stream editing: commands with addresses over lines, with a log of changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text_rules import java_regex, replace_all, replace_first
from ..plans.compiler import between_mask
from ..sources.lines import EMPTY_FIELDS, Lines


@dataclass(frozen=True)
class Command:
    """kind: substitute, delete, before, after or transliterate. Addresses hold for the line as it was read."""

    kind: str
    pattern: str = ""
    text: str = ""
    every: bool = True
    ignore_case: bool = False
    lines: tuple[int, int] | None = None
    between: tuple[str, str] | None = None


def parse_substitution(expression: str) -> Command:
    """s/pattern/text/flags with any sign in place of /; flags: g, i."""
    if len(expression) < 2 or expression[0] != "s":
        raise ValueError(f"not a substitution: {expression}")
    parts = expression[2:].split(expression[1])
    if len(parts) < 2:
        raise ValueError(f"not a substitution: {expression}")
    flags = parts[2] if len(parts) > 2 else ""
    return Command("substitute", parts[0], parts[1], "g" in flags, "i" in flags)


def apply(lines: Lines, commands: list[Command]) -> DataFrame:
    """source_file, source_line, place, content, original, changes: the lines after all commands, in order of source_line and place.

    Each line goes through all commands; a deletion ends them and leaves a row without content.
    """
    frame = lines
    for i, c in enumerate(commands):
        if c.between:
            one, two = c.between
            frame = between_mask(frame, F.col("content").rlike(java_regex(one)), F.col("content").rlike(java_regex(two)), per_file=True)
            frame = frame.put(**{f"_in{i}": F.col("_in")})
    text, gone, before, after, changes = F.col("content"), F.lit(False), F.array().cast(EMPTY_FIELDS), F.array().cast(EMPTY_FIELDS), F.array().cast(EMPTY_FIELDS)
    for i, c in enumerate(commands):
        here = ~gone
        if c.lines:
            here = here & F.col("source_line").between(*c.lines)
        if c.between:
            here = here & F.col(f"_in{i}")
        hit = here & text.rlike(java_regex(c.pattern, c.ignore_case)) if c.kind != "transliterate" else here
        if c.kind == "substitute":
            made = (replace_all if c.every else replace_first)(text, c.pattern, c.text, c.ignore_case)
        elif c.kind == "transliterate":
            if len(c.pattern) != len(c.text):
                raise ValueError("both sides of a transliteration need the same length")
            made = F.translate(text, c.pattern, c.text)
        else:
            made = text
        if c.kind in ("substitute", "transliterate"):
            changes = F.when(hit & (made != text), F.array_append(changes, F.lit(c.kind))).otherwise(changes)
            text = F.when(hit, made).otherwise(text)
            continue
        changes = F.when(hit, F.array_append(changes, F.lit("deletion" if c.kind == "delete" else "insertion"))).otherwise(changes)
        if c.kind == "delete":
            gone = gone | hit
        elif c.kind == "before":
            before = F.when(hit, F.array_append(before, F.lit(c.text))).otherwise(before)
        else:
            after = F.when(hit, F.array_append(after, F.lit(c.text))).otherwise(after)
    own = F.array(F.when(~gone, text))
    parts = F.concat(before, own, after)
    made = frame.df.select("source_file", "source_line", F.col("content").alias("original"), changes.alias("changes"), F.posexplode(parts).alias("place", "content"))
    return made.select("source_file", "source_line", "place", "content", "original", "changes")


def result(lines: Lines, commands: list[Command]) -> DataFrame:
    """source_file, source_line, place, content: what is left."""
    return apply(lines, commands).filter("content is not null").select("source_file", "source_line", "place", "content")


def change_log(lines: Lines, commands: list[Command]) -> DataFrame:
    """source_file, line_number, change_type, original, replacement: one row for each change of a line."""
    df = apply(lines, commands).filter(F.size("changes") > 0)
    one = df.groupBy("source_file", "source_line", "original", "changes").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda x: x["content"]), "\n").alias("replacement"))
    return one.select("source_file", F.col("source_line").alias("line_number"), F.explode("changes").alias("change_type"), "original", "replacement")


def totals(lines: Lines, commands: list[Command]) -> DataFrame:
    """source_file, changes."""
    return change_log(lines, commands).groupBy("source_file").agg(F.count("*").alias("changes"))


def transliterated(text: Column, source: str, target: str) -> Column:
    if len(source) != len(target):
        raise ValueError("both sides of a transliteration need the same length")
    return F.translate(text, source, target)
