"""Rules over lines: redaction, pattern sets, rewriting, a rule engine, linting and state machines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_rules import java_regex, number, replace_all
from ..sources.lines import EMPTY_FIELDS

#: What redaction detects.
DETECTORS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2})[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "phone": r"(?:\+1[\s-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "api_key": r"(?i)(?:api[_-]?key|apikey|token|secret|password)\s*[:=]\s*[\"']?([A-Za-z0-9_\-]{16,})[\"']?",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "private_key": r"-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+)?PRIVATE KEY-----",
}


def linear(pattern: str) -> str:
    """A detector as engines of linear time understand it: words and white space are ASCII, and (?i) in front also folds the long s and the Kelvin sign."""
    fold, out = pattern.startswith("(?i)"), ""
    word = "[A-Za-z0-9_]"
    also = {"s": "\u017f", "k": "\u212a"}
    for p in re.findall(r"\[(?:\\.|[^\]\\])*\]|\\.|.", pattern, re.S):
        if len(p) > 2:  # a class
            folded = "".join(x for c, x in also.items() if re.match(p, c, re.I)) if fold and p[1] != "^" else ""
            out += p[:-1].replace(r"\s", r" \t\n\f\r") + folded + "]"
        elif p == r"\b":
            out += f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))"
        elif p == r"\s":
            out += r"[ \t\n\f\r]"
        else:
            out += f"[{p}{also[p.lower()]}]" if fold and p.lower() in also else p
    return out


def detections(df: DataFrame, text_col: str, detectors: dict[str, str] | None = None) -> DataFrame:
    """detector, texts, matches: how many texts hold what, and how often."""
    rules = detectors or DETECTORS
    t = F.coalesce(text_col, F.lit(""))
    n = df.select(*[(F.size(F.split(t, linear(p), -1)) - 1).alias(k) for k, p in rules.items()])
    sums = n.agg(*[F.struct(F.lit(k).alias("detector"), F.coalesce(F.count_if(F.col(k) > 0), F.lit(0)).alias("texts"), F.coalesce(F.sum(k), F.lit(0)).alias("matches")).alias(k) for k in rules])
    return sums.select(F.explode(F.array(*rules)).alias("x")).select("x.*")


def redacted(text: Column, how: str = "full", detectors: dict[str, str] | None = None) -> Column:
    """Text without what the detectors find. Of overlapping finds the earliest wins, and of those at one place the first detector.

    how: full ([NAME]), partial (first and last two letters stay), hash (8 hex digits) or remove.
    """
    rules = detectors or DETECTORS
    whole = "|".join(f"(?:{p})" for p in rules.values())
    between, found = F.split(text, whole, -1), F.regexp_extract_all(text, F.lit(whole), F.lit(0))

    def hidden(m: Column) -> Column:
        if how == "remove":
            return F.lit("")
        if how == "hash":
            return F.concat(F.lit("["), F.left(F.sha2(m, 256), F.lit(8)), F.lit("]"))
        if how == "partial":
            return F.when(F.length(m) > 4, F.concat(F.left(m, F.lit(2)), F.repeat(F.lit("*"), F.length(m) - 4), F.right(m, F.lit(2)))).otherwise(F.repeat(F.lit("*"), F.length(m)))
        name = F.lit("REDACTED")
        for k, p in reversed(rules.items()):
            name = F.when(m.rlike(f"^(?:{p})$"), F.lit(k.upper())).otherwise(name)
        return F.concat(F.lit("["), name, F.lit("]"))

    made = F.transform(between, lambda b, i: F.concat(b, F.when(i < F.size(found), hidden(F.get(found, i))).otherwise("")))
    return F.when(text.rlike(whole), F.array_join(made, "")).otherwise(text)


def redacted_in_turn(text: Column, detectors: dict[str, str] | None = None) -> Column:
    """Text with [NAME] for what each detector finds, one detector after the other: each sees what those before it have left."""
    for k, p in (detectors or DETECTORS).items():
        text = F.regexp_replace(text, linear(p), f"[{k.upper()}]")
    return text


def scan(df: DataFrame, content: str, patterns: dict[str, str]) -> DataFrame:
    """df with name and match: a row for each match of each named pattern."""
    found = [_named(n, F.regexp_extract_all(F.col(content), F.lit(java_regex(p)), F.lit(0))) for n, p in patterns.items()]
    return df.select("*", F.explode(F.concat(*found)).alias("_m")).select(*df.columns, "_m.name", "_m.match")


def _named(name: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(name).alias("name"), m.alias("match")))


@dataclass(frozen=True)
class Rewrite:
    """scope: all, lines (with lines), matching or exclude (with only)."""

    pattern: str
    to: str
    scope: str = "all"
    lines: tuple[int, int] = (1, 1)
    only: str = ""


def rewritten(rules: list[Rewrite], passes: int = 1, content: str = "content", line: str = "source_line") -> Column:
    """The line after all rules, in order, passes times."""
    text = F.col(content)
    for _ in range(passes):
        for r in rules:
            here = {"all": lambda: F.lit(True), "lines": lambda: F.col(line).between(*r.lines), "matching": lambda: text.rlike(java_regex(r.only)), "exclude": lambda: ~text.rlike(java_regex(r.only))}[r.scope]()
            text = F.when(here, replace_all(text, r.pattern, r.to)).otherwise(text)
    return text


@dataclass(frozen=True)
class Rule:
    """when: (kind, value) of contains, not_contains, starts, ends, equals, matches, longer, shorter, empty, field_equals, field_above; then: (kind, value) of replace, prefix, suffix, upper, lower, trim, drop, tag, route."""

    id: str
    when: tuple
    then: tuple
    priority: int = 0


def _met(when: tuple) -> Column:
    kind, v = when[0], when[1] if len(when) > 1 else None
    c = F.col("content")
    word = lambda i: F.get(F.split(F.trim(c), r"\s+"), F.lit(i))
    return F.coalesce({
        "contains": lambda: c.contains(v), "not_contains": lambda: ~c.contains(v), "starts": lambda: c.startswith(v), "ends": lambda: c.endswith(v), "equals": lambda: c == v,
        "matches": lambda: c.rlike(java_regex(v)), "longer": lambda: F.octet_length(c) > v, "shorter": lambda: F.octet_length(c) < v, "empty": lambda: F.trim(c) == "",
        "field_equals": lambda: word(v[0]) == v[1], "field_above": lambda: number(word(v[0])) > v[1],
    }[kind](), F.lit(False))


def engine(df: DataFrame, rules: list[Rule], first_only: bool = False) -> DataFrame:
    """df with result (null where dropped), tags, routes and fired (rule ids). Conditions see the line as it came."""
    text, tags, routes, fired, done = F.col("content"), F.array().cast(EMPTY_FIELDS), F.array().cast(EMPTY_FIELDS), F.array().cast(EMPTY_FIELDS), F.lit(False)
    for r in sorted(rules, key=lambda r: -r.priority):
        hit = _met(r.when) & ~done if first_only else _met(r.when)
        kind, v = r.then[0], r.then[1] if len(r.then) > 1 else None
        if kind in ("tag", "route"):
            held = tags if kind == "tag" else routes
            held = F.when(hit, F.array_append(held, F.lit(v))).otherwise(held)
            tags, routes = (held, routes) if kind == "tag" else (tags, held)
        else:
            made = {"replace": lambda: replace_all(text, *v), "prefix": lambda: F.concat(F.lit(v), text), "suffix": lambda: F.concat(text, F.lit(v)), "upper": lambda: F.upper(text), "lower": lambda: F.lower(text), "trim": lambda: F.trim(text), "drop": lambda: F.lit(None).cast("string")}[kind]()
            text = F.when(hit, made).otherwise(text)
        fired = F.when(hit, F.array_append(fired, F.lit(r.id))).otherwise(fired)
        done = done | hit
    return df.select("*", text.alias("result"), tags.alias("tags"), routes.alias("routes"), fired.alias("fired"))


def lint(lines: DataFrame, *, long: int = 120, blanks: int = 2) -> DataFrame:
    """source_file, source_line, rule: trailing white space, long lines (bytes), tabs as indents, marks of work to do, too many blank lines."""
    c = F.col("content")
    found = {"trailing_whitespace": c.rlike(r"[ \t]+$"), "long_line": F.octet_length(c) > long, "tab_indent": c.rlike(r"^\t"), "todo_marker": c.rlike(r"\b(?:TODO|FIXME|XXX|HACK)\b")}
    plain = lines.select("source_file", "source_line", F.explode(F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in found.items()]))).alias("rule"))
    by = Window.partitionBy("source_file").orderBy("source_line")
    blank = lines.select("source_file", "source_line", (F.trim("content") == "").cast("int").alias("b"))
    runs = blank.withColumn("n", F.sum("b").over(by.rowsBetween(-blanks, 0)))
    return plain.unionByName(runs.filter(F.col("n") == blanks + 1).select("source_file", "source_line", F.lit("consecutive_blanks").alias("rule")))


@dataclass(frozen=True)
class Transition:
    state: str
    pattern: str
    to: str
    emit: str | None = None


def machine(df: DataFrame, key: str, order: str, content: str, start: str, transitions: list[Transition]) -> DataFrame:
    """key, order, state, emitted: the state after each row of a key, by the first transition that fits.

    Which transitions fit a row is found by expressions; only their numbers go through the machine, key by key.
    """
    fits = F.array_compact(F.array(*[F.when(F.col(content).rlike(java_regex(t.pattern)), F.lit(i)) for i, t in enumerate(transitions)]))
    rows = df.select(F.col(key).alias("key"), F.col(order).alias("at"), fits.alias("fits"))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, start
        for b in batches:
            out, emitted = [], []
            for k, fit in zip(b["key"], b["fits"], strict=True):
                if k != last:
                    last, state = k, start
                said = None
                for i in fit:
                    if transitions[i].state == state:
                        state, said = transitions[i].to, transitions[i].emit
                        break
                out.append(state)
                emitted.append(said)
            yield pd.DataFrame({"key": b["key"], "at": b["at"], "state": out, "emitted": emitted})

    dealt = rows.repartition("key").sortWithinPartitions("key", "at")
    return dealt.mapInPandas(run, f"key {kinds[key]}, at {kinds[order]}, state string, emitted string")


def reachable(start: str, transitions: list[Transition]) -> set[str]:
    found, todo = {start}, [start]
    while todo:
        here = todo.pop()
        for t in transitions:
            if t.state == here and t.to not in found:
                found.add(t.to)
                todo.append(t.to)
    return found
