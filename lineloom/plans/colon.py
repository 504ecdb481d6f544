"""The short pipeline syntax, `name:arguments | name:arguments`, and the same as a mapping (from YAML or JSON)."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text_rules import java_regex, number, replace_all, replace_first, split_fields
from ..operators.transform import parse_substitution
from ..sources.lines import Lines
from .compiler import on_count, on_last, on_take
from .language import QueryError, Stage

#: Stage names with their other spellings.
NAMES = {"grep": "search", "find": "search", "sed": "transform", "replace": "transform", "uniq": "unique", "awk": "analyze"}


def parse(text: str) -> list[Stage]:
    """Bars always separate stages, also within patterns."""
    return [_stage(part.strip()) for part in text.split("|") if part.strip()]


def _stage(part: str) -> Stage:
    name, _, args = (x.strip() for x in part.partition(":"))
    name = NAMES.get(name.lower(), name.lower())
    whole = int(args) if args.isdigit() else None
    if name in ("search", "filter"):
        return Stage(name, {"pattern": args, "case_sensitive": True})
    if name == "transform":
        pattern, arrow, to = args.partition("->")
        if arrow:
            return Stage(name, {"pattern": pattern.strip(), "replacement": to.strip(), "global": True})
        try:
            c = parse_substitution(args)
        except ValueError as e:
            raise QueryError(str(e)) from e
        return Stage(name, {"pattern": c.pattern, "replacement": c.text, "global": c.every})
    if name == "sort":
        words = args.split()
        return Stage(name, {"field": next((int(w) for w in words if w.isdigit()), None), "reverse": bool(re.search("-r|reverse", args)), "numeric": bool(re.search("-n|numeric", args))})
    if name == "unique":
        return Stage(name, {"field": whole})
    if name in ("head", "tail"):
        return Stage(name, {"count": 10 if whole is None else whole})
    if name == "count":
        return Stage(name, {"pattern": args or None})
    if name == "analyze":
        return Stage(name, {"select_fields": [int(x) for x in args.split(",") if x.strip().isdigit()]})
    raise QueryError(f"unknown stage {name}")


def from_mapping(stages: list[dict]) -> list[Stage]:
    """Stages as mappings with a `type`; a search is then not case-sensitive unless it says so."""
    return [Stage(s["type"], {"case_sensitive": False, **{k: v for k, v in s.items() if k != "type"}}) for s in stages]


def _key(n: int | None) -> Column:
    """A stored field (from an analyze stage), or the line where there are none."""
    return F.col("content") if n is None else F.when(F.size("fields") > 0, F.coalesce(F.get("fields", F.lit(max(n, 1) - 1)), F.lit(""))).otherwise(F.col("content"))


def run(lines: Lines, stages: list[Stage]) -> Lines:
    for s in stages:
        a = s.args
        if s.name in ("search", "filter"):
            lines = lines.keep(F.col("content").rlike(java_regex(a["pattern"], s.name == "search" and not a.get("case_sensitive", False))))
        elif s.name == "transform":
            lines = lines.put(content=(replace_all if a.get("global", True) else replace_first)(F.col("content"), a["pattern"], a["replacement"]))
        elif s.name == "analyze":
            if a.get("pattern"):
                lines = lines.keep(F.col("content").rlike(java_regex(a["pattern"])))
            every = split_fields(F.col("content"), a.get("field_separator", r"\s+"))
            picked = F.array(*[F.coalesce(F.get(every, F.lit(max(n, 1) - 1)), F.lit("")) for n in a["select_fields"]]) if a.get("select_fields") else every
            lines = lines.put(fields=picked)
        elif s.name == "sort":
            name, key = lines.new_order(), _key(a.get("field"))
            made = lines.put(**{name: F.coalesce(number(key), F.lit(0.0)) if a.get("numeric") else key})
            lines = replace(made, order=((name, bool(a.get("reverse"))), *lines.order))
        elif s.name == "unique":
            first = lines.first_key()
            if first is None:
                raise QueryError("unique needs an ascending order")
            df = lines.df.groupBy(_key(a.get("field")).alias("_key")).agg(F.min_by(F.struct(*lines.df.columns), first).alias("_x")).select("_x.*")
            lines = replace(lines, df=df)
        elif s.name in ("head", "tail"):
            lines = (on_take if s.name == "head" else on_last)(lines, {"n": a.get("count", 10)})
        elif s.name == "count":
            lines = on_count(lines, {"pattern": ("regex", a["pattern"]) if a.get("pattern") else None})
        else:
            raise QueryError(f"unknown stage {s.name}")
    return lines


def explain(stages: list[Stage]) -> list[str]:
    return [f"{i}. {s.name} " + ", ".join(f"{k}={v!r}" for k, v in s.args.items() if v not in (None, [], False)) for i, s in enumerate(stages, 1)]
