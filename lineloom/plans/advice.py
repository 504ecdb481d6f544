"""What could be better about a list of stages: advice only, as Catalyst plans what runs."""

from __future__ import annotations

from .language import Stage

#: What stages do to their lines.
KINDS = {"find": "selective", "filter": "selective", "delete": "selective", "unique": "selective", "sort": "reordering", "take": "truncating", "skip": "truncating", "last": "truncating", "count": "aggregating", "aggregate": "aggregating", "group": "aggregating"}


def advice(stages: list[Stage]) -> list[str]:
    """Filters behind a sort, stages behind a total, stages that repeat."""
    out = []
    for before, s in zip(stages, stages[1:], strict=False):
        if s.name in ("find", "filter", "delete") and before.name == "sort" and "max" not in s.args:
            out.append(f"{s.name} could come before sort: it leaves fewer lines to order")
        if before.name in ("count", "aggregate") and s.name in ("sort", "unique", "take", "last"):
            out.append(f"{s.name} after {before.name} sees a single line")
        if s == before and s.name in ("sort", "unique", "find", "filter", "delete"):
            out.append(f"{s.name} is there twice")
    return out


def profile_advice(profile: list[dict]) -> list[str]:
    """profile: from compiler.observed. Stages that change nothing, and filters that come late and leave little."""
    out = [f"{p['stage']} keeps all {p['in']} lines" for p in profile if p["in"] == p["out"] and KINDS.get(p["stage"]) == "selective"]
    return out + [f"{p['stage']} keeps few of its lines and could come earlier" for i, p in enumerate(profile) if i and KINDS.get(p["stage"]) == "selective" and p["out"] * 10 < p["in"]]
