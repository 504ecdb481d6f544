"""From the stages of a query to a lazy plan over ordered lines."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text_rules import HUGE, TINY, escaped, java_regex, number, replace_all, replace_first, shown, split_fields, valid
from ..sources.lines import DATA, EMPTY_FIELDS, Lines
from .language import QueryError, Stage, parse

MAX_DEPTH = 64


def regex_of(pattern: tuple[str, str], whole_word: bool = False) -> str:
    kind, value = pattern
    made = escaped(value) if kind == "text" else value
    return rf"\b{made}\b" if whole_word else made


def matches(pattern: tuple[str, str], text: Column, ignore_case: bool = False, whole_word: bool = False) -> Column:
    if pattern[0] == "text" and not ignore_case and not whole_word:
        return text.contains(pattern[1])
    return text.rlike(java_regex(regex_of(pattern, whole_word), ignore_case))


def field(lines: Lines, n: int, zero_is_line: bool = False) -> Column:
    """Field n of a line, null where it has none; fields count from 1."""
    if n == 0 and zero_is_line:
        return F.col("content")
    return F.get(split_fields(F.col("content"), lines.separator), F.lit(max(n, 1) - 1))


def condition(lines: Lines, c: tuple) -> Column:
    kind, n, value = c
    if kind in ("and", "or"):
        left, right = condition(lines, n), condition(lines, value)
        return left & right if kind == "and" else left | right
    x = F.col("content") if n is None else field(lines, n)
    if kind == "!=":
        return F.coalesce(x != value, F.lit(True))
    if kind == "matches":
        return F.coalesce(x.rlike(java_regex(value)), F.lit(False)) if valid(value) else F.lit(False)
    made = {"contains": lambda: x.contains(value), "equals": lambda: x == value, "not_empty": lambda: F.length(x) > 0, ">": lambda: ~F.isnan(number(x)) & (number(x) > value), "<": lambda: number(x) < value}[kind]()
    return F.coalesce(made, F.lit(False))


def between_mask(lines: Lines, start: Column, end: Column, per_file: bool = False) -> Lines:
    """lines with _in: whether a line lies in a range from a start to an end, both included.

    Each line is a function of the state: into, out of, swap or nothing. Within a file the state after a line is the
    last fixed value, swapped as often as swaps follow it. Files pass their state on through a table with one
    row a file: what a file does to the state is known before the state is.
    """
    fixed = F.when(start & ~end, F.lit(True)).when(end & ~start, F.lit(False))
    acts = lines.put(_fixed=fixed, _swap=(start & end).cast("int"))
    by = Window.partitionBy("source_file").orderBy(*acts.keys())
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    swaps = F.sum("_swap").over(upto)
    marked = acts.put(_swaps=swaps).put(_mark=F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", "_swaps")))
    marked = marked.put(_last=F.last("_mark", ignorenulls=True).over(upto))
    known = F.col("_last").isNotNull()
    flips = F.when(known, F.col("_swaps") - F.col("_last._swaps")).otherwise(F.col("_swaps")) % 2 == 1
    marked = marked.put(_flips=flips)
    if per_file:
        entered = marked.put(_enter=F.lit(False))
    else:
        ends = marked.df.groupBy("source_file").agg(F.max_by(F.struct(F.col("_last._fixed").alias("fixed"), F.col("_flips").alias("flips")), F.struct(*[F.col(c) for c, _ in lines.order])).alias("e"), F.min(F.struct(*[F.col(c) for c, _ in lines.order])).alias("at"))
        over = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        # the fixing file's own flips follow its fixed value, so they count from before that file's sum
        sums = ends.select(F.col("source_file").alias("f"), F.when(F.col("e.flips"), 1).otherwise(0).alias("own"), F.col("e.fixed").alias("own_fixed"), "at")
        first = sums.select("f", "at", "own_fixed", "own", (F.sum("own").over(Window.orderBy("at")) - F.col("own")).alias("prior"))
        state = first.select("f", F.last(F.when(F.col("own_fixed").isNotNull(), F.struct("own_fixed", "prior")), ignorenulls=True).over(over).alias("l"), "prior")
        enter = F.when(F.col("l").isNotNull(), F.col("l.own_fixed") != ((F.col("prior") - F.col("l.prior")) % 2 == 1)).otherwise(F.col("prior") % 2 == 1)
        small = state.select(F.col("f").alias("source_file"), enter.alias("_enter"))
        entered = replace(marked, df=marked.df.join(small, "source_file"))
    base = F.coalesce("_last._fixed", "_enter")
    entered = entered.put(_after=base != F.col("_flips"))
    entered = entered.put(_in=F.col("_after") | F.coalesce(F.lag("_after").over(by), F.col("_enter")))
    return replace(entered, df=entered.df.drop("_fixed", "_swap", "_swaps", "_mark", "_last", "_flips", "_enter", "_after"))


def _scoped(lines: Lines, a: dict, base: Column) -> tuple[Lines, Column]:
    if "lines" in a:
        base = base & F.col("source_line").between(*a["lines"])
    if "glob" in a:
        base = base & F.col("source_file").rlike("(?:^|/)" + escaped(a["glob"]).replace(r"\*", ".*").replace(r"\?", ".") + "$")
    if "between" in a:
        one, two = a["between"]
        lines = between_mask(lines, matches(one, F.col("content")), matches(two, F.col("content")))
        base = base & F.col("_in")
    return lines, base


def on_find(lines: Lines, a: dict) -> Lines:
    found = matches(a["pattern"], F.col("content"), a.get("ignore_case", False), a.get("whole_word", False))
    lines, hit = _scoped(lines, a, ~found if a.get("invert") else found)
    lines = replace(lines.keep(hit), df=lines.keep(hit).df.drop("_in"))
    if a.get("only_match") and not a.get("invert"):
        regex = java_regex(regex_of(a["pattern"], a.get("whole_word", False)), a.get("ignore_case", False))
        lines = lines.put(content=F.regexp_extract("content", regex, 0))
    return on_take(lines, {"n": a["max"]}) if "max" in a else lines


def on_replace(lines: Lines, a: dict) -> Lines:
    lines, scope = _scoped(lines, a, F.lit(True))
    change = replace_all if a.get("all") else replace_first
    template = a["to"]
    made = change(F.col("content"), regex_of(a["pattern"]), template, a.get("ignore_case", False))
    lines = lines.put(content=F.when(scope, made).otherwise(F.col("content")))
    return replace(lines, df=lines.df.drop("_in"))


def on_delete(lines: Lines, a: dict) -> Lines:
    return lines.keep(~matches(a["pattern"], F.col("content")))


def on_insert(lines: Lines, a: dict) -> Lines:
    place = lines.new_order()
    own = F.struct("source_line", "content", "fields")
    new = F.struct(F.lit(0).cast("long").alias("source_line"), F.lit(a["text"]).alias("content"), F.array().cast(EMPTY_FIELDS).alias("fields"))
    both = F.array(new, own) if a["where"] == "before" else F.array(own, new)
    kept = ["source_file", *[c for c, _ in lines.order]]
    df = lines.df.select(*kept, F.posexplode(F.when(matches(a["pattern"], F.col("content")), both).otherwise(F.array(own))).alias(place, "_x"))
    return replace(lines, df=df.select(*kept, place, "_x.*"), order=(*lines.order, (place, False)))


def on_select(lines: Lines, a: dict) -> Lines:
    picked = F.array(*[F.coalesce(field(lines, n), F.lit("")) for n in a["fields"]])
    return lines.put(fields=picked, content=F.array_join(picked, "\t"))


def on_filter(lines: Lines, a: dict) -> Lines:
    return lines.keep(condition(lines, a["condition"]))


def on_sort(lines: Lines, a: dict) -> Lines:
    key = F.col("content") if a["field"] is None else F.coalesce(field(lines, a["field"], True), F.lit(""))
    name = lines.new_order()
    key = F.coalesce(number(key), F.lit(0.0)) if a["numeric"] else key
    return replace(lines.put(**{name: key}), order=((name, a["desc"]), *lines.order))


def on_unique(lines: Lines, a: dict) -> Lines:
    """The first line of each key: a grouped minimum, combined before it is shuffled; a window only where an order descends."""
    key = F.col("content") if a["field"] is None else F.coalesce(field(lines, a["field"], True), F.lit(""))
    held = [c for c in lines.df.columns]
    if (first := lines.first_key()) is not None:
        df = lines.df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*held), first).alias("_x")).select("_x.*")
    else:
        ranked = lines.df.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*lines.keys())))
        df = ranked.filter("_n = 1").drop("_n", "_key")
    return replace(lines, df=df)


def on_take(lines: Lines, a: dict) -> Lines:
    if lines.skipped and lines.skipped[0] is lines.df:  # straight behind skip: the first rows of all, without an order of the rest
        _, whole, n = lines.skipped
        return replace(lines, df=whole.orderBy(*lines.keys()).limit(n + a["n"]).offset(n))
    return replace(lines, df=(lines.df.orderBy(*lines.keys()) if lines.order else lines.df).limit(a["n"]))


def on_skip(lines: Lines, a: dict) -> Lines:
    left = lines.df.orderBy(*lines.keys()).offset(a["n"])
    return replace(lines, df=left, skipped=(left, lines.df, a["n"]))


def on_last(lines: Lines, a: dict) -> Lines:
    return replace(lines, df=lines.df.orderBy(*lines.keys(backwards=True)).limit(a["n"]))


def _single(lines: Lines, df: DataFrame, fields: Column) -> Lines:
    made = df.select(F.lit("").alias("source_file"), F.lit(0).cast("long").alias("source_line"), F.col("content"), fields.alias("fields"))
    return replace(lines, df=made, order=())


def on_count(lines: Lines, a: dict) -> Lines:
    n = F.count("*") if a["pattern"] is None else F.count_if(matches(a["pattern"], F.col("content")))
    return _single(lines, lines.df.agg(n.cast("string").alias("content")), F.array("content"))


def on_aggregate(lines: Lines, a: dict) -> Lines:
    """One line with the value; what isn't a number is left out, and lines without the field."""
    kind, n = a["function"]
    none = F.array().cast(EMPTY_FIELDS)
    if kind == "count":
        return _single(lines, lines.df.agg(F.count("*").cast("string").alias("content")), none)
    x = field(lines, n)
    if kind == "freq":
        counts = lines.df.filter(x.isNotNull()).groupBy(x.alias("k")).agg(F.count("*").alias("n"))
        made = counts.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n"))))).alias("content"))
        return _single(lines, made.select(F.coalesce("content", F.lit("{}")).alias("content")), none)
    v = number(x)
    value = {
        "sum": lambda: shown(F.coalesce(F.sum(v), F.lit(0.0))),
        "avg": lambda: shown(F.coalesce(F.avg(v), F.lit(0.0))),
        "min": lambda: shown(F.coalesce(F.min(F.when(~F.isnan(v), v)), F.lit(float("inf")))),
        "max": lambda: shown(F.coalesce(F.max(F.when(~F.isnan(v), v)), F.lit(float("-inf")))),
        "distinct": lambda: F.array_join(F.array_sort(F.collect_list("_x")), ", "),
    }[kind]()
    if kind == "distinct":
        return _single(lines, lines.df.select(x.alias("_x")).distinct().agg(value.alias("content")), none)
    return _single(lines, lines.df.agg(value.alias("content")), none)


def on_group(lines: Lines, a: dict) -> Lines:
    """A line for each key, in order of first appearance; what isn't a number counts as 0 in sums and averages."""
    key = F.coalesce(field(lines, a["field"], True), F.lit(""))
    made = []
    for kind, n in a["functions"]:
        x = F.lit(None) if n is None else F.coalesce(field(lines, n, True), F.lit(""))
        v = F.lit(None) if n is None else number(x)
        made.append({
            "count": lambda: F.count("*").cast("string"),
            "sum": lambda: shown(F.sum(F.coalesce(v, F.lit(0.0)))),
            "avg": lambda: shown(F.avg(F.coalesce(v, F.lit(0.0)))),
            "min": lambda: shown(F.min(F.coalesce(v, F.lit(HUGE)))),
            "max": lambda: shown(F.max(F.coalesce(v, F.lit(TINY)))),
            "distinct": lambda: F.count_distinct(x).cast("string"),
            "freq": lambda: None,
        }[kind]())
    first = lines.first_key()
    ascending = [] if first is None else [F.min(first).alias("_o0")]
    plain = [m.alias(f"_a{i}") for i, m in enumerate(made) if m is not None]
    df = lines.df.groupBy(key.alias("_key")).agg(*plain, *ascending, F.count("*").alias("_n"))
    for i, (kind, n) in enumerate(a["functions"]):
        if kind == "freq":
            df = df.join(_frequencies(lines.df, key, F.coalesce(field(lines, n, True), F.lit("")), f"_a{i}"), "_key")
    order = (("_o0", False),)
    if first is None:
        df, order = df.join(lines.first_of(key), "_key"), lines.order
    fields = F.array("_key", *[f"_a{i}" for i in range(len(made))])
    df = df.select(*[c for c, _ in order], F.lit("").alias("source_file"), F.lit(0).cast("long").alias("source_line"), F.array_join(fields, "\t").alias("content"), fields.alias("fields"))
    return replace(lines, df=df, order=order)


def _frequencies(df: DataFrame, key: Column, x: Column, name: str) -> DataFrame:
    """_key and value:count of each of its values, by value. Only different values of a key come together."""
    counts = df.groupBy(key.alias("_key"), x.alias("_x")).agg(F.count("*").alias("_c"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_x", "_c"))), lambda e: F.concat(e["_x"], F.lit(":"), e["_c"].cast("string")))
    return counts.groupBy("_key").agg(F.array_join(listed, ";").alias(name))


def on_separator(lines: Lines, a: dict) -> Lines:
    return replace(lines, separator=a["separator"])


def on_let(lines: Lines, a: dict) -> Lines:
    value = lines.variables.get(a["value"]) if a["kind"] == "word" else a["value"]
    return replace(lines, variables={**lines.variables, a["name"]: value})


STEPS = {name[3:]: f for name, f in list(globals().items()) if name.startswith("on_")}


def run_stages(lines: Lines, stages: list[Stage], depth: int = 0, defined: dict | None = None) -> Lines:
    """The stages over lines. An `if` looks at the first line while the query is planned; all else is lazy."""
    defined = {} if defined is None else defined
    if depth > MAX_DEPTH:
        raise QueryError("calls are nested too deep")
    for s in stages:
        a = s.args
        if s.name == "def":
            defined[a["name"]] = a["body"]
        elif s.name == "call":
            if a["name"] not in defined:
                raise QueryError(f"{a['name']} is not defined")
            lines = run_stages(lines, defined[a["name"]], depth + 1, defined)
        elif s.name == "if":
            first = on_take(lines, {"n": 1})
            holds = not first.keep(condition(lines, a["condition"])).df.isEmpty()
            lines = run_stages(lines, a["then" if holds else "else"], depth + 1, defined)
        else:
            lines = STEPS[s.name](lines, a)
    return lines


def query(lines: Lines, text: str, lenient: bool = False) -> Lines:
    return run_stages(lines, parse(text, lenient))


def observed(lines: Lines, text: str) -> list[dict]:
    """For each stage the lines that go in and come out; counts them, so it runs the query."""
    out, before = [], lines.df.count()
    for s in parse(text):
        lines = run_stages(lines, [s])
        after = lines.df.count()
        out.append({"stage": s.name, "in": before, "out": after})
        before = after
    return out


def union(parts: list[Lines]) -> Lines:
    return replace(parts[0], df=reduce(lambda x, y: x.unionByName(y), [p.df for p in parts]))


__all__ = ["DATA", "Lines", "between_mask", "condition", "query", "run_stages", "union", "observed"]
