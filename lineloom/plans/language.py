"""The query language: keywords, tokens, parser and explanations.

A query is a list of stages. A stage is a name with arguments; patterns are ("text" or "regex", value).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Every keyword with its other spellings.
KEYWORDS = {
    "find": "search", "replace": "", "with": "", "delete": "remove", "lines": "", "matching": "", "insert": "add", "before": "", "after": "",
    "select": "pick", "fields": "", "filter": "where", "sort": "order", "by": "", "field": "", "line": "", "asc": "ascending", "desc": "descending",
    "numeric": "", "unique": "uniq deduplicate dedup", "take": "head", "first": "", "skip": "", "last": "tail", "count": "", "aggregate": "agg",
    "sum": "", "avg": "average mean", "min": "minimum", "max": "maximum", "distinct": "", "freq": "frequency", "set": "",
    "separator": "sep delim delimiter", "in": "", "all": "global every", "ignore_case": "ignorecase nocase case_insensitive",
    "whole_word": "wholeword word", "invert": "not", "multiline": "", "context": "ctx", "only_match": "onlymatch only_matching", "between": "",
    "and": "", "or": "", "to": "", "contains": "has", "equals": "eq is", "matches": "", "not_empty": "notempty present", "let": "", "if": "",
    "then": "", "else": "", "end": "", "group": "groupby group_by", "def": "define fn func", "call": "invoke",
}
_SPELLINGS = {w: k for k, more in KEYWORDS.items() for w in (k, *more.split())}
_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<regex>/(?:\\.|[^/\\])*/)|(?P<float>\d+\.\d*)|(?P<int>\d+)"""
    r"""|(?P<op>!=|[|,><=])|(?P<word>[^\W\d]\w*)""",
    re.S | re.X,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "'": "'", "\\": "\\"}


class QueryError(ValueError):
    """A query that can't be understood."""


@dataclass
class Token:
    kind: str
    value: object
    at: int


@dataclass
class Stage:
    name: str
    args: dict = field(default_factory=dict)


def tokens(query: str) -> list[Token]:
    out, at = [], 0
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise QueryError(f"unexpected {query[at]!r} at {at}")
        kind, value = m.lastgroup, m[0]
        if kind == "text":
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), value[1:-1], flags=re.S)
        elif kind == "regex":
            value = value[1:-1]
        elif kind == "int":
            value = int(value)
        elif kind == "float":
            value = float(value)
        elif kind == "word" and value.lower() in _SPELLINGS:
            kind, value = "keyword", _SPELLINGS[value.lower()]
        if kind != "space":
            out.append(Token(kind, value, at))
        at = m.end()
    return [*out, Token("end", None, at)]


class Parser:
    """Recursive descent over the tokens; each stage has a method of its name."""

    def __init__(self, query: str) -> None:
        self.tokens, self.at = tokens(query), 0

    def fail(self, wanted: str):
        t = self.tokens[self.at]
        raise QueryError(f"expected {wanted}, got {t.value!r} at {t.at}")

    def see(self, *keywords: str) -> bool:
        t = self.tokens[self.at]
        return t.kind == "keyword" and t.value in keywords

    def skip(self, *keywords: str) -> str | None:
        if self.see(*keywords):
            return self.need("keyword", "")
        return None

    def need(self, kind: str, wanted: str, value: object = None):
        t = self.tokens[self.at]
        if t.kind not in kind.split() or value is not None and t.value != value:
            self.fail(wanted)
        self.at += 1
        return t.value

    def keyword(self, word: str) -> None:
        self.need("keyword", word, word)

    def op(self, sign: str) -> bool:
        t = self.tokens[self.at]
        if t.kind == "op" and t.value == sign:
            self.at += 1
            return True
        return False

    def pattern(self) -> tuple[str, str]:
        kind = self.tokens[self.at].kind
        return kind, self.need("text regex", "a pattern")

    def name(self) -> str:
        return self.need("word text", "a name")

    def pipeline(self, closers: tuple[str, ...] = ()) -> list[Stage]:
        out = []
        while not (self.tokens[self.at].kind == "end" or closers and self.see(*closers)):
            out.append(self.stage())
            if not self.op("|"):
                break
        return out

    def stage(self) -> Stage:
        if self.tokens[self.at].kind != "keyword" or not (f := getattr(self, f"on_{self.tokens[self.at].value}", None)):
            self.fail("a stage")
        self.at += 1
        return f()

    def on_find(self) -> Stage:
        return Stage("find", {"pattern": self.pattern(), **self.modifiers()})

    def on_replace(self) -> Stage:
        pattern = self.pattern()
        self.keyword("with")
        return Stage("replace", {"pattern": pattern, "to": self.need("text", "a text"), **self.modifiers()})

    def on_delete(self) -> Stage:
        self.skip("lines")
        self.skip("matching")
        return Stage("delete", {"pattern": self.pattern()})

    def on_insert(self) -> Stage:
        text = self.need("text", "a text")
        where = self.skip("before", "after") or self.fail("before or after")
        return Stage("insert", {"text": text, "where": where, "pattern": self.pattern()})

    def on_select(self) -> Stage:
        self.skip("fields")
        return Stage("select", {"fields": self.listed(lambda: self.need("int", "a field number"))})

    def listed(self, item) -> list:
        out = [item()]
        while self.op(","):
            out.append(item())
        return out

    def on_filter(self) -> Stage:
        return Stage("filter", {"condition": self.condition()})

    def on_sort(self) -> Stage:
        by = None
        if self.skip("by"):
            if self.skip("field"):
                by = self.need("int", "a field number")
            else:
                self.skip("line")
        way = self.skip("asc", "desc")
        return Stage("sort", {"field": by, "desc": way == "desc", "numeric": bool(self.skip("numeric"))})

    def on_unique(self) -> Stage:
        by = None
        if self.skip("by"):
            self.keyword("field")
            by = self.need("int", "a field number")
        return Stage("unique", {"field": by})

    def on_take(self) -> Stage:
        return Stage("take", {"n": self.need("int", "a number")})

    on_first = on_take

    def on_skip(self) -> Stage:
        return Stage("skip", {"n": self.need("int", "a number")})

    def on_last(self) -> Stage:
        return Stage("last", {"n": self.need("int", "a number")})

    def on_count(self) -> Stage:
        return Stage("count", {"pattern": self.pattern() if self.tokens[self.at].kind in ("text", "regex") else None})

    def on_aggregate(self) -> Stage:
        return Stage("aggregate", {"function": self.function()})

    def function(self) -> tuple[str, int | None]:
        kind = self.skip("count", "sum", "avg", "min", "max", "distinct", "freq") or self.fail("an aggregate function")
        if kind == "count":
            return kind, None
        self.skip("field")
        return kind, self.need("int", "a field number")

    def on_set(self) -> Stage:
        self.keyword("separator")
        return Stage("separator", {"separator": self.need("text", "a text")})

    def on_let(self) -> Stage:
        name = self.name()
        self.op("=") or self.fail("=")
        kind = self.tokens[self.at].kind
        return Stage("let", {"name": name, "kind": kind, "value": self.need("text int float word", "a value")})

    def on_if(self) -> Stage:
        condition = self.condition()
        self.keyword("then")
        then = self.pipeline(("else", "end"))
        other = self.pipeline(("end",)) if self.skip("else") else []
        self.keyword("end")
        return Stage("if", {"condition": condition, "then": then, "else": other})

    def on_group(self) -> Stage:
        self.skip("by")
        self.keyword("field")
        n = self.need("int", "a field number")
        self.keyword("aggregate")
        return Stage("group", {"field": n, "functions": self.listed(self.function)})

    def on_def(self) -> Stage:
        name = self.name()
        self.op("=") or self.fail("=")
        body = self.pipeline(("end",))
        self.keyword("end")
        return Stage("def", {"name": name, "body": body})

    def on_call(self) -> Stage:
        return Stage("call", {"name": self.name()})

    def modifiers(self) -> dict:
        out: dict = {}
        while word := self.skip("ignore_case", "whole_word", "invert", "all", "multiline", "only_match", "context", "max", "in", "between"):
            if word in ("context", "max"):
                out[word] = self.need("int", "a number")
            elif word == "between":
                start = self.pattern()
                self.keyword("and")
                out["between"] = start, self.pattern()
            elif word == "in":
                if self.skip("lines"):
                    low = self.need("int", "a line number")
                    self.keyword("to")
                    out["lines"] = low, self.need("int", "a line number")
                elif not self.skip("all"):
                    out["glob"] = self.need("text", "a glob, lines or all")
            else:
                out[word] = True
        return out

    def condition(self) -> tuple:
        """and, or: of equal rank, grouped to the right."""
        left = self.simple()
        if word := self.skip("and", "or"):
            return word, left, self.condition()
        return left

    def simple(self) -> tuple:
        if self.skip("line"):
            n = None
        else:
            self.keyword("field")
            n = self.need("int", "a field number")
        if word := self.skip("contains", "matches", *(() if n is None else ("equals", "not_empty"))):
            if word == "not_empty":
                return word, n, None
            return word, n, self.need("text regex" if word == "matches" else "text", "a text")
        if n is not None:
            for sign in (">", "<"):
                if self.op(sign):
                    return sign, n, float(self.need("int float", "a number"))
            if self.op("!="):
                return "!=", n, self.need("text", "a text")
        return self.fail("a comparison")


def parse(query: str, lenient: bool = False) -> list[Stage]:
    """The stages of a query; lenient: whatever follows a complete stage without a | is ignored."""
    parser = Parser(query)
    stages = parser.pipeline()
    if parser.tokens[parser.at].kind != "end" and not lenient:
        parser.fail("| or the end")
    return stages


def _said(pattern: tuple[str, str]) -> str:
    return f'"{pattern[1]}"' if pattern[0] == "text" else f"/{pattern[1]}/"


def _condition(c: tuple) -> str:
    if c[0] in ("and", "or"):
        return f"({_condition(c[1])} {c[0]} {_condition(c[2])})"
    subject = "line" if c[1] is None else f"field {c[1]}"
    return f"{subject} {c[0].replace('_', ' ')}" + (f" {c[2]!r}" if c[2] is not None else "")


def explain(stages: list[Stage], level: int = 0) -> list[str]:
    """One sentence for each stage."""
    out = []
    for i, s in enumerate(stages, 1):
        a, lead = s.args, "  " * level + f"{i}. "
        extra = "".join(f", {k.replace('_', ' ')}" + ("" if v is True else f" {v}") for k, v in a.items() if k in ("ignore_case", "whole_word", "invert", "all", "multiline", "only_match", "context", "max", "lines", "glob", "between"))
        said = {
            "find": lambda: f"Keep lines matching {_said(a['pattern'])}{extra}",
            "replace": lambda: f"Replace {_said(a['pattern'])} with \"{a['to']}\"{extra}",
            "delete": lambda: f"Delete lines matching {_said(a['pattern'])}",
            "insert": lambda: f"Insert \"{a['text']}\" {a['where']} lines matching {_said(a['pattern'])}",
            "select": lambda: f"Select fields {', '.join(map(str, a['fields']))}",
            "filter": lambda: f"Keep lines where {_condition(a['condition'])}",
            "sort": lambda: f"Sort by {'line' if a['field'] is None else 'field %d' % a['field']}{' numerically' * a['numeric']}{' descending' * a['desc']}",
            "unique": lambda: "Keep the first line of each " + ("content" if a["field"] is None else f"field {a['field']}"),
            "take": lambda: f"Take the first {a['n']} lines",
            "skip": lambda: f"Skip {a['n']} lines",
            "last": lambda: f"Take the last {a['n']} lines",
            "count": lambda: "Count lines" + (f" matching {_said(a['pattern'])}" if a["pattern"] else ""),
            "aggregate": lambda: f"Aggregate {a['function'][0]}" + (f" of field {a['function'][1]}" if a["function"][1] is not None else ""),
            "group": lambda: f"Group by field {a['field']}: " + ", ".join(f + (f" of field {n}" if n is not None else "") for f, n in a["functions"]),
            "separator": lambda: f"Split fields at \"{a['separator']}\"",
            "let": lambda: f"Let {a['name']} be {a['value']!r}",
            "if": lambda: f"If the first line's {_condition(a['condition'])}",
            "def": lambda: f"Define {a['name']}",
            "call": lambda: f"Call {a['name']}",
        }[s.name]()
        out.append(lead + said)
        for name, word in (("then", "then"), ("else", "otherwise"), ("body", "as")):
            if a.get(name):
                out += ["  " * level + f"   {word}:", *explain(a[name], level + 2)]
    return out
