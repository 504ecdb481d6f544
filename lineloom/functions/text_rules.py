"""Where the value rules of line queries differ from Spark's: regular expressions, replacement texts and numbers."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the texts that count as numbers, on top of which a cast decides.
NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
#: What stands for the largest and smallest number.
HUGE, TINY = 1.7976931348623157e308, -1.7976931348623157e308


def java_regex(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """A linear-time regular expression with Unicode classes in Java's dialect."""
    if re.search(r"(?<!\\)\(\?(?:=|!|<=|<!)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError(f"look-around and back-references are not supported: {pattern}")
    out = pattern.replace("(?P<", "(?<").replace(r"\/", "/")
    return f"(?U{'i' if ignore_case else ''}{'m' if multiline else ''}){out}"


def escaped(literal: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def valid(pattern: str) -> bool:
    """Whether the engine accepts a pattern; checked where the query is planned."""
    from pyspark.sql import SparkSession

    try:
        java_regex(pattern)
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(java_regex(pattern))
    except Exception:  # noqa: BLE001  a malformed pattern, whatever the engine calls it
        return False
    return True


def template_parts(template: str) -> list[str | int]:
    """A replacement text as literal parts and group numbers or names: $1, ${1}, $name, $$."""
    parts: list[str | int] = []
    for m in re.finditer(r"\$\$|\$\{([^}]*)\}|\$([A-Za-z0-9_]+)|[^$]+|\$", template):
        name = m[1] if m[1] is not None else m[2]
        if m[0] == "$$":
            parts.append("$")
        elif name is None:
            parts.append(m[0])
        elif name.isdigit():
            parts.append(int(name))
        else:
            parts.append("\0" + name)
    return parts


def _groups(pattern: str) -> tuple[int, dict[str, int]]:
    compiled = re.sub(r"\(\?P?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern)
    names, n = {}, 0
    for m in re.finditer(r"\\.|\[(?:\\.|[^\]])*\]|\((\?P<(\w+)>|\?)?", compiled):
        if m[0].startswith("(") and m[1] != "?":
            n += 1
            if m[2]:
                names[m[2]] = n
    return n, names


def java_template(pattern: str, template: str) -> str:
    """A replacement text for all matches in Java's dialect; unknown groups are empty."""
    n, names = _groups(pattern)
    out = ""
    for p in template_parts(template):
        if isinstance(p, str) and p.startswith("\0"):
            p = names.get(p[1:], n + 1)
        if isinstance(p, int):
            # a digit that follows must not become part of the number
            out += f"${p}" if p <= n else ""
            out += "" if p > n else "\0"
        else:
            out += re.sub(r"([\\$])", r"\\\1", p)
    return re.sub("\0(?=[0-9])", r"\\", out).replace("\0", "")


def replace_all(text: Column, pattern: str, template: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, F.lit(java_regex(pattern, ignore_case)), F.lit(java_template(pattern, template)))


def replace_first(text: Column, pattern: str, template: str, ignore_case: bool = False) -> Column:
    """Only the first match: what precedes it is kept by a lazy group in front of the pattern."""
    regex = java_regex(pattern, ignore_case)
    whole = "(?s)^(.*?)(?:" + regex + ")(.*)$"
    n, names = _groups(pattern)
    made = [F.regexp_extract(text, whole, 1)]
    for p in template_parts(template):
        if isinstance(p, str) and p.startswith("\0"):
            p = names.get(p[1:], n + 1)
        if isinstance(p, int):
            made.append(F.regexp_extract(text, regex, 0) if p == 0 else F.regexp_extract(text, whole, p + 1) if p <= n else F.lit(""))
        else:
            made.append(F.lit(p))
    made.append(F.regexp_extract(text, whole, n + 2))
    return F.when(text.rlike(regex), F.concat(*made)).otherwise(text)


def number(text: Column) -> Column:
    """The number that a text is, or null."""
    cleaned = F.regexp_replace(F.lower(text), "^([+-]?)inf(?:inity)?$", "$1Infinity")
    return F.when(text.rlike(NUMBER), F.when(F.lower(text).rlike("^[+-]?nan$"), F.lit(float("nan"))).otherwise(F.expr("1.0D") * cleaned.try_cast("double"))).otherwise(F.lit(None).cast("double"))


def shown(value: Column) -> Column:
    """A number as text: no exponent, no trailing zeros."""
    whole = (value == F.floor(value)) & (F.abs(value) < 9e15)
    plain = F.regexp_replace(F.format_string("%.15f", value), r"0+$", "")
    short = value.cast("string")
    return (
        F.when(F.isnan(value), "NaN").when(value == math.inf, "inf").when(value == -math.inf, "-inf")
        .when(whole, value.cast("long").cast("string")).when(~short.contains("E"), short)
        .when(F.abs(value) >= 9e15, value.cast("decimal(38,0)").cast("string")).otherwise(plain)
    )


def split_fields(content: Column, separator: str) -> Column:
    """The fields of a line, with leading and trailing empty ones."""
    parts = F.split(content, F.lit(java_regex(separator)), -1)
    return F.concat(F.array(F.lit("")), parts) if re.compile(separator).match("") else parts
