"""Scalar text functions as column expressions; what no expression can do runs on Arrow batches."""

from __future__ import annotations

import quopri
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_rules import replace_all, replace_first

# fields of a record -------------------------------------------------------------------------------------------


def length(x: Column) -> Column:
    """In bytes; 0 for a missing value."""
    return F.coalesce(F.octet_length(x), F.lit(0))


def substr(x: Column, start: int, n: int) -> Column:
    """From character start (the first is 0)."""
    return F.substring(x, start + 1, n)


def sub(x: Column, pattern: str, to: str) -> Column:
    return replace_first(x, pattern, to)


def gsub(x: Column, pattern: str, to: str) -> Column:
    return replace_all(x, pattern, to)


def match(x: Column, pattern: str) -> Column:
    return F.regexp_extract(x, pattern, 0)


def part(x: Column, separator: str, n: int) -> Column:
    """The n-th part, from 1; empty if there is none."""
    return F.coalesce(F.get(F.split(x, separator, -1), F.lit(n - 1)), F.lit(""))


# case styles --------------------------------------------------------------------------------------------------

SEPARATED = {"snake": "_", "kebab": "-", "dot": ".", "path": "/", "flat": ""}


def case_words(x: Column) -> Column:
    """Words between signs, at humps (fooBar) and behind acronyms (HTTPServer)."""
    humps = F.regexp_replace(F.regexp_replace(x, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    return F.array_remove(F.split(humps, r"[\s_\-./\\]+", -1), "")


def cased(x: Column, style: str) -> Column:
    """camel, pascal, snake, screaming, kebab, title, sentence, dot, path or flat."""
    w = F.transform(case_words(x), F.lower)
    big = lambda v: F.concat(F.upper(F.left(v, F.lit(1))), F.substr(v, F.lit(2)))
    if style in SEPARATED:
        return F.array_join(w, SEPARATED[style])
    return {
        "screaming": lambda: F.upper(F.array_join(w, "_")),
        "camel": lambda: F.array_join(F.transform(w, lambda v, i: F.when(i == 0, v).otherwise(big(v))), ""),
        "pascal": lambda: F.array_join(F.transform(w, big), ""),
        "title": lambda: F.array_join(F.transform(w, big), " "),
        "sentence": lambda: big(F.array_join(w, " ")),
    }[style]()


def case_style(x: Column) -> Column:
    rules = [("screaming", r"^[A-Z0-9]+(?:_[A-Z0-9]+)+$"), ("snake", r"^[a-z0-9]+(?:_[a-z0-9]+)+$"), ("kebab", r"^[a-z0-9]+(?:-[a-z0-9]+)+$"), ("dot", r"^[a-z0-9]+(?:\.[a-z0-9]+)+$"), ("path", r"^[a-z0-9]+(?:/[a-z0-9]+)+$"), ("camel", r"^[a-z][a-z0-9]*(?:[A-Z][a-z0-9]*)+$"), ("pascal", r"^(?:[A-Z][a-z0-9]*){2,}$"), ("title", r"^[A-Z]\w*(?: [A-Z]\w*)+$"), ("sentence", r"^[A-Z]\w*(?: [a-z]\w*)+$"), ("flat", r"^[a-z0-9]+$")]
    made = F.lit("unknown")
    for name, p in reversed(rules):
        made = F.when(x.rlike(p), name).otherwise(made)
    return made


# codecs -------------------------------------------------------------------------------------------------------


def base64_encode(x: Column) -> Column:
    return F.regexp_replace(F.base64(x.cast("binary")), r"\r?\n", "")


def base64_decode(x: Column) -> Column:
    return F.unbase64(x).cast("string")


def hex_encode(x: Column, upper: bool = False) -> Column:
    return F.hex(x.cast("binary")) if upper else F.lower(F.hex(x.cast("binary")))


def hex_decode(x: Column) -> Column:
    return F.unhex(x).cast("string")


def url_encode(x: Column) -> Column:
    """Letters, digits, - _ . ~ stay; a space is %20."""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_decode(x: Column) -> Column:
    return F.try_url_decode(x)


#: Named entities.
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}


def html_escape(x: Column) -> Column:
    for plain, entity in ENTITIES.items():
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def html_unescape(x: Column) -> Column:
    for entity, plain in (("&nbsp;", " "), ("&apos;", "'"), *((e, p) for p, e in reversed(ENTITIES.items()))):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return x


def rot13(x: Column) -> Column:
    a = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(x, a + a.upper(), a[13:] + a[:13] + a[13:].upper() + a[:13].upper())


@F.pandas_udf(T.StringType())
def quoted_printable(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else quopri.encodestring(t.encode()).decode())


def detect_codec(x: Column) -> Column:
    return F.when(x.rlike("^(?:[0-9a-fA-F]{2})+$"), "hex").when(x.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (F.length(x) > 0), "base64").when(x.rlike("%[0-9a-fA-F]{2}"), "percent").otherwise("none")


def run_lengths(x: Column) -> Column:
    """Runs of equal characters as array of (char, n)."""
    return F.transform(F.array_remove(F.split(F.regexp_replace(x, r"(?s)(.)\1*", "$0\u0001"), "\u0001", -1), ""), lambda r: F.struct(F.left(r, F.lit(1)).alias("char"), F.length(r).alias("n")))


@F.pandas_udf(T.DoubleType())
def compression_ratio(x: pd.Series) -> pd.Series:
    """Compressed over plain bytes."""
    return x.map(lambda t: None if t is None else len(zlib.compress(t.encode())) / max(1, len(t.encode())))


# dates --------------------------------------------------------------------------------------------------------


def parse_date(x: Column) -> Column:
    """Of six forms: 2024-01-31T10:20:30 (or a space, or the date alone), 1/31/2024, 31.1.2024, 2024/01/31, 31 Jan 2024, epoch seconds."""
    at = lambda p, form: F.when(x.rlike(p), F.try_to_timestamp(x, F.lit(form)))
    return F.coalesce(
        F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"), F.try_to_timestamp(F.replace(F.left(x, F.lit(19)), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))),
        at(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), at(r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), at(r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), at(r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
        at(r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"), F.when(x.rlike(r"^\d{9,10}$"), F.timestamp_seconds(x.try_cast("long"))),
    )


def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def day_of_week(d: Column) -> Column:
    """Monday is 0."""
    return F.weekday(d)


def duration_text(seconds: Column) -> Column:
    """1d 2h 3m 4s, without what is 0."""
    parts = [(86400, 10**9, "d"), (3600, 24, "h"), (60, 60, "m"), (1, 60, "s")]
    shown = [F.when(F.floor(seconds / n) % m > 0, F.concat((F.floor(seconds / n) % m).cast("string"), F.lit(u))) for n, m, u in parts]
    return F.when(seconds == 0, "0s").otherwise(F.concat_ws(" ", *shown))


# validators ---------------------------------------------------------------------------------------------------

VALID = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}$",
    "url": r"^[a-z][a-z0-9+.-]*://[^\s/?#]+[^\s]*$",
    "semver": r"^(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$",
    "uuid": r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    "ipv4": r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$",
    "ipv6": r"^(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=.*::)(?!.*::.*::)(?:[0-9a-fA-F]{1,4}(?::(?!$)|(?=::)|$))*(?:::)?(?:[0-9a-fA-F]{1,4}(?::(?!$)|$))*)$",
}


def is_valid(x: Column, kind: str) -> Column:
    return F.coalesce(x.rlike(VALID[kind]), F.lit(False))


def rule(x: Column, kind: str, *v) -> Column:
    """matches, length_between (bytes), one_of, not_blank, starts, ends."""
    return F.coalesce({"matches": lambda: x.rlike(v[0]), "length_between": lambda: F.octet_length(x).between(v[0], v[1]), "one_of": lambda: x.isin(list(v)), "not_blank": lambda: F.trim(x) != "", "starts": lambda: x.startswith(v[0]), "ends": lambda: x.endswith(v[0])}[kind](), F.lit(False))


# addresses ----------------------------------------------------------------------------------------------------

#: Default ports, and public suffixes of two parts.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ssh": "22"}
TWO_PART = ["co.uk", "co.jp", "co.kr", "com.br", "com.au", "com.cn", "org.uk", "net.au", "ac.uk", "gov.uk", "co.nz", "com.mx"]


def url_part(x: Column, name: str) -> Column:
    """scheme, host, port, path, query or fragment; null if there is none."""
    group = {"scheme": 1, "host": 3, "port": 4, "path": 5, "query": 6, "fragment": 7}[name]
    found = F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^@/?#]*)@)?([^:/?#]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", group)
    return F.nullif(F.lower(found) if name in ("scheme", "host") else found, F.lit(""))


def normalized_url(x: Column) -> Column:
    """Scheme and host in lower case, no default port, sorted query; the fragment stays."""
    scheme, port, query = url_part(x, "scheme"), url_part(x, "port"), url_part(x, "query")
    usual = F.try_element_at(F.create_map(*[F.lit(v) for kv in PORTS.items() for v in kv]), scheme)
    shown = F.when(port.isNotNull() & ~port.eqNullSafe(usual), F.concat(F.lit(":"), port)).otherwise("")
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    optional = lambda sign, v: F.coalesce(F.concat(F.lit(sign), v), F.lit(""))
    return F.when(scheme.isNotNull(), F.concat(scheme, F.lit("://"), F.coalesce(url_part(x, "host"), F.lit("")), shown, F.coalesce(url_part(x, "path"), F.lit("/")), optional("?", ordered), optional("#", url_part(x, "fragment")))).otherwise(x)


def query_map(x: Column) -> Column:
    """The query's values by name; of repeated names the last."""
    pairs = F.filter(F.split(F.coalesce(url_part(x, "query"), F.lit("")), "&"), lambda p: p != "")
    name = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.when(p.contains("="), F.substr(p, F.length(name(p)) + 2)).otherwise("")
    keys = F.array_distinct(F.transform(pairs, name))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: value(F.element_at(F.filter(pairs, lambda p: name(p) == k), -1))))


def registered_domain(host: Column) -> Column:
    labels = F.split(F.lower(host), r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")
    return F.when(last(2).isin(TWO_PART), last(3)).otherwise(last(2))


# scripts ------------------------------------------------------------------------------------------------------

#: Letters that become something else than themselves without marks, and those beyond Latin-1 that have a plain form.
LETTERS = {"Ä": "Ae", "Æ": "Ae", "Ð": "D", "Ö": "Oe", "Ø": "O", "Ü": "Ue", "Þ": "Th", "ß": "ss", "ä": "ae", "æ": "ae", "ð": "d", "ö": "oe", "ø": "o", "ü": "ue", "þ": "th", "Ł": "L", "ł": "l", "ı": "i"}
BEYOND = "ŐőŰűŞşĞğİ"
SCRIPTS = {"Latin": r"\p{IsLatin}0-9", "Greek": r"\p{IsGreek}", "Cyrillic": r"\p{IsCyrillic}", "Hebrew": r"\p{IsHebrew}", "Arabic": r"\p{IsArabic}", "Han": r"\p{IsHan}", "Hiragana": r"\p{IsHiragana}", "Katakana": r"\p{IsKatakana}", "Hangul": r"\p{IsHangul}", "Thai": r"\p{IsThai}", "Devanagari": r"\p{IsDevanagari}"}


def normalized(form: str):
    """A function to NFC, NFD, NFKC or NFKD."""
    @F.pandas_udf(T.StringType())
    def f(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return f


def transliterated(x: Column) -> Column:
    """Letters of Latin-1 and a few more without their marks, umlauts as two letters; all else stays."""
    marked = [c for c in [*map(chr, range(0xC0, 0x100)), *BEYOND] if c not in LETTERS and c.isalpha()]
    plain = F.translate(x, "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked))
    for c, to in LETTERS.items():
        plain = F.replace(plain, F.lit(c), F.lit(to))
    return plain


def case_fold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def script(x: Column) -> Column:
    """The script of most characters; the later of equals."""
    left = lambda t, p: F.length(F.regexp_replace(t, f"[{p}]+", ""))
    latin = F.length(x) - left(x, "A-Za-z0-9")
    # of ASCII, only Latin letters and digits count; for the rest each script is looked for in what ASCII leaves
    counts = lambda t: F.array(*[F.struct((F.length(t) - left(t, p) + (latin if s == "Latin" else 0)).alias("n"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, (s, p) in enumerate(SCRIPTS.items())])
    best = F.transform(F.array(F.regexp_replace(x, r"[\x00-\x7F]+", "")), lambda t: F.array_max(counts(t)))[0]
    return F.transform(F.array(best), lambda b: F.when(b["n"] > 0, b["s"]).otherwise("Unknown"))[0]


EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"


def emoji_count(x: Column) -> Column:
    return F.size(F.split(x, EMOJI, -1)) - 1


def emoji_stripped(x: Column) -> Column:
    return F.regexp_replace(x, EMOJI + r"|[\x{FE0F}\x{200D}]", "")


# colours ------------------------------------------------------------------------------------------------------


def luminance(hex_color: Column) -> Column:
    """Relative luminance of #rrggbb."""
    def channel(at: int) -> Column:
        v = F.conv(F.substring(hex_color, at, 2), 16, 10).cast("double") / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(2) + 0.7152 * channel(4) + 0.0722 * channel(6)


def contrast(a: Column, b: Column) -> Column:
    one, two = luminance(a), luminance(b)
    return (F.greatest(one, two) + 0.05) / (F.least(one, two) + 0.05)


# files and output ---------------------------------------------------------------------------------------------

#: First bytes (hex) of formats.
MAGIC = {"89504E47": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "25504446": "application/pdf", "504B0304": "application/zip", "1F8B": "application/gzip", "7B": "application/json", "3C3F786D6C": "application/xml"}


def mime(content: Column) -> Column:
    made = F.lit("application/octet-stream")
    for magic, kind in reversed(MAGIC.items()):
        made = F.when(F.hex(content).startswith(magic), kind).otherwise(made)
    return made


def charset(content: Column) -> Column:
    h = F.hex(content)
    return F.when(h.startswith("EFBBBF"), "utf-8-bom").when(h.startswith("FFFE"), "utf-16le").when(h.startswith("FEFF"), "utf-16be").when(~h.rlike("^(?:..)*[89A-F]."), "ascii").when(F.is_valid_utf8(content), "utf-8").otherwise("latin-1")


def masked_output(x: Column) -> Column:
    """Ids, times and durations replaced by marks, for comparing outputs."""
    x = F.regexp_replace(x, r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", "<UUID>")
    x = F.regexp_replace(x, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TIMESTAMP>")
    return F.regexp_replace(x, r"\b\d+(?:\.\d+)?(?:ns|us|µs|ms|s)\b", "<DURATION>")


def wrapped(x: Column, width: int) -> Column:
    """Lines of at most width characters, broken at spaces; longer words stay whole."""
    folded = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), rf"(\S{{{width},}}|.{{1,{width}}})(?: |$)", "$1\n")
    return F.array_remove(F.split(folded, "\n", -1), "")


def padded(x: Column, width: int, align: str = "left") -> Column:
    gap = F.greatest(F.lit(width) - F.length(x), F.lit(0))
    if align == "left":
        return F.concat(x, F.repeat(F.lit(" "), gap))
    if align == "right":
        return F.concat(F.repeat(F.lit(" "), gap), x)
    half = F.floor(gap / 2).cast("int")
    return F.concat(F.repeat(F.lit(" "), half), x, F.repeat(F.lit(" "), gap - half))
