"""Surrogates for personal data: keyed, type-consistent, distinct and coherent. DataFrame functions only.

A mention is found by one pattern and has a type. Its canonical form (digits of a phone number, lower-case
words of a name, ...) is split into parts: a name into its given name and surname, an address into local part
and domain. Each part gets a surrogate that is a function of the key, the type, the canonical part and an
attempt number, so that the same part gets the same surrogate in every document (coreference), in the
mention's own form: separators, case, country codes, check digits (Luhn, mod 97), script and gender stay.

Collision checks: two parts of a type must not share a surrogate, and no surrogate may be a part that occurs
in the corpus. Parts that fail go to the next attempt, in rounds over the distinct parts, until none fails;
the surviving part is the one with the smallest keyed hash. Names grow by a syllable with each attempt, other parts from
attempt FORMAT_ATTEMPTS on by a digit, so that no corpus is too large. A surname that comes again without its given name
is replaced as in the full name. Only parts beyond attempt 0 are then joined to the
documents that mention them, so that frequent parts cause no skew and texts without them aren't shuffled.

Defined results: a null text stays null and an empty one empty, both with 0 mentions; text outside mentions
stays byte for byte; rows that are equal or repeat an id each get their result; null ids and other columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import barrier, let, materialize, row_key

#: Attempts within the mention's own format; surrogates of later attempts are longer than it, so that a free one is always found.
FORMAT_ATTEMPTS = 20

#: Given names by script and gender that open a name, and titles by gender.
GIVEN = {
    ("latin", "f"): "Mary Maria Anna Emma Laura Julia Sarah Linda Susan Lisa Sophie Marie Claire Camille Carmen Lucia Elena Sofia Isabel Helga Ingrid Petra Sabine Monika Jennifer Patricia Elizabeth Barbara Jessica Karen Nancy Margaret Alice".split(),
    ("latin", "m"): "John James Robert Michael William David Richard Thomas Charles Daniel Peter Paul Jean Pierre Louis Jacques Juan Carlos Jose Miguel Pedro Luis Hans Klaus Wolfgang Stefan Karl Friedrich George Edward Henry Andrew Mark Steven".split(),
    ("latin", "n"): "Priya Aisha Fatima Mei Yuki Ahmed Mohammed Muhammad Ali Omar Hassan Raj Arjun Wei Chen Hiroshi Kenji Kofi Kwame Olu Ana João Luca Marco Giulia Francesca Mateo Diego Javier Ines Chloé Léa Hugo".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Алексей Михаил Николай Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Γιάννης".split(),
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Mme", "Frau", "Señora", "Sra"], "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "n": ["Dr", "Prof"]}
#: Syllables of which surrogate names are made, and their endings by gender.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se ta".split(), "cyrillic": "ба бе бо да де до ва ве га го ка ке ла ле ли ло ма ме ми мо на не но па пе ра ре ри ро са се та".split(), "greek": "βα βε βο δα δε δο φα φε γα γο κα κε λα λε λι λο μα με μι μο να νε νο πα πε ρα ρε ρι ρο σα σε τα".split()}
ENDINGS = {("latin", "f"): "lia", ("latin", "m"): "ton", ("latin", "n"): "rel", ("cyrillic", "f"): "лия", ("cyrillic", "m"): "тон", ("cyrillic", "n"): "рел", ("greek", "f"): "λια", ("greek", "m"): "τος", ("greek", "n"): "ρελ"}

_given = [n for names in GIVEN.values() for n in names]
_names = "|".join(_given + [n.upper() for n in _given])
#: Titles as they are written, and in capitals.
_TITLED = [t for titles in TITLES.values() for t in titles]
_TITLED += [t.upper() for t in _TITLED]
_titles = "|".join(_TITLED)
_cap = r"\p{Lu}[\p{L}'’-]*\p{L}"
#: Types in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,4}(?![0-9A-Fa-f:])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{8,15}(?![0-9])",
    "secret": r"(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
    "name": rf"(?=\p{{Lu}})(?:(?:{_titles})\.? {_cap}(?: {_cap})?|(?:{_names})(?:-\p{{Lu}}\p{{L}}+)? {_cap})",
}
PII = r"(?<![\p{L}\p{N}_@])(?:" + "|".join(PATTERNS.values()) + ")"
TYPES = list(PATTERNS)
#: Noncharacters that mark where mentions begin and end.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"


def pieces(text: Column) -> Column:
    """The text cut into other text, mention, other text, ...: always an odd number of pieces.

    One pass brackets the mentions and a cheap split cuts at the brackets; a text that holds the brackets itself is cut the slow way.
    """
    fast = F.split(F.regexp_replace(text, PII, f"{_OPEN}$0{_SHUT}"), f"[{_OPEN}{_SHUT}]", -1)
    between, found = F.split(text, PII, -1), F.regexp_extract_all(text, F.lit(PII), F.lit(0))
    slow = F.flatten(F.transform(between, lambda x, i: F.when(i < F.size(found), F.array(x, F.get(found, i))).otherwise(F.array(x))))
    return F.when(text.rlike(f"[{_OPEN}{_SHUT}]"), slow).otherwise(fast)


def _of(kind: str):
    return lambda x: x["k"] == kind


def type_of(mention: Column) -> Column:
    return reduce(lambda rest, t: F.when(mention.rlike(f"^(?:{PATTERNS[t]})$"), F.lit(t)).otherwise(rest), reversed(TYPES), F.lit("name"))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _gender(word: Column) -> Column:
    first = F.lower(F.substring_index(word, "-", 1))
    return F.when(first.isin([n.lower() for (_, g), names in GIVEN.items() if g == "f" for n in names] + [t.lower() for t in TITLES["f"]]), F.lit("f")).when(first.isin([n.lower() for (_, g), names in GIVEN.items() if g == "m" for n in names] + [t.lower() for t in TITLES["m"]]), F.lit("m")).otherwise(F.lit("n"))


def _part(kind: Column | str, canon: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), canon.alias("canon"))


def parts(mention: Column, kind: Column) -> Column:
    """The parts of a mention that get surrogates: array of kind and canonical form. Titles are no parts."""
    words = F.filter(F.split(mention, r"\.? "), lambda w: ~w.isin(_TITLED))
    titled = mention.rlike(rf"^(?:{_titles})\.? ")

    def name(w: Column, i: Column) -> Column:
        given = (i == 0) & (F.size(words) > 1)
        shown = F.when(titled & (_gender(w) == "n"), _gender(F.split(mention, r"\.? ")[0])).otherwise(_gender(w))
        return _part(F.concat(F.when(given, F.concat(F.lit("given_"), shown)).otherwise(F.lit("surname_n")), F.lit("_"), _script(w)), F.lower(w))

    return (
        F.when(kind == "email", F.array(_part("local", F.lower(F.substring_index(mention, "@", 1))), _part("domain", F.lower(F.substring_index(mention, "@", -1)))))
        .when(kind == "name", F.transform(words, name))
        .when(kind == "phone", F.array(_part("phone", F.right(digits(mention), F.lit(10)))))
        .when(kind == "card", F.array(_part("card", digits(mention))))
        .when(kind == "iban", F.array(_part("iban", F.regexp_replace(mention, " ", ""))))
        .otherwise(F.array(_part(kind, mention)))
    )


def _luhn_sum(number: Column) -> Column:
    """The sum that a valid number's digits give modulo 10."""
    n = F.length(number)

    def one(acc, i):
        d = F.substr(number, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), one) % 10


def _mod97(text: Column) -> Column:
    """text, with letters as 10 to 35, modulo 97."""
    def one(r, c):
        v = F.ascii(c)
        return F.when(v >= 65, (r * 100 + v - 55) % 97).otherwise((r * 10 + v - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(one(r, c)))


def _chars(canon: Column, hexed: Column) -> Column:
    """canon with each digit and ASCII letter replaced by one of its class, by successive hash digits."""
    def one(c, i):
        h = F.conv(F.substr(hexed, (i % 60) + 1, F.lit(4)), 16, 10).cast("int")
        return F.when(c.rlike("[0-9]"), (h % 10).cast("string")).when(c.rlike("[a-z]"), F.char(h % 26 + 97)).when(c.rlike("[A-Z]"), F.char(h % 26 + 65)).otherwise(c)

    return F.array_join(F.transform(F.split(canon, ""), one), "")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical part."""
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 256)

    def made(hexed: Column) -> Column:
        n = lambda at, m: F.conv(F.substr(hexed, F.lit(at), F.lit(6)), 16, 10).cast("int") % m
        decimal = F.translate(hexed, "abcdef", "012345")
        syllables = {s: F.concat(*[F.array(*map(F.lit, v))[n(1 + 6 * i, len(v))] for i in range(4)]) for s, v in SYLLABLES.items()}
        def syllable(values: list[str], i: Column) -> Column:
            return F.get(F.array(*map(F.lit, values)), F.conv(F.substr(F.sha2(F.concat_ws("\x1f", hexed, i.cast("string")), 256), F.lit(1), F.lit(6)), 16, 10).cast("int") % len(values))

        more = {s: F.array_join(F.transform(F.sequence(F.lit(1), attempt), partial(syllable, v)), "") for s, v in SYLLABLES.items()}
        longer = lambda s: F.when(attempt > 0, F.concat(syllables[s], more[s])).otherwise(syllables[s])
        name = reduce(lambda rest, k: F.when(kind.rlike(f"_{k[1]}_{k[0]}$"), F.concat(longer(k[0]), F.lit(ENDINGS[k]))).otherwise(rest), ENDINGS, F.lit(""))
        body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(decimal, F.lit(1), F.length(canon) - 2))
        card = let(body, lambda b: F.when(_luhn_sum(canon) == 0, F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0")))) % 10).cast("string"))).otherwise(F.concat(b, F.substr(decimal, F.lit(40), F.lit(1)))))
        country, account = F.substr(canon, F.lit(1), F.lit(2)), _chars(F.substr(canon, F.lit(5)), hexed)
        iban = let(account, lambda a: F.concat(country, F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        hexes = F.when(canon.startswith("AKIA"), F.concat(F.lit("AKIA"), _chars(F.substr(canon, F.lit(5)), hexed))).otherwise(F.substr(F.concat(hexed, F.sha2(hexed, 256)), F.lit(1), F.length(canon)))
        return (
            F.when(kind == "local", F.concat(syllables["latin"], F.lit("."), F.substr(hexed, F.lit(30), F.lit(4))))
            .when(kind == "domain", F.concat(F.substr(F.sha2(hexed, 256), F.lit(1), F.lit(8)), F.lit(".example.com")))
            .when((kind == "ip") & canon.contains(":"), F.concat_ws(":", *[F.substr(hexed, F.lit(1 + 4 * i), F.lit(4)) for i in range(8)]))
            .when(kind == "ip", F.concat_ws(".", *[(n(1 + 6 * i, 254) + 1).cast("string") for i in range(4)]))
            .when(kind == "phone", F.substr(decimal, F.lit(1), F.length(canon)))
            .when(kind == "card", card)
            .when(kind == "iban", iban)
            .when(kind == "ssn", _chars(canon, hexed))
            .when(kind == "secret", hexes)
            .otherwise(name)
        )

    beyond = F.greatest(attempt - FORMAT_ATTEMPTS, F.lit(0))
    return let(h, lambda x: F.concat(made(x), F.substr(F.translate(F.sha2(x, 256), "abcdef", "012345"), F.lit(1), beyond)))


def _cased(word: Column, like: Column) -> Column:
    return F.when(like == F.upper(like), F.upper(word)).when(like == F.lower(like), word).otherwise(F.initcap(word))


def _poured(mention: Column, values: Column) -> Column:
    """The mention with its last digits or letters and digits replaced, in order, by the characters of values."""
    skip = F.length(F.regexp_replace(mention, "[^A-Za-z0-9]", "")) - F.length(values)

    def one(c, i):
        at = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i + 1), "[^A-Za-z0-9]", "")) - skip
        return F.when(c.rlike("[A-Za-z0-9]") & (at > 0), F.substr(values, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(mention, ""), one), "")


def rendered(mention: Column, kind: Column, found: Column, chosen: Column) -> Column:
    """The mention with its parts (found) replaced by their surrogates (chosen), in the mention's form."""
    words = F.split(mention, " ")
    title = lambda w: F.regexp_replace(w, r"\.$", "").isin(_TITLED)
    number = lambda i: F.size(F.filter(F.slice(words, F.lit(1), i + 1), lambda w: ~title(w))) - 1
    named = F.array_join(F.transform(words, lambda w, i: F.when(title(w), w).otherwise(_cased(F.get(chosen, number(i)), w))), " ")
    return (
        F.when(kind == "email", F.when(mention == F.upper(mention), F.upper(F.concat(chosen[0], F.lit("@"), chosen[1]))).otherwise(F.concat(chosen[0], F.lit("@"), chosen[1])))
        .when(kind == "name", named)
        .when(kind.isin("phone", "card", "iban"), _poured(mention, chosen[0]))
        .otherwise(chosen[0])
    )


def attempts(found: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt of the parts that can't keep attempt 0. found: kind, canon of all mentions."""
    every = materialize(found.distinct(), "pii-parts")
    zero = F.lit(0)
    taken = every.select("kind", "canon", zero.alias("attempt"))
    order = lambda: F.struct(F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "canon"), 256), "canon")
    settled = None  # parts with their surrogate, by round
    late: list[DataFrame] = []
    r = 0
    while True:
        tried = taken.select("kind", "canon", "attempt", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key).alias("s"), order().alias("o"))
        real = every.select(F.col("kind").alias("rk"), F.col("canon").alias("rs"))
        first = tried.groupBy("kind", "s").agg(F.min("o").alias("first"))
        ok = tried.join(first, ["kind", "s"]).join(real, (F.col("kind") == F.col("rk")) & (F.col("s") == F.col("rs")), "left")
        free = F.col("rk").isNull() & (F.col("o") == F.col("first"))
        if settled is not None:
            ok = ok.join(settled.select(F.col("kind").alias("tk"), F.col("s").alias("ts")), (F.col("kind") == F.col("tk")) & (F.col("s") == F.col("ts")), "left")
            free = free & F.col("tk").isNull()
        done = materialize(ok.select("kind", "canon", "attempt", "s", free.alias("free")), "pii-round")
        settled = done.filter("free") if settled is None else settled.unionByName(done.filter("free"))
        if r:
            late.append(done.filter("free").select("kind", "canon", "attempt"))
        taken = done.filter("not free").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        r += 1
        if taken.isEmpty():
            break
    return reduce(DataFrame.unionByName, late) if late else every.limit(0).select("kind", "canon", zero.alias("attempt"))


def pseudonymize(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with surrogates in place of personal data; count_col: also returns the number of mentions of each type, as a map."""
    cut = barrier(docs.filter(F.col(text_col).rlike("[0-9@]|[a-f]{32}|AKIA|" + PATTERNS["name"])), "__pieces", pieces(F.col(text_col)))
    mentions = F.transform(F.filter("__pieces", lambda _, i: i % 2 == 1), lambda m: let(type_of(m), lambda k: F.struct(m.alias("m"), k.alias("k"), parts(m, k).alias("parts"))))
    told = barrier(cut.filter(F.size("__pieces") > 1).select(F.col(id_col).alias("__doc"), row_key(F.col(text_col)).alias("__key"), "__pieces"), "__mentions", mentions)
    flat = told.select("__doc", "__key", F.explode(F.array_distinct(F.flatten(F.transform("__mentions", lambda x: x["parts"])))).alias("p")).select("__doc", "__key", "p.kind", "p.canon")
    late = materialize(attempts(flat.select("kind", "canon"), key), "pii-late")
    own = F.col("__doc"), F.col("__key")
    again = materialize(flat.join(late, ["kind", "canon"]).groupBy(*own).agg(F.map_from_entries(F.collect_set(F.struct(F.struct("kind", "canon"), "attempt"))).alias("__late")), "pii-documents")
    again = again.select(F.col("__doc").alias("__d"), F.col("__key").alias("__k"), "__late")

    whole = barrier(docs, "__pieces", pieces(F.col(text_col)))
    whole = barrier(whole, "__mentions", mentions)
    if not again.isEmpty():
        whole = whole.join(again, F.col(id_col).eqNullSafe(F.col("__d")) & (row_key(F.col(text_col)) == F.col("__k")), "left")
    else:
        whole = whole.withColumn("__late", F.lit(None).cast("map<struct<kind:string,canon:string>,int>"))

    def replaced(x: Column) -> Column:
        chosen = F.transform(x["parts"], lambda p: surrogate(p["kind"], p["canon"], F.coalesce(F.try_element_at("__late", p), F.lit(0)), key))
        return let(chosen, lambda c: rendered(x["m"], x["k"], x["parts"], c))

    done = barrier(whole, "__new", F.transform("__mentions", replaced))
    # surnames of full names, and what stands for them, where they come again by themselves
    last = lambda x: F.regexp_substr(x, F.lit(r"[^ ]+$"))
    full = F.filter(F.zip_with("__mentions", "__new", lambda m, new: F.struct(m["k"].alias("k"), last(m["m"]).alias("was"), last(new).alias("now"))), lambda x: (x["k"] == "name") & (F.length(x["was"]) > 2))
    done = barrier(done, "__again", F.array_distinct(F.flatten(F.transform(full, lambda x: F.array(F.struct(x["was"].alias("was"), x["now"].alias("now")), F.struct(F.upper(x["was"]).alias("was"), F.upper(x["now"]).alias("now")))))))
    again = lambda x: F.aggregate("__again", x, lambda t, s: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}_@.-])\Q"), s["was"], F.lit(r"\E(?![\p{L}\p{N}_@-])")), s["now"]))
    text = F.array_join(F.transform("__pieces", lambda x, i: F.when(i % 2 == 1, F.get("__new", (i / 2).cast("int"))).when(F.size("__again") > 0, again(x)).otherwise(x)), "")
    text = F.when(F.size("__mentions") > 0, text).otherwise(F.col(text_col))
    counts = [F.map_from_arrays(F.array(*map(F.lit, TYPES)), F.array(*[F.coalesce(F.size(F.filter("__mentions", _of(t))), F.lit(0)) for t in TYPES])).alias(count_col)] if count_col else []
    return done.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns], *counts)
