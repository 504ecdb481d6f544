"""Text statistics, word and n-gram frequencies, Zipf's law and TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import ROWS, coded, pieces, slices
from .rounds import checkpointed

#: What isn't part of a word: words are runs of letters, digits, apostrophes and hyphens.
BREAK = r"[^\p{L}\p{N}'\-]+"
#: Terms whose rarity is sent to all executors; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
TOKEN_BREAK = r"[^\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """By splitting, which takes one pass; extraction copies the text for every match."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK, -1), "")


def spaced(text: Column, pattern: str) -> Column:
    """Text with a space for each run of what a pattern finds: words for batches.coded."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), pattern, " ")


def count_of(text: Column, pattern: str) -> Column:
    """Matches of a pattern of single characters or runs, by what is left when they are cut out."""
    return F.size(F.split(F.coalesce(text, F.lit("")), pattern, -1)) - 1


def sentences(text: Column) -> Column:
    """Runs of . ! ? end a sentence; a text that isn't blank has one at least."""
    return F.when(F.length(F.trim(text)) > 0, F.greatest(count_of(text, r"[.!?]+"), F.lit(1))).otherwise(0)


def paragraphs(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > 0, F.size(F.filter(F.split(text, r"\n\s*\n", -1), lambda p: F.trim(p) != ""))).otherwise(0)


def syllables(word: Column) -> Column:
    """Groups of vowels, without a silent e at the end; one for words of up to three bytes."""
    w = F.lower(word)
    groups = count_of(w, "[aeiouy]+")
    silent = w.endswith("e") & ~w.endswith("le") & (groups > 1)
    return F.when(F.octet_length(w) <= 3, 1).otherwise(F.greatest(groups - silent.cast("int"), F.lit(1)))


def stats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each text: counts, averages (in bytes) and readability."""
    cut = df.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("t")).select("*", F.explode(F.array(words(F.col("t")))).alias("w"))
    total = lambda f: F.aggregate("w", F.lit(0), lambda n, x: n + f(x))
    cut = cut.select(id_col, "t", F.size("w").alias("words"), F.size(F.array_distinct(F.transform("w", F.lower))).alias("unique_words"), total(F.octet_length).alias("word_bytes"), total(syllables).alias("syllables"), sentences(F.col("t")).alias("sentences"))
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    some = F.col("words") > 0
    ease = 206.835 - 1.015 * per("words", "sentences") - 84.6 * per("syllables", "words")
    grade = 0.39 * per("words", "sentences") + 11.8 * per("syllables", "words") - 15.59
    ari = 4.71 * per("word_bytes", "words") + 0.5 * per("words", "sentences") - 21.43
    return cut.select(
        id_col, F.length("t").alias("chars"), F.length(F.regexp_replace("t", r"\s", "")).alias("solid_chars"), "words", "unique_words", "sentences", paragraphs(F.col("t")).alias("paragraphs"),
        F.when(F.length("t") > 0, F.size(F.split("t", "\n", -1)) - F.col("t").endswith("\n").cast("int")).otherwise(0).alias("lines"), per("word_bytes", "words").alias("avg_word_bytes"), per("words", "sentences").alias("avg_sentence_words"),
        F.when(some, ease).otherwise(0.0).alias("reading_ease"), F.when(some, grade).otherwise(0.0).alias("grade"), F.when(some, ari).otherwise(0.0).alias("ari"),
    )


def char_classes(df: DataFrame, text_col: str) -> DataFrame:
    """class, n over all texts: alphabetic, numeric, whitespace, punctuation (ASCII), other."""
    t = F.coalesce(text_col, F.lit(""))
    classes = {"alphabetic": r"\p{L}", "numeric": r"\p{N}", "whitespace": r"[\s\x{0085}\p{Z}]", "punctuation": r"[!-/:-@\[-`{-~]"}
    left = lambda p: F.length(t) - F.length(F.regexp_replace(t, p, ""))
    sums = df.select(F.length(t).alias("all"), *[left(p).alias(c) for c, p in classes.items()]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("all", *classes)])
    rest = F.col("all") - sum((F.col(c) for c in classes), F.lit(0))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in classes], F.struct(F.lit("other").alias("class"), rest.alias("n")))).alias("x")).select("x.class", "x.n")


def entropy(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Shannon entropy of each text's characters, in bits."""
    chars = df.select(id_col, F.explode(F.split(F.coalesce(text_col, F.lit("")), "")).alias("c")).filter("c <> ''").groupBy(id_col, "c").agg(F.count("*").alias("n"))
    return chars.groupBy(id_col).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def word_frequency(df: DataFrame, text_col: str, top: int) -> DataFrame:
    """word, n, share: the most frequent lower-cased words, ties by word."""
    counts = df.select(F.explode(words(F.lower(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    return counts.orderBy(F.col("n").desc(), "word").limit(top).join(total).select("word", "n", (F.col("n") / F.col("total")).alias("share"))


def ngrams(df: DataFrame, text_col: str, n: int, top: int | None = None) -> DataFrame:
    """ngram, n: windows of lower-cased words inside a text."""
    cut = df.select(F.explode(F.array(words(F.lower(text_col)))).alias("w")).filter(F.size("w") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
    if n == 2:  # each word beside its successor, without a slice for each
        grams = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))
    counts = cut.select(F.explode_outer(grams).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "ngram").limit(top) if top else counts


def zipf(df: DataFrame, text_col: str, top: int) -> DataFrame:
    """rank, word, n, expected, actual: frequencies beside 1 / rank."""
    counts = word_frequency(df, text_col, top)
    by = Window.orderBy(F.col("n").desc(), "word")  # top rows
    return counts.select(F.row_number().over(by).alias("rank"), "word", "n", (1 / F.row_number().over(by)).alias("expected"), (F.col("n") / F.max("n").over(Window.partitionBy())).alias("actual"))


def zipf_fit(ranked: DataFrame) -> DataFrame:
    """r2 of the law with slope -1 in logarithms."""
    logs = ranked.select(F.log("actual").alias("y"), F.log("expected").alias("f"))
    mean = F.broadcast(logs.agg(F.avg("y").alias("m")))  # one row
    return logs.join(mean).agg((1 - F.sum((F.col("y") - F.col("f")) ** 2) / F.sum((F.col("y") - F.col("m")) ** 2)).alias("r2"))


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased runs of letters, digits and _ of two bytes or more."""
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK, -1), lambda w: F.octet_length(w) >= 2)
    return F.filter(found, lambda w: ~w.isin(stop_words)) if stop_words else found


def term_counts(df: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """id, term, c, most (of the id's most frequent term); and term, idf, n (the number of ids that have any term).

    Texts are brought together by id once, and counted in batches: first how many ids have a term, then each id's terms.
    The rarity of terms is written, and sent to all executors while it is small.
    """
    kind = df.select(F.col(id_col).alias("id")).schema
    whole = df.select(F.col(id_col).alias("id"), spaced(F.lower(text_col), TOKEN_BREAK).alias("t")).groupBy("id").agg(F.array_join(F.collect_list("t"), " ").alias("t"))

    def counted(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for some in slices(batch, "t"):
                rows, codes, terms = coded(some["t"])
                known = pc.greater_equal(pc.binary_length(terms), 2)
                if stop_words:
                    known = pc.and_(known, pc.invert(pc.is_in(terms, pa.array(stop_words, terms.type))))
                keep = known.to_numpy(zero_copy_only=False)[codes]
                keys, n = np.unique(rows[keep] * len(terms) + codes[keep], return_counts=True)
                yield some, keys // max(len(terms), 1), keys % max(len(terms), 1), n, terms

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, codes, _, terms in counted(batches):
            found, n = np.unique(codes, return_counts=True)
            yield from pieces({"term": pa.concat_arrays([terms.take(pa.array(found)), pa.array([None], terms.type)]), "df": np.append(n, len(np.unique(rows)))})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, rows, codes, n, terms in counted(batches):
            begins = np.flatnonzero(np.diff(rows, prepend=-1))
            most = np.repeat(np.maximum.reduceat(n, begins), np.diff(np.append(begins, len(rows)))) if len(rows) else n
            for at in range(0, len(rows), ROWS):
                end = at + ROWS
                yield from pieces({"id": some["id"].take(pa.array(rows[at:end])), "term": terms.take(pa.array(codes[at:end])), "c": n[at:end], "most": most[at:end]})

    met = checkpointed(whole.mapInArrow(spread, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")))
    n = F.broadcast(met.filter("term is null").select(F.col("df").alias("n")))  # one row
    rarity = met.filter("term is not null").join(n).select("term", (F.log(F.col("n") / F.col("df")) + 1).alias("idf"), "n")
    counts = whole.mapInArrow(each, T.StructType([*kind, T.StructField("term", T.StringType()), T.StructField("c", T.LongType()), T.StructField("most", T.LongType())]))
    return counts, F.broadcast(rarity) if met.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rarity


def tf_idf(df: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None) -> DataFrame:
    """id, term, tf (by the most frequent term), idf, weight. Texts without tokens don't count."""
    counts, rarity = term_counts(df, id_col, text_col, stop_words)
    tf = counts.filter("id is not null").select("id", "term", (F.col("c") / F.col("most")).alias("tf"))
    return tf.join(rarity.drop("n"), "term").select("id", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("weight"))


def tf_idf_search(df: DataFrame, id_col: str, text_col: str, query: str, top: int, stop_words: list[str] | None = None) -> DataFrame:
    """id, score: cosine of texts with a query, best first, ties by id.

    The count of a text's most frequent term cancels out of the cosine, so norm and product come from one pass over
    the counts. A query's term that no text has counts in the query's norm as if one text had it.
    """
    counts, rarity = term_counts(df, id_col, text_col, stop_words)
    asked = df.sparkSession.createDataFrame([(query,)], "q string").select(F.explode(tokens(F.col("q"), stop_words)).alias("term")).groupBy("term").agg(F.count("*").alias("qc"))
    n = F.broadcast(rarity.agg(F.max("n").alias("all")))  # one row
    vector = F.broadcast(asked.join(n).join(rarity.join(F.broadcast(asked.select("term")), "term", "left_semi"), "term", "left").select("term", (F.col("qc") * F.coalesce("idf", F.log("all") + 1)).alias("q")))  # the query's terms
    size = F.broadcast(vector.agg(F.sqrt(F.sum(F.col("q") ** 2)).alias("q_norm")))  # one row
    weight = F.col("c") * F.col("idf")
    scored = counts.filter("id is not null").join(rarity.drop("n"), "term").join(vector, "term", "left").groupBy("id").agg(F.sum(weight * F.col("q")).alias("dot"), F.sqrt(F.sum(weight**2)).alias("norm"))
    return scored.filter("dot > 0").join(size).select("id", (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("score")).orderBy(F.col("score").desc(), "id").limit(top)
