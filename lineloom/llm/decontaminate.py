"""Benchmark decontamination by a broadcast hash set of word windows. DataFrame functions only.

The windows of all benchmark items form a small hash set (its size is measured; beyond the limit the same
join is shuffled). Every document is scanned once: each of its word windows is hashed and looked up, and a
hit is verified by comparing the words themselves.

Defined results: a null or empty text has no words and no hits; an item without words has no window; equal
rows, and rows that repeat an id with another text, each get their own result; ids may be null; the words of an
item without id are hit, but it counts as no item; columns of the inputs other than the named ones, whatever their
names, pass through `remove` unchanged and play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, barrier, fits_broadcast, free_name, row_key

#: The word pattern of the contract, after and before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """The words, by splitting on all else: the extracting function copies the text for every match."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD, -1), "")


def item_windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """gram, n (its words), item_ids: one row for each different window."""
    words = barrier(items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("t")), "w", words_of(F.col("t"))).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - width, F.lit(0))
    grams = words.select("item_id", F.least(F.size("w"), F.lit(width)).alias("n"), F.explode_outer(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i + 1, width), " "))).alias("gram"))
    return grams.groupBy("gram", "n").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))


def find_hits(docs: DataFrame, items: DataFrame, *, width: int = 8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc, key, spans (array of first word and length), item_ids: one row for each document with a hit."""
    grams = item_windows(items, width, item_id_col, item_text_col)
    lengths = sorted(r[0] for r in grams.select("n").distinct().collect())  # at most `width` values
    texts = docs.select(F.col(id_col).alias("doc"), row_key(F.col(text_col)).alias("key"), F.col(text_col).alias("t"))
    words = barrier(texts, "w", words_of(F.col("t"))).select("doc", "key", "w")

    def windows(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice("w", i + 1, n), " ").alias("gram")))

    scanned = words.select("doc", "key", F.explode_outer(F.concat(*[windows(n) for n in lengths or [width]])).alias("x")).select("doc", "key", "x.pos", "x.len", "x.gram")
    table = grams.select(F.xxhash64("gram").alias("h"), F.col("gram").alias("item_gram"), "item_ids")
    if fits_broadcast(items, item_text_col, broadcast_bytes):
        table = F.broadcast(table)
    hits = scanned.join(table, (F.xxhash64("gram") == F.col("h")) & (F.col("gram") == F.col("item_gram")))
    return hits.groupBy("doc", "key").agg(F.collect_set(F.struct("pos", "len")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))


def _hit_words(spans: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1))))


def score(docs: DataFrame, items: DataFrame, *, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each document."""
    hits = find_hits(docs, items, id_col=id_col, text_col=text_col, **options)
    hits = hits.select("doc", "key", F.size(_hit_words(F.col("spans"))).cast("long").alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.array_join(F.sort_array("item_ids"), ",").alias("ids"))
    every = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(text_col)).alias("own_key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    joined = every.join(hits, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("own_key") == F.col("key")), "left")
    n_items = F.coalesce("n_items", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"))


def remove(docs: DataFrame, items: DataFrame, *, drop_from_items: int | None = 2, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without what the benchmark shares with them.

    Documents that hold windows of drop_from_items items or more go (None: none go). In the others every word
    inside a hit goes, with the separator that follows it; documents without a hit stay byte for byte.
    """
    doc, key, hit, n = (free_name(docs, x) for x in ("__doc", "__key", "__hit", "__n"))
    hits = find_hits(docs, items, id_col=id_col, text_col=text_col, **options).select(F.col("doc").alias(doc), F.col("key").alias(key), _hit_words(F.col("spans")).alias(hit), F.size("item_ids").alias(n))
    joined = docs.join(hits, F.col(id_col).eqNullSafe(F.col(doc)) & (row_key(F.col(text_col)) == F.col(key)), "left")
    if drop_from_items is not None:
        joined = joined.filter(F.coalesce(n, F.lit(0)) < drop_from_items)
    words, gaps = F.array_remove(F.split(F.col(text_col), NO_WORD_ANY_CASE, -1), ""), F.split(F.col(text_col), WORD_ANY_CASE, -1)
    parts = F.arrays_zip(words.alias("w"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("g"))
    kept = F.transform(parts, lambda p, i: F.when(F.array_contains(hit, i), F.lit("")).otherwise(F.concat(p["w"], p["g"])))
    cleaned = F.when(F.col(hit).isNull(), F.col(text_col)).otherwise(F.concat(gaps[0], F.array_join(kept, "")))
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns])


ORACLE_SQL = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i + 1 : i + 8], ' ') AS gram
       FROM iw, unnest(range(0, greatest(len(w) - 8, 0) + 1)) AS r(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM ig),
dg AS (SELECT doc_id, i AS pos, n, array_to_string(w[i + 1 : i + n], ' ') AS gram
       FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, pos, n, item_id FROM dg JOIN ig USING (n, gram)),
nh AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
