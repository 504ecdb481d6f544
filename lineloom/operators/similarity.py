"""Fingerprints and fuzzy matching. 64-bit arithmetic that wraps and edit distances that Spark lacks run on Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import pieces
from .rounds import checkpointed

#: FNV-1a.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
MASK = (1 << 64) - 1


def shingles(text: Column, n: int) -> Column:
    """Windows of n lower-cased words between white space."""
    w = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+", -1), "")
    return F.transform(F.array(w), lambda x: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(1), F.size(x) - n + 1), lambda i: F.array_join(F.slice(x, i, n), " "))).otherwise(F.array().cast("array<string>")))[0]


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def fnv1a(data: bytes, seed: int = 0) -> int:
    return int(fnv1a_all([data], (seed,))[0, 0])


def fnv1a_all(items: list[bytes], seeds: tuple[int, ...] = (0,)) -> np.ndarray:
    """Hashes of all items, a row for each seed."""
    sizes = np.array([len(x) for x in items], np.int64)
    return _fnv1a(np.frombuffer(b"".join(items), np.uint8), np.cumsum(sizes) - sizes, sizes, seeds)


def _fnv1a(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, seeds: tuple[int, ...]) -> np.ndarray:
    """Byte after byte, of all items that are that long at once."""
    order = np.argsort(-sizes, kind="stable")
    begins = begins[order]
    left = np.append(np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right"), 0)
    h = np.repeat((np.array(seeds, np.uint64) ^ np.uint64(BASIS))[:, None], len(sizes), axis=1)
    for i, n in enumerate(left[:-1].tolist()):
        now = h[:, :n]
        np.bitwise_xor(now, data[begins[:n] + i], out=now)
        np.multiply(now, np.uint64(PRIME), out=now)
    out = np.empty_like(h)
    out[:, order] = h
    return out


def shingled(df: DataFrame, text_col: str, n: int, name: str) -> DataFrame:
    """df with the shingles of a text, made before any Python worker sees them."""
    return df.select("*", F.explode(F.array(shingles(F.col(text_col), n))).alias(name))


#: How many shingles are hashed at once.
AT_ONCE = 4096


def _hashed(parts: pa.Array, seeds: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes (a row for each seed) and the row numbers, ascending, of the shingles of all rows, some at a time, straight from Arrow's buffers."""
    parts = parts.cast(pa.list_(pa.string()))
    rows, items = pc.list_parent_indices(parts).to_numpy(), parts.flatten()
    _, places, data = items.buffers()
    if not len(items):
        return
    offsets = np.frombuffer(places, np.int32)[items.offset : items.offset + len(items) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    for at in range(0, len(items), AT_ONCE):
        o = offsets[at : at + AT_ONCE + 1]
        yield _fnv1a(data, o[:-1], np.diff(o), seeds), rows[at : at + AT_ONCE]


@F.arrow_udf(T.LongType())
def simhash(parts: pa.Array) -> pa.Array:
    """Of an array of shingles, repeats included, as a signed number."""
    votes = np.zeros((len(parts), 64), np.int64)
    for hashes, rows in _hashed(parts, (0,)):
        bits = np.unpackbits(hashes[0].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.diff(rows, prepend=-1))
        votes[rows[begins]] += np.add.reduceat(2 * bits.astype(np.int32) - 1, begins, axis=0)
    return pa.array(np.packbits((votes > 0).astype(np.uint8), axis=1, bitorder="little").view("<i8")[:, 0], pa.int64())


def minhash(count: int = 100):
    """A function of an array of shingles: the least hash by each of count seeds, as signed numbers (unsigned order)."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def signature(parts: pa.Array) -> pa.Array:
        least = np.full((len(parts), count), MASK, np.uint64)
        for hashes, rows in _hashed(parts, tuple(range(count))):
            begins = np.flatnonzero(np.diff(rows, prepend=-1))
            at = rows[begins]
            least[at] = np.minimum(least[at], np.minimum.reduceat(hashes, begins, axis=1).T)
        return pa.ListArray.from_arrays(np.arange(0, least.size + 1, count, np.int32), pa.array(least.view(np.int64).ravel()))

    return signature


def shared_shingles(df: DataFrame, id_col: str, items: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """id, item, jaccard: every text against every item that shares a shingle with it. Shared shingles are counted, not sets compared."""
    def sets(d: DataFrame, key: str, name: str) -> DataFrame:
        made = d.select(F.col(key), F.explode(F.array(F.array_distinct(shingles(F.col(text_col), n)))).alias("_s"))
        return made.select(F.col(key), F.size("_s").alias(name), F.explode("_s").alias("_x"))

    met = sets(df, id_col, "_na").join(sets(items, item_col, "_nb"), "_x").groupBy(id_col, item_col, "_na", "_nb").agg(F.count("*").alias("_c"))
    return met.select(id_col, item_col, (F.col("_c") / (F.col("_na") + F.col("_nb") - F.col("_c"))).alias("jaccard"))


def similar_signatures(df: DataFrame, id_col: str, signature: str, count: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes of equal signatures (class, id), and pairs of classes (a < b) that agree in threshold of count positions or more.

    Signatures that may disagree in d positions agree in one of d + 1 bands as a whole, so no pair is missed. A class is
    named after its smallest id and takes part once, however many rows it has.
    """
    known = checkpointed(df.select(F.col(id_col).alias("id"), F.col(signature).alias("s"))).filter("id is not null and s is not null")  # a filter in front would have signatures made twice
    classes = checkpointed(known.groupBy("s").agg(F.min("id").alias("class")))
    members = checkpointed(known.join(classes, "s").select("class", "id"))
    bands = min(count - math.ceil(threshold * count - 1e-9) + 1, count)
    edges = [count * i // bands for i in range(bands + 1)]
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("s", a + 1, b - a)).alias("h")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])
    keyed = classes.select("class", "s", F.explode(keys).alias("k"))
    met = keyed.toDF("a", "sa", "k").join(keyed.toDF("b", "sb", "k"), "k").filter((F.col("a") < F.col("b")) & (minhash_similarity(F.col("sa"), F.col("sb")) >= threshold - 1e-9))
    return members, met.select("a", "b").distinct()


def find_duplicates(df: DataFrame, id_col: str, signature: str, count: int, threshold: float) -> DataFrame:
    """leader, id: in order of ids, a row that no leader has taken becomes one and takes all later rows like it.

    Groups have two rows or more. Rows without id or signature take no part. In each round a class whose smaller
    neighbours are all taken leads, and neighbours of leaders are taken by the smallest; a leader's members aren't compared
    with each other.
    """
    members, pairs = similar_signatures(df, id_col, signature, count, threshold)
    pairs = checkpointed(pairs)
    left = checkpointed(members.select(F.col("class").alias("c")).distinct())
    found, open_ = [], pairs
    while not left.isEmpty():
        leaders = checkpointed(left.join(open_.select(F.col("b").alias("c")).distinct(), "c", "left_anti"))
        taken = checkpointed(pairs.join(leaders, pairs["a"] == leaders["c"]).join(left.toDF("b"), "b").groupBy("b").agg(F.min("a").alias("leader")))
        found += [leaders.select("c", F.col("c").alias("leader")), taken.select(F.col("b").alias("c"), "leader")]
        gone = taken.select(F.col("b").alias("c")).union(leaders)
        left = checkpointed(left.join(gone, "c", "left_anti"))
        open_ = checkpointed(open_.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti"))
    if not found:
        return members.select(F.col("class").alias("leader"), "id").limit(0)
    led = members.join(reduce(DataFrame.union, found).withColumnRenamed("c", "class"), "class").select("leader", "id")
    several = led.groupBy("leader").agg(F.count("*").alias("n")).filter("n > 1").select("leader")
    return led.join(several, "leader")


#: The base and the modulus of rolling hashes.
BASE, MODULUS = 257, (1 << 61) - 1


def rolling_hashes(items: list[bytes], size: int) -> list[np.ndarray]:
    """Hashes of all windows of size bytes, of all items side by side; products wrap at 64 bits before the modulus."""
    p, base = np.uint64(MODULUS), np.uint64(BASE)
    top = 1
    for _ in range(size - 1):
        top = (top * BASE & MASK) % MODULUS
    order = sorted((i for i in range(len(items)) if len(items[i]) >= size > 0), key=lambda i: -len(items[i]))
    out = [np.empty(0, np.uint64)] * len(items)
    if not order:
        return out
    sizes = np.array([len(items[i]) for i in order])
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(items[i] for i in order), np.uint8)
    hashes = np.empty(len(data), np.uint64)
    h = np.zeros(len(order), np.uint64)
    for k in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -k, "left"))  # items longer than k
        at, now = begins[:n] + k, h[:n]
        if k >= size:
            now = (now + p - data[at - size].astype(np.uint64) * np.uint64(top) % p) % p
        h[:n] = (now * base + data[at]) % p
        hashes[at] = h[:n]
    for i, b, n in zip(order, begins, sizes, strict=True):
        out[i] = hashes[b + size - 1 : b + n]
    return out


#: Bytes of texts whose rolling hashes are held at once.
HELD = 1 << 22


def chunk_boundaries(size: int, mask: int):
    """A function of texts: byte offsets behind windows whose hash has no bit of mask."""
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def found(text: pa.Array) -> pa.Array:
        out: list = [None] * len(text)
        data = text.cast(pa.large_binary()).fill_null(b"")
        sizes = pc.binary_length(data).to_numpy()
        order = np.argsort(-sizes, kind="stable")  # texts of like length go side by side
        for some in np.split(order, np.flatnonzero(np.diff(np.cumsum(sizes[order]) // HELD)) + 1):
            hashes = rolling_hashes(data.take(pa.array(some)).to_pylist(), size)
            for i, h in zip(some.tolist(), hashes, strict=True):
                out[i] = np.flatnonzero((h & np.uint64(mask)) == 0) + size
        return pa.array(out, pa.list_(pa.int64()))

    return found


def minhash_similarity(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    moved = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) / 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_jaro(x or "", y or "") for x, y in zip(a, b, strict=True)])


def jaro_winkler(a: Column, b: Column, weight: float = 0.1) -> Column:
    """Jaro's similarity, raised by up to four letters at the begin that agree."""
    agree = [F.when((F.length(a) >= i) & (F.left(a, F.lit(i)) == F.left(b, F.lit(i))), 1).otherwise(0) for i in range(1, 5)]
    prefix = sum(agree, F.lit(0)) * weight
    return jaro(a, b) * (1 - prefix) + prefix


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def bounded_levenshtein(a: Column, b: Column, most: int) -> Column:
    """Null beyond most."""
    return F.nullif(F.levenshtein(a, b, most), F.lit(-1))


@F.pandas_udf(T.IntegerType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits, with swaps of neighbours as one."""
    def one(x: str, y: str) -> int:
        two, last = None, list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            now = [i]
            for j, d in enumerate(y, 1):
                best = min(now[j - 1] + 1, last[j] + 1, last[j - 1] + (c != d))
                if two is not None and j > 1 and c == y[j - 2] and x[i - 2] == d:
                    best = min(best, two[j - 2] + 1)
                now.append(best)
            two, last = last, now
        return last[-1]

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


def soundex(word: Column) -> Column:
    """A letter and three digits; h and w part equal codes as vowels do; 0000 without letters."""
    letters = F.upper(F.regexp_replace(word, "[^A-Za-z]", ""))
    #: Fixed value: the code of each letter.
    codes = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    squeezed = F.regexp_replace(codes, r"([0-9])\1+", "$1")
    return F.when(letters == "", "0000").otherwise(F.rpad(F.concat(F.left(letters, F.lit(1)), F.left(F.replace(F.substr(squeezed, F.lit(2)), F.lit("0"), F.lit("")), F.lit(3))), 4, "0"))


def hybrid(a: Column, b: Column) -> Column:
    """Half Jaro-Winkler, three tenths trigrams, two tenths edits."""
    longest = F.greatest(F.length(a), F.length(b))
    edits = F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)
    return 0.5 * jaro_winkler(a, b) + 0.3 * trigram_similarity(a, b) + 0.2 * edits


def fuzzy_search(df: DataFrame, column: str, query: str, top: int = 10, least: float = 0.3) -> DataFrame:
    """value, score: the distinct values most like a query, ties by value."""
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    return values.withColumn("score", hybrid(F.lower("value"), F.lower(F.lit(query)))).filter(F.col("score") >= least).orderBy(F.col("score").desc(), "value").limit(top)


#: Factors of a hash of words that knows what is left when letters go; all is modulo 2^64.
STEP, MIX = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15


def _keys_of(words: np.ndarray, most: int) -> np.ndarray:
    """Hashes of what remains of words of one length (a row of code points each) with up to most letters left out, a row for each word."""
    letters = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
    letters = (letters ^ letters >> np.uint64(31)) * np.uint64(MIX)
    n, size = letters.shape
    up = np.array([pow(STEP, i, 1 << 64) for i in range(size)], np.uint64)
    down = [np.uint64(pow(STEP, -i, 1 << 64)) for i in range(most + 1)]
    sums = np.zeros((size + 1, n), np.uint64)
    np.cumsum((letters * up).T, axis=0, out=sums[1:])
    out = []
    for k in range(min(most, size) + 1):
        for gone in combinations(range(size), k):
            ends, begins = (*gone, size), (0, *(i + 1 for i in gone))
            out.append(sum((sums[e] - sums[b]) * down[i] for i, (b, e) in enumerate(zip(begins, ends, strict=True))))
    return np.array(out).T


def _with_keys(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            sizes = pc.utf8_length(words).to_numpy()
            for size in np.unique(sizes).tolist():
                same = np.flatnonzero(sizes == size)
                at_once = max((1 << 20) // (size**most + 1), 1)
                for at in range(0, len(same), at_once):
                    some = words.take(pa.array(same[at : at + at_once]))
                    points = np.frombuffer("".join(some.to_pylist()).encode("utf-32-le"), np.uint32).reshape(len(some), size)
                    keys = np.sort(_keys_of(points, most), axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    rows, _ = np.nonzero(new)
                    yield from pieces({batch.schema.names[0]: some.take(pa.array(rows)), "key": keys[new].view(np.int64)})

    return run


def suggestions(words: DataFrame, dictionary: DataFrame, most: int = 2, top: int = 3) -> DataFrame:
    """word, suggestion, distance: for words (word) outside the dictionary (word), near ones in it.

    Both sides are joined on hashes of what remains of a word with up to `most` letters left out, which near words share;
    words that only share a hash go by their distance.
    """
    def shortened(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col(name).isNotNull()).mapInArrow(_with_keys(most), f"{name} string, key long")

    longest = F.broadcast(dictionary.agg(F.max(F.length("word")).alias("longest")))  # one row; words that are too long for all of it have the most keys
    unknown = words.select(F.col("word").alias("w")).distinct().join(dictionary.select(F.col("word").alias("w")), "w", "left_anti").join(longest).filter(F.length("w") <= F.col("longest") + most).select("w")
    near = shortened(unknown, "w").join(shortened(dictionary.select(F.col("word").alias("d")).distinct(), "d"), "key").select("w", "d").distinct()
    scored = near.withColumn("distance", F.levenshtein("w", "d", most)).filter("distance >= 0").withColumn("same_sound", soundex(F.col("w")) == soundex(F.col("d")))
    order = Window.partitionBy("w").orderBy(F.col("same_sound").desc(), "distance", "d")
    return scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= top).select(F.col("w").alias("word"), F.col("d").alias("suggestion"), "distance")
