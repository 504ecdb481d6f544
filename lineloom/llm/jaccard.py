"""Near-duplicate classes: an exact n-gram Jaccard join by parity sketches.

Every text is a set of word shingles. Sets of similar size fall into the same or neighbouring size bands. In a
band whose pairs may differ in at most D shingles at the threshold, a set's shingles are dealt by hash into
D + 1 (and a few more) pieces, and the hashes of each piece are XORed into the bits of a sketch. The pieces in
which two sketches differ are at most as many as the shingles in which the sets differ, so by the pigeonhole
principle a pair that links agrees in a piece: an equi-join on (band, piece, bits) finds all links. Candidates
are then sifted by the Hamming distance of a second parity sketch, which is also at most the symmetric difference.
That sketch has two to four bits for each shingle, so that it tells pairs apart at any size (the longer one of two
is folded to the length of the other). What is left is verified with the sets themselves, made again from the texts.

No group is expanded into all its pairs: equal sets become one class first; in a group that shares a piece each
class is first compared with one pivot. A piece that many sets of a batch share is told of the first HOT of them
only; the others are dealt by class and paired with one of those, so that no task gets all rows of a frequent
piece. Where a group still holds several components, their classes' sketches are
compared in place; in the first rounds only pairs that connect what the sketches allow to link are verified (at
most one a class), in the last round all of them that still lie in different components, so that no link between
different components is missed. Components grow by large-star and
small-star steps over tables in the shared folder.

Defined results: texts that are null or hold no words have 0 shingles and stay alone; equal rows and rows that
repeat an id are rows of their own that link like any others; null ids take part, and a component's id is its
smallest id that isn't null; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, map_arrow, materialize, row_key, sent_if_small
from .shingles import mix, shingle_sets

MAX_ROUNDS = 2
#: How often classes that share too few pieces go before any are compared.
SIEVES = 1
#: Ids of so many texts or fewer are sent to every executor (some 50 bytes each), so that texts need no shuffle; with more of them texts are shuffled once.
BROADCAST_ROWS = 500_000
#: Rows of a group that are compared with each other in one go.
CHUNK_ROWS = 256
#: Words of the least sketch.
SKETCH_WORDS = 8
#: Sets of a batch that tell a frequent piece to the task that gathers it.
HOT = 16
#: Keys that a worker gathers before it looks for frequent ones, and words of sketches that it compares in one go.
KEYS, COMPARED = 250_000, 1 << 20


class Bands:
    """Size bands for the threshold num / den: pairs that link lie in one band or in neighbouring ones."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.low = [1]

    def grow(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(self.low[-1] * self.den // self.num + 1)

    def pieces(self, band: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each band: pieces, and how many of them may be empty before empty ones must be keys as well.

        D + 1 pieces guarantee an agreement; E more guarantee E more. So there is one in a piece with shingles, if no more than
        E are empty, and a set that shares fewer pieces with others than that guarantees links with none.
        """
        top = int(band.max(initial=0)) + 2
        while len(self.low) <= top:
            self.low.append(self.low[-1] * self.den // self.num + 1)
        count, spare = np.zeros(top, np.int64), np.zeros(top, np.int64)
        for b in range(top):
            differ = (self.den - self.num) * 2 * (self.low[b + 1] - 1) // (self.den + self.num)
            empty = (differ + 1) * math.exp(-self.low[b] / (differ + 1))
            spare[b] = max(0, math.ceil(empty + 2 * math.sqrt(empty) - 0.25)) + min(3, differ // 6) if differ else 0
            count[b] = differ + 1 + spare[b] if differ else 0  # no difference allowed: only equal sets, which are one class already
        return count[band], spare[band]


def piece_keys(sets: list[np.ndarray], bands: Bands, up: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """For each set the keys of its pieces, in its own band or (up) as seen from the next band, and how many of them it shares with every set it links with, at least."""
    n = np.array([len(s) for s in sets], np.int64)
    bands.grow(int(n.max(initial=0)))
    band = np.searchsorted(bands.low, n, "right") - 1 + up
    count, spare = bands.pieces(np.maximum(band, 0), n)
    count[n == 0] = 0
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    first = np.concatenate(([0], np.cumsum(count)))
    used = count[owner] > 0
    flat, owner = flat[used], owner[used]
    piece = first[owner] + (((flat >> np.uint64(32)) * count[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    bits = np.zeros(first[-1], np.uint64)  # sets are sorted, so that the shingles of a piece are neighbours
    if len(piece):
        at = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        bits[piece[at]] = np.bitwise_xor.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
    filled = np.zeros(first[-1], bool)
    filled[piece] = True
    of = np.repeat(np.arange(len(sets)), count)
    number = np.arange(first[-1]) - first[of]
    keys = mix(bits ^ mix((band[of] * (1 << 32) + number).astype(np.uint64)))
    empty = np.bincount(of[~filled], minlength=len(sets))
    keep = filled | (empty > spare)[of]
    need = spare + 1 - np.where(empty > spare, 0, empty)
    return np.split(keys[keep].view(np.int64), np.cumsum(np.bincount(of[keep], minlength=len(sets)))[:-1]) if sets else [], need


def sketch_words(n: np.ndarray) -> np.ndarray:
    """The words of the sketches of sets of n shingles: a power of two, of at least 2 * n bits."""
    return np.maximum(SKETCH_WORDS, 1 << np.ceil(np.log2(np.maximum(n, 1) / 32)).astype(np.int64).clip(0))


def parity_sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Bits in which each shingle flips one. A sketch's halves XORed are the sketch of half as many bits."""
    n = np.array([len(s) for s in sets], np.int64)
    words = sketch_words(n)
    first = np.concatenate(([0], np.cumsum(words)))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    bit = flat & (np.repeat(words, n) * 64 - 1).astype(np.uint64)
    odd = np.bincount(np.repeat(first[:-1] * 64, n) + bit.astype(np.int64), minlength=int(first[-1]) * 64) & 1
    packed = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return [packed[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def sketch_distances(flat: np.ndarray, first: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Hamming distances of the sketches at places a and b, which lie in flat from first on, each folded to the shorter one's length."""
    least = np.minimum(words[a], words[b])
    out = np.zeros(len(a), np.int64)
    for w in np.unique(least).tolist():
        at = np.flatnonzero(least == w)
        for i in range(0, len(at), max(1, COMPARED // w)):
            some = at[i : i + max(1, COMPARED // w)]
            folded = []
            for rows in (a[some], b[some]):
                x = flat[first[rows][:, None] + np.arange(w)]
                for fold in range(1, int(words[rows].max(initial=w)) // w):
                    more = np.flatnonzero(words[rows] > fold * w)
                    x[more] ^= flat[first[rows[more]][:, None] + np.arange(w) + fold * w]
                folded.append(x)
            out[some] = np.bitwise_count((folded[0] ^ folded[1]).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _classes(sets: list[np.ndarray], salt: int) -> list[bytes]:
    return [hashlib.blake2b(s.tobytes(), digest_size=24, salt=salt.to_bytes(8, "little")).digest() for s in sets]


def _class_ids(names: list[bytes]) -> np.ndarray:
    """Class ids of 63 bits, so that one more bit finds room beside them."""
    return np.array([int.from_bytes(d[:8], "little", signed=True) >> 1 for d in names], np.int64)


def sketch_rows(docs: DataFrame, width: int, salt: int) -> DataFrame:
    """doc, row_key, n, cid, digest (both of the set), sketch: a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in shingle_sets(batch["t"], width):
                own, names = batch.slice(at, len(sets)), _classes(sets, salt)
                made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(_class_ids(names)), pa.array([d[8:] for d in names], pa.binary()), _lists(parity_sketches(sets))]
                yield pa.RecordBatch.from_arrays([own["doc"], own["row_key"], *made], names=["doc", "row_key", "n", "cid", "digest", "sketch"])

    kind = docs.schema["doc"].dataType.simpleString()
    return map_arrow(docs, run, f"doc {kind}, row_key long, n long, cid long, digest binary, sketch array<long>")


def key_rows(docs: DataFrame, width: int, num: int, den: int, salt: int) -> DataFrame:
    """key, deal, code, leader, need: the pieces of every class; code is twice the class id, plus 1 for a piece as seen from the next band.

    A task tells the copies of a set once. Of the sets of a batch that share a piece, HOT of either kind are dealt by the piece
    alone (deal is null); the others have one of those as their leader and are dealt by their class as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        told: set[int] = set()
        keys: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        needs: list[np.ndarray] = []

        def batch_of() -> pa.RecordBatch:
            key, code, need = np.concatenate(keys), np.concatenate(codes), np.concatenate(needs)
            for x in (keys, codes, needs):
                x.clear()
            order = np.lexsort((code & 1, key))
            sorted_key, sorted_code = key[order], code[order]
            new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
            start = np.flatnonzero(new)[np.cumsum(new) - 1]
            kind = np.concatenate(([True], new[1:] | (sorted_code[1:] & 1 != sorted_code[:-1] & 1)))
            rank = np.arange(len(key)) - np.flatnonzero(kind)[np.cumsum(kind) - 1]
            more, leader = np.empty(len(key), bool), np.empty(len(key), np.int64)
            more[order], leader[order] = rank >= HOT, sorted_code[start]
            # in the order of the sets, whose codes then compress well
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(code, mask=~more), pa.array(code), pa.array(leader, mask=~more), pa.array(need, pa.int16())], names=["key", "deal", "code", "leader", "need"])

        for batch in batches:
            for _, sets in shingle_sets(batch["t"], width):
                new = []
                for k, c in enumerate(_class_ids(_classes(sets, salt)).tolist()):
                    if c not in told:
                        told.add(c)
                        new.append((k, c))
                sets, ids = [sets[k] for k, _ in new], np.array([c for _, c in new], np.int64)
                for up in (0, 1):
                    own, need = piece_keys(sets, bands, bool(up))
                    counts = [len(k) for k in own]
                    keys += own
                    codes.append(np.repeat(2 * ids + up, counts))
                    needs.append(np.repeat(need.astype(np.int16), counts))
                if sum(map(len, keys)) > KEYS:
                    yield batch_of()
        if sum(map(len, keys)):
            yield batch_of()

    return map_arrow(docs, run, "key long, deal long, code long, leader long, need short")


def key_groups(keyed: DataFrame) -> DataFrame:
    """Those rows (key, deal, code, leader, ...) that share their key with another class, with the group's pivot; repeated rows once."""
    in_order = Window.partitionBy("key", "deal").orderBy("code")
    by_key = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind = F.struct(F.col("code").bitwiseAND(1).alias("up"), F.col("code").alias("code"))
    seen = keyed.select("*", F.min(kind).over(by_key).alias("least"), F.min("code").over(by_key).alias("lo"), F.max("code").over(by_key).alias("hi"), F.lag("code").over(in_order).eqNullSafe(F.col("code")).alias("again"))
    grouped = (F.shiftright("lo", 1) != F.shiftright("hi", 1)) & (F.col("least.up") == 0)
    return seen.filter(~F.col("again") & (grouped | F.col("leader").isNotNull())).select(*keyed.columns, F.coalesce("leader", "least.code").alias("pivot"))


def possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, n_a, n_b of those pairs whose sizes and sketches allow a link."""
    one, two = (classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    fits = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.concatenate([np.array(batch[c].flatten()) for c in ("s_a", "s_b")])
            words = np.concatenate([np.array(pc.list_value_length(batch[c]), np.int64) for c in ("s_a", "s_b")])
            first = np.cumsum(words) - words
            at = np.arange(batch.num_rows)
            apart = sketch_distances(flat, first, words, at, at + batch.num_rows)
            total = np.array(batch["n_a"]) + np.array(batch["n_b"])
            yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(apart * (den + num) <= total * (den - num)))

    return map_arrow(pairs.join(one, "a").join(two, "b").filter(fits).select("a", "b", "n_a", "n_b", "s_a", "s_b"), run, "a long, b long, n_a long, n_b long")


def verified(near: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """a, b of those pairs whose sets link; texts: cid, t. Skewed pivots are split by the join."""
    left, right = (texts.select(F.col("cid").alias(x), F.col("t").alias(f"t_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                one, two = ([s for _, sets in shingle_sets(part[c], width) for s in sets] for c in ("t_a", "t_b"))
                for x, y in zip(one, two, strict=True):
                    both = len(x) + len(y) - len(np.union1d(x, y))
                    ok.append(both * den >= (len(x) + len(y) - both) * num)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(near.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "t_a", "t_b"), run, "a long, b long")


def sifted(members: DataFrame, classes: DataFrame, num: int, den: int, forest: int | None) -> DataFrame:
    """key, a, b: pairs in a group (members: key, cid, up, root, size) from different components that sizes and sketches allow to link.

    forest: of each group only so many pairs as connect what they can connect, in an order that differs by this number.
    Large groups are dealt into chunks, and each pair of chunks is compared by itself, so that no task gets a large group.
    """
    chunks = F.ceil(F.col("size") / CHUNK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("cid"), chunks).cast("int")
    dealt = members.select("key", "cid", "up", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "up", "root", "own")
    rows = dealt.join(classes.select("cid", "n", "sketch"), "cid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    salt = np.uint64((forest or 0) * 0x9E3779B97F4A7C15 % (1 << 64))

    def compare(g: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of places a, b may link."""
        n_a, n_b = g["n"][a], g["n"][b]
        fits = (g["root"][a] != g["root"][b]) & (g["up"][a] + g["up"][b] < 2) & (n_a * den >= n_b * num) & (n_b * den >= n_a * num) & ((g["own"][a] != g["own"][b]) | (g["i"][a] == g["j"][a]))
        at = np.flatnonzero(fits)
        apart = sketch_distances(g["sketch"], g["first"], g["words"], a[at], b[at])
        fits[at] = apart * (den + num) <= (n_a[at] + n_b[at]) * (den - num)
        return fits

    def group(g: dict[str, np.ndarray], lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        found_a, found_b = [], []
        for x in range(lo, hi, 32):
            a, b = (y.ravel() for y in np.meshgrid(np.arange(x, min(x + 32, hi)), np.arange(x, hi), indexing="ij"))
            a, b = a[a < b], b[a < b]
            ok = compare(g, a, b)
            found_a.append(a[ok])
            found_b.append(b[ok])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if forest is None or len(a) < 2:
            return a, b
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        kept = []
        order = np.argsort(mix(g["cid"][a].view(np.uint64) ^ mix(g["cid"][b].view(np.uint64) ^ salt)), kind="stable")
        for k in order.tolist():
            one, two = find(int(g["root"][a[k]])), find(int(g["root"][b[k]]))
            if one != two:
                parent[one] = two
                kept.append(k)
        return a[kept], b[kept]

    def pairs_of(g: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(g["cid"])
        cut = np.flatnonzero(np.concatenate(([True], (g["key"][1:] != g["key"][:-1]) | (g["i"][1:] != g["i"][:-1]) | (g["j"][1:] != g["j"][:-1]))))
        ends = np.append(cut[1:], n)
        two = cut[ends - cut == 2]
        ok = compare(g, two, two + 1)
        a, b = [two[ok]], [two[ok] + 1]
        for lo, hi in zip(cut[ends - cut > 2].tolist(), ends[ends - cut > 2].tolist(), strict=True):
            x, y = group(g, lo, hi)
            a.append(x)
            b.append(y)
        one, other = g["cid"][np.concatenate(a)], g["cid"][np.concatenate(b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (g["key"][np.concatenate(a)], np.minimum(one, other), np.maximum(one, other))], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g = {c: np.array(batch[c]) for c in ("key", "i", "j", "cid", "up", "root", "own", "n")}
            g["words"] = np.array(pc.list_value_length(batch["sketch"]), np.int64)
            g["sketch"] = np.array(batch["sketch"].flatten())
            if held is not None:
                g = {c: np.concatenate((held[c], g[c])) for c in g}
            g["first"] = np.cumsum(g["words"]) - g["words"]
            # the last group may go on in the next batch
            same = np.flatnonzero((g["key"] == g["key"][-1]) & (g["i"] == g["i"][-1]) & (g["j"] == g["j"][-1]))[0]
            held = {c: x[int(g["first"][same]) :] if c == "sketch" else x[same:] for c, x in g.items() if c != "first"}
            if same:
                yield pairs_of({c: x if c == "sketch" else x[:same] for c, x in g.items()})
        if held is not None:
            yield pairs_of(held | {"first": np.cumsum(held["words"]) - held["words"]})

    return map_arrow(rows, run, "key long, a long, b long")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node, root: every node of the links with the smallest node that it is connected with."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = materialize(small, label)
        # done when every node has one parent and no parent has a parent
        stars = after.groupBy("u").count().filter("count > 1").isEmpty() and after.select(F.col("v").alias("x")).join(after.select(F.col("u").alias("x")), "x", "left_semi").isEmpty()
        edges = after
        if stars:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The classes and components of documents, as in classified."""
    return classified(docs, width, num, den, id_col, text_col)[0]


def classified(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """doc, row_key, n_shingles, class_id, component_id, component: a row for each row of docs.

    class_id names the different sets, component the connected ones (ids alone can't, where they repeat); null for empty sets. Rows link when den * intersection >= num * union.
    Also the pairs doc, row_key that several rows have, or None where there are none.
    """
    texts = docs.select(F.col(id_col).alias("doc"), row_key(F.col(text_col)).alias("row_key"), F.col(text_col).alias("t"))
    salt = 0
    while True:  # a class is known by 64 bits of its set's hash; should two sets share them, others are taken
        rows = materialize(sketch_rows(texts, width, salt), "jaccard-rows")
        # one class for all rows with the same set; a class is represented by its first row
        grouped = rows.filter("n > 0").groupBy("cid").agg(F.max("n").alias("n"), F.min(F.struct("doc", "row_key")).alias("rep"), F.min("doc").alias("least_doc"), F.first("sketch").alias("sketch"), (F.min("digest") == F.max("digest")).alias("one"))
        classes = materialize(grouped, "jaccard-classes")
        if classes.filter("not one").isEmpty():
            break
        salt += 1
    several = materialize(rows.groupBy("doc", "row_key").count().filter("count > 1").select("doc", "row_key"), "jaccard-repeated")
    repeated = not several.isEmpty()

    # groups of classes that agree in a piece and hold a class of the piece's own band
    groups = materialize(key_groups(key_rows(texts, width, num, den, salt)), "jaccard-groups")
    for _ in range(SIEVES):  # a class that shares too few pieces with all others together links with none of them
        able = groups.groupBy("code").agg(F.count("*").alias("shares"), F.max("need").alias("need")).filter("shares >= need").select("code")
        fewer = materialize(key_groups(groups.drop("pivot").join(able, "code", "left_semi")), "jaccard-groups")
        discard(groups)
        groups = fewer
    members = groups.select("key", F.shiftright("code", 1).alias("cid"), F.col("code").bitwiseAND(1).cast("byte").alias("up"), F.shiftright("pivot", 1).alias("pivot"))

    held: list[DataFrame] = []  # the texts of the classes that were needed so far

    def texts_of(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        for h in held:
            needed = needed.join(h.select("cid"), "cid", "left_anti")
        needed = materialize(needed.join(classes.select("cid", "rep"), "cid").select("cid", F.col("rep.doc").alias("d"), F.col("rep.row_key").alias("k")), "jaccard-needed")
        chosen = texts.join(sent_if_small(needed, BROADCAST_ROWS), F.col("doc").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k"))).select("cid", "t")
        held.append(materialize(chosen.dropDuplicates(["cid"]) if repeated else chosen, "jaccard-texts"))
        return reduce(DataFrame.unionByName, held)

    def linked(near: DataFrame) -> DataFrame:
        return materialize(verified(near, texts_of(near), width, num, den), "jaccard-links")

    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    pairs = members.filter("cid <> pivot").select(*ordered("cid", "pivot")).distinct()
    # of all that may link with a class, the smallest is verified first; what that leaves apart comes in the rounds
    best = possible(pairs, classes, num, den).groupBy("b").agg(F.min("a").alias("a"))
    near = materialize(best.select("a", "b"), "jaccard-near")
    links = linked(near)
    roots = components(links)
    left, tried = members, near.select("a", "b")
    for r in range(1, MAX_ROUNDS + 1):
        # groups that still hold several components
        placed = left.select("key", "cid", "up").join(roots, F.col("cid") == F.col("node"), "left").select("key", "cid", "up", F.coalesce("root", "cid").alias("root"))
        spread = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("key", "size")
        left = materialize(placed.join(spread, "key"), "jaccard-left")
        if left.isEmpty():
            break
        last = r == MAX_ROUNDS
        found = materialize(sifted(left, classes, num, den, forest=None if last else r), "jaccard-found")
        pairs = materialize(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        tried = tried.unionByName(pairs)
        more = linked(materialize(possible(pairs, classes, num, den), "jaccard-near"))
        links = links.unionByName(more)
        if not more.isEmpty():
            roots = components(links)
        # all that may link in a group is connected, if all its pairs in a forest do
        open_keys = found.join(more, ["a", "b"], "left_anti").select("key").distinct()
        left = left.select("key", "cid", "up").join(open_keys, "key", "left_semi")
    for used in (groups, *held):  # what comes below reads rows, classes and roots only
        discard(used)

    placed = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "least_doc", F.coalesce("root", "cid").alias("root"))
    least = placed.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    final = placed.join(least, "root").select(F.col("cid").alias("class_id"), "component_id", F.col("root").alias("component"))
    out = rows.withColumn("cid", F.when(F.col("n") > 0, F.col("cid"))).join(final, F.col("cid") == F.col("class_id"), "left")
    alone = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return out.select("doc", "row_key", F.col("n").alias("n_shingles"), "class_id", alone.alias("component_id"), "component"), several if repeated else None


def deduplicate(docs: DataFrame, *, width: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one with the smallest id, and of equal ids the smallest text hash.

    Of rows that are equal in both, one stays. Rows without words are no duplicates of each other, but of rows that are equal to them.
    What is joined to the texts is the rows that go.
    """
    found, several = classified(docs, width, num, den, id_col, text_col)
    own = F.struct("doc", "row_key")
    linked = found.filter("n_shingles > 0")
    first = linked.groupBy("component").agg(F.min(own).alias("first"), F.max(own).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("component").alias("group"), "first")
    gone = materialize(linked.join(first, F.col("component") == F.col("group")).filter(~own.eqNullSafe(F.col("first"))).select("doc", "row_key"), "jaccard-gone")
    key = free_name(docs, "row_key_")
    keyed = docs.withColumn(key, row_key(F.col(text_col)))
    same = lambda rows: keyed[id_col].eqNullSafe(rows["doc"]) & (keyed[key] == rows["row_key"])
    out = gone if several is None else materialize(gone.unionByName(several), "jaccard-gone")
    once = keyed.join(sent_if_small(out, BROADCAST_ROWS), same(out), "left_anti")
    if several is None:
        return once.select(*docs.columns)
    again = several.join(gone, several["doc"].eqNullSafe(gone["doc"]) & (several["row_key"] == gone["row_key"]), "left_anti")
    return once.unionByName(keyed.join(again, same(again), "left_semi").dropDuplicates([id_col, key])).select(*docs.columns)
