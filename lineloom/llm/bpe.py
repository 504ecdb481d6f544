"""Byte-level BPE encoding and decoding for whole Arrow batches.

Pre-tokenisation uses no regular expression. Every code point gets a class from one table; with the class of
its successor it becomes one of eight symbols, and each symbol is a function from the state before it (inside a
run of letters, behind a prefixing space, ...) to the state after it. Functions compose associatively, so the
states of all positions come from a scan in two levels: rows of symbols are composed side by side, the row
functions are chained, and the rows are replayed from their true first states. A table of (state, symbol) then
tells where pieces start. Pieces are slices of the batch's bytes. Those not known yet are merged all at once: in
every step each piece merges its first pair of least rank, as a table of pairs gives it; pieces of more than 16 bytes
go through the library's compiled loop one by one. What pieces become is kept for later batches.

Decoding gathers the bytes of the ids; the offsets of ids in the text are kept.

Defined results: null and empty texts have no ids and decode to an empty text; texts of any length are cut only
where the scan starts a piece; equal rows and ids, null ids and other columns pass through unchanged.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow

#: Code points that are handled in one go.
CHUNK = 1 << 19
#: Pieces whose ids are kept by a worker.
CACHED = 1_500_000
#: Places of the table of short pieces, as a power of two, and places that are looked at for one.
SLOTS, PROBES = 22, 4
#: Bytes of a short piece.
SHORT_PIECE = 16
ROW = 256
#: Keeps the first 0 to 8 bytes of a lane.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)

#: The contractions of the pattern (behind the apostrophe), and its white space beyond what str.isspace says.
SHORT, LONG = "stmd", ("re", "ve", "ll")
NO_SPACE = "\x1c\x1d\x1e\x1f"

LETTER, NUMBER, OTHER, SPACE = range(4)
# symbols: the classes; an apostrophe that could open a contraction of one or two letters; the last white space before other text
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_SHORT, S_LONG, S_PREFIX, S_SINGLE = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, PREFIXED, ONE_MORE, TWO_MORE = range(8)
BEGIN = 8  # added to the symbol at the begin of a text


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """step[state * 16 + symbol] and opens[state * 16 + symbol]: the next state, and whether a piece starts."""
    step, opens = np.zeros((8, 16), np.uint8), np.zeros((8, 16), bool)
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHER, S_SPACE: IN_SPACE}
    for symbol in range(16):
        for state in range(8):
            before, s = (FRESH, symbol - BEGIN) if symbol >= BEGIN else (state, symbol)
            if before in (ONE_MORE, TWO_MORE) and s == S_LETTER:
                to, new = (FRESH if before == ONE_MORE else ONE_MORE), False
            elif s in (S_SHORT, S_LONG) and before not in (IN_OTHER, PREFIXED):
                to, new = (ONE_MORE if s == S_SHORT else TWO_MORE), True
            elif s in (S_PREFIX, S_SINGLE):
                to, new = (PREFIXED if s == S_PREFIX else FRESH), True
            else:
                to = run[S_OTHER if s in (S_SHORT, S_LONG) else s]
                new = not (before == to or before == PREFIXED and s != S_SPACE)
            step[state, symbol], opens[state, symbol] = to, new or symbol >= BEGIN
    return step.ravel(), opens.ravel()


STEP, OPENS = _machine()


@cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
        elif chr(c).isspace() and chr(c) not in NO_SPACE:
            table[c] = SPACE
    return table


def symbols(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The symbol of every code point of texts that begin at begins."""
    kind = class_table()[points]
    n = len(points)
    out = kind.copy()
    last = np.zeros(n, bool)
    last[begins[1:] - 1] = True
    last[n - 1] = True
    follows = np.zeros(n, bool)  # by other text
    follows[:-1] = kind[1:] != SPACE
    follows &= ~last
    ends = np.flatnonzero((kind == SPACE) & follows)
    out[ends] = np.where(points[ends] == 0x20, S_PREFIX, S_SINGLE)
    quotes = np.flatnonzero((points == 0x27) & ~last)
    after = points[quotes + 1]
    out[quotes[np.isin(after, [ord(c) for c in SHORT])]] = S_SHORT
    room = quotes + 2 < n
    quotes, after = quotes[room], after[room]
    two = ~last[quotes + 1]
    for pair in LONG:
        out[quotes[two & (after == ord(pair[0])) & (points[quotes + 2] == ord(pair[1]))]] = S_LONG
    out[begins] += BEGIN
    return out


def piece_starts(symbol: np.ndarray) -> np.ndarray:
    """Positions where a piece starts, by a scan of transition functions in two levels."""
    n = len(symbol)
    rows = -(-n // ROW)
    grid = np.zeros(rows * ROW, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, ROW).T)
    through = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)  # by first state: the state after the row so far
    for column in grid:
        through = STEP[(through << 4) + column]
    first, state = np.zeros(rows, np.uint8), FRESH
    for r in range(rows):
        first[r] = state
        state = through[state, r]
    opens = np.empty((ROW, rows), bool)
    states = first
    for i, column in enumerate(grid):
        at = (states << 4) + column
        opens[i] = OPENS[at]
        states = STEP[at]
    return np.flatnonzero(opens.T.ravel()[:n])


def lanes_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece data[cuts[i] : cuts[i + 1]] its first eight bytes, the next eight, and its size."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 9,), "<u8", buffer=padded, strides=(1,))  # eight bytes from every place on
    begin, size = cuts[:-1], np.diff(cuts)
    return lanes[begin] & KEEP[np.minimum(size, 8)], lanes[np.minimum(begin + 8, len(data))] & KEEP[np.clip(size - 8, 0, 8)], size


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated items of a list of runs that lies in flat, and where each item begins."""
    lengths = offsets[index + 1] - offsets[index]
    begins = np.concatenate(([0], np.cumsum(lengths)))
    return flat[np.repeat(offsets[index] - begins[:-1], lengths) + np.arange(begins[-1])], begins


class Merges:
    """Which pairs of ids merge, in which order and to what: a hash table in arrays, and the merging of many short pieces at once."""

    NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, byte_ids: np.ndarray, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """byte_ids: the id of each byte; a pair left, right of smaller rank merges first."""
        self.byte_ids = byte_ids.astype(np.int32)
        bits = max(10, int(2 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(1 << 63))
        self.ranks, self.made = np.full(1 << bits, self.NONE), np.zeros(1 << bits, np.int32)
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        place = (key * ODD >> self.shift).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):  # those that find their place taken go on to the next
            free = todo[self.keys[place[todo]] == 1 << 63]
            self.keys[place[free]] = key[free]
            own = self.keys[place[todo]] == key[todo]
            self.ranks[place[todo[own]]], self.made[place[todo[own]]] = rank[todo[own]], made[todo[own]]
            todo = todo[~own]
            place[todo] = (place[todo] + 1) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, or that of an empty one."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        place = (key * ODD >> self.shift).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            at = self.keys[place[todo]]
            todo = todo[(at != key[todo]) & (at != 1 << 63)]
            place[todo] = (place[todo] + 1) & self.mask
        return place

    def merge(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and how many each has. In every step each piece merges its first pair of least rank."""
        n = len(size)
        out = self.byte_ids[np.stack((low, high), axis=1).view(np.uint8)]
        counts = size.copy()
        width = int(size.max(initial=1))
        ids = np.ascontiguousarray(out[:, :width])
        left, right = ids[:, :-1].ravel(), ids[:, 1:].ravel()
        place = np.zeros(n * (width - 1), np.int32)
        real = np.flatnonzero((np.arange(1, width) < size[:, None]).ravel())
        place[real] = self.find(left[real], right[real])
        ranks = np.full(n * (width - 1), self.NONE)
        ranks[real] = self.ranks[place[real]]
        ranks, place = ranks.reshape(n, width - 1), place.reshape(n, width - 1)
        rows, columns = np.arange(n), np.arange(width, dtype=np.int8)
        while width > 1 and len(rows):
            at = ranks.argmin(axis=1).astype(np.int8)
            live = ranks[np.arange(len(rows)), at] != self.NONE
            out[rows[~live], :width] = ids[~live]
            rows, ids, ranks, place, at = rows[live], ids[live], ranks[live], place[live], at[live]
            k = np.arange(len(rows))
            merged = self.made[place[k, at]]
            # what lies behind the pair moves up by one
            behind = columns[:-1] >= at[:, None]
            ids[:, 1:-1] = np.where(behind[:, :-1], ids[:, 2:], ids[:, 1:-1])
            ids[k, at] = merged
            counts[rows] -= 1
            for x in (ranks, place):
                x[:, :-1] = np.where(behind[:, :-1], x[:, 1:], x[:, :-1])
            ranks[:, -1] = self.NONE
            for pair, some in ((at - 1, np.flatnonzero(at > 0)), (at, np.flatnonzero(at + 1 < counts[rows]))):
                p = self.find(ids[some, pair[some]], ids[some, pair[some] + 1])
                ranks[some, pair[some]], place[some, pair[some]] = self.ranks[p], p
        return out[np.arange(out.shape[1]) < counts[:, None]], counts


class Codec:
    """Encoding and decoding by the ranks of a vocabulary file with a line of base64 and rank for each token."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        size = tokens[-1][1] + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in tokens:
            lengths[rank] = len(token)
        self.bytes = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        ranks = self.ranks
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in tokens for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.merges = Merges(np.array([ranks[bytes([b])] for b in range(256)]), left, right, rank, rank)
        self.merge = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # long pieces
        self.count = 0  # of pieces; the ids of each lie in ids from ends[k] to ends[k + 1]
        self.ids, self.ends = np.zeros(1 << 18, np.int32), np.zeros(1 << 16, np.int64)
        self.slots = np.zeros(1 << SLOTS, np.int32)  # numbers of short pieces plus 1; what is 0 takes no memory before it is written
        self.low, self.high, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint8)

    def append(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Keeps the ids of new pieces. The number of the first."""
        first, n = self.count, self.count + len(counts)
        room = lambda x, size: x if len(x) >= size else np.concatenate((x, np.zeros(max(size, 2 * len(x)) - len(x), x.dtype)))
        start = int(self.ends[first])
        self.ids, self.ends = room(self.ids, start + len(ids)), room(self.ends, n + 1)
        self.low, self.high, self.size = room(self.low, n), room(self.high, n), room(self.size, n)
        self.ids[start : start + len(ids)] = ids
        self.ends[first + 1 : n + 1] = start + np.cumsum(counts)
        self.count = n
        return first

    def numbers(self, data: bytes, cuts: np.ndarray) -> np.ndarray:
        """The number of each piece among the known ones; new pieces become known.

        Short pieces are compared byte for byte with those at their places of a table, all at once, and merged all at once; long ones are cut out and looked up one by one.
        """
        low, high, size = lanes_of(np.frombuffer(data, np.uint8), cuts)
        key = ((low * ODD ^ high) + size.astype(np.uint64)) * ODD
        slot = (key >> np.uint64(64 - SLOTS)).astype(np.int64)
        mask = (1 << SLOTS) - 1
        index = np.full(len(size), -1, np.int64)
        todo = np.flatnonzero(size <= SHORT_PIECE)
        for k in range(PROBES):
            s = self.slots[(slot[todo] + k) & mask] - 1
            hit = (s >= 0) & (self.low[s] == low[todo]) & (self.high[s] == high[todo]) & (self.size[s] == size[todo])
            index[todo[hit]] = s[hit]
            todo = todo[~hit]
        if len(todo):
            todo = todo[np.argsort(key[todo], kind="stable")]
            a, b = todo[1:], todo[:-1]
            new = np.concatenate(([True], (low[a] != low[b]) | (high[a] != high[b]) | (size[a] != size[b])))
            one = todo[new]
            first = self.append(*self.merges.merge(low[one], high[one], size[one]))
            index[todo] = first + np.cumsum(new) - 1
            own = slice(first, self.count)
            self.low[own], self.high[own], self.size[own] = low[one], high[one], size[one]
            number = index[one]
            for k in range(PROBES):
                at = (slot[one] + k) & mask
                free = self.slots[at] == 0
                self.slots[at[free]] = number[free] + 1
                left = self.slots[at] != number + 1
                one, number = one[left], number[left]
        long = np.flatnonzero(size > SHORT_PIECE)
        for i, a, b in zip(long.tolist(), cuts[long].tolist(), cuts[long + 1].tolist(), strict=True):
            piece = data[a:b]
            if piece not in self.known:
                ids = np.array(self.merge(piece), np.int32)  # by the library's compiled loop
                self.known[piece] = self.append(ids, np.array([len(ids)]))
            index[i] = self.known[piece]
        return index

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, where each text's ids begin (and the end), and the byte in its text at which each id begins."""
        sizes = np.array([len(t) for t in texts])
        if not sizes.sum():
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64)
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        data = joined.encode()
        at = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))) if len(data) > len(points) else np.arange(len(points) + 1)
        starts = piece_starts(symbols(points, np.unique(bounds[:-1][sizes > 0])))
        if self.count > CACHED:
            self.forget()
        index = self.numbers(data, at[np.append(starts, len(points))])
        ids, piece_at = gather(self.ids, self.ends, index)
        first = piece_at[np.searchsorted(starts, bounds)]
        lengths = self.offsets[ids + 1] - self.offsets[ids]
        begins = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        return ids, first, begins - at[bounds[owner]]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of ids, and where each id's bytes begin (and the end)."""
        out, begins = gather(self.bytes, self.offsets, ids)
        return out.tobytes(), begins


@cache
def codec(path: str) -> Codec:
    """One for each worker, with its cache."""
    return Codec(path)


def _runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of items that hold about CHUNK together; a longer item is a run of its own."""
    sums = np.concatenate(([0], np.cumsum(lengths)))
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(sums, sums[i] + CHUNK, "right")) - 1)
        yield i, j
        i = j


def _encode_long(c: Codec, text: str) -> tuple[np.ndarray, np.ndarray]:
    """ids and offsets of one long text, in parts that end where a space before a letter begins a piece."""
    ids, offsets, begin, byte = [], [], 0, 0
    while begin < len(text):
        end = begin + CHUNK
        while end < len(text) and not (text[end] == " " and text[end + 1 : end + 2].isalpha() and not text[end - 1].isspace()):
            end += 1
        part = text[begin:end]
        i, _, o = c.encode([part])
        ids.append(i)
        offsets.append(o + byte)
        begin, byte = end, byte + len(part.encode())
    return np.concatenate(ids), np.concatenate(offsets)


def encode(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids", offsets_col: str | None = "offsets") -> DataFrame:
    """docs with ids (array of int) and, for each id, the byte of the text at which it begins (array of long)."""
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(offsets_col, T.ArrayType(T.LongType()))] if offsets_col else [])
    kept = [f for f in docs.schema.fields if f.name not in {ids_col, offsets_col}]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            column = batch.column(at)
            sizes = np.array(pc.binary_length(column.fill_null("")))
            for i, j in _runs(sizes):
                rows = batch.slice(i, j - i)
                texts = rows.column(at).fill_null("").to_pylist()
                if len(texts) == 1 and len(texts[0]) > CHUNK:
                    ids, offsets = _encode_long(c, texts[0])
                    first = np.array([0, len(ids)])
                else:
                    ids, first, offsets = c.encode(texts)
                made = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x)) for x in ((ids, offsets) if offsets_col else (ids,))]
                yield pa.RecordBatch.from_arrays([rows[f.name] for f in kept] + made, names=[f.name for f in [*kept, *new]])
        c.forget()  # workers go on to other stages, whose memory this is then

    return map_arrow(docs.select(*docs.columns), run, T.StructType([*kept, *new]))


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """rows with the bytes that their ids stand for. Null ids decode to nothing."""
    kept = [f for f in rows.schema.fields if f.name != bytes_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            sizes = np.array(pc.list_value_length(batch[ids_col]).fill_null(0))
            for i, j in _runs(sizes):
                part = batch.slice(i, j - i)
                first = np.concatenate(([0], np.cumsum(sizes[i:j])))
                data, begins = c.decode(np.array(part[ids_col].flatten()))
                cuts = begins[first]
                made = pa.array([data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part[f.name] for f in kept] + [made], names=[f.name for f in kept] + [bytes_col])

    return map_arrow(rows, run, T.StructType([*kept, T.StructField(bytes_col, T.BinaryType())]))
