"""Token ids as files: a static range asymmetric numeral system over independent interleaved blocks.

A table is dealt out by ranges of (id, text hash), so that files hold documents in ascending id order. Each task
tokenizes its range and writes segments. The blocks of a segment share one frequency table, are encoded
independently in LANES interleaved 64-bit states with 32-bit words, and hold checkpoints (all states and the
place in the stream, every MARK steps), from which decoding can start, and a checksum.

A segment is a row of a Parquet file that Spark's committer puts in place: a lost task is simply written again.
Layout of its payload, little-endian: magic, version, symbol count, byte count of the zipped table; the table
(symbols, frequencies); per block: tokens, lanes, words, checkpoints, crc32 of the ids, crc32 of the words and
states; states; checkpoints; words.

Defined results: null and empty texts have only the end id; an empty table gives files without segments; null ids
come first; rows that repeat an id are ordered by their text's hash; other columns play no part.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Codec, Merges, _encode_long, _runs
from .bpe import CHUNK as POINTS
from .common import shared_dir

MAGIC, VERSION = b"RANS", 1
#: Slots of a frequency table, as a power of two; a table has at most as many symbols.
BITS = 18
LANES, BLOCK, SEGMENT, MARK = 1024, 1 << 18, 1 << 21, 128
_LOW, _WORD = np.uint64(1 << 31), np.uint64(32)
_HEAD, _BLOCK = struct.Struct("<4sIII"), struct.Struct("<IIIIII")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Slots for each symbol: in proportion, at least one for each that occurs, 2 ** BITS in all."""
    total = int(counts.sum())
    slots = np.where(counts > 0, np.maximum(1, counts * (1 << BITS) // max(total, 1)), 0)
    order = np.argsort(-slots, kind="stable")
    spare = (1 << BITS) - int(slots.sum())
    if spare > 0:
        slots[order[0]] += spare
    while spare < 0:  # the ones given to rare symbols come from the frequent
        take = np.minimum(slots[order] - 1, np.maximum(1, slots[order] * -spare // (1 << BITS)))
        take = np.maximum(take, 0)
        take[np.cumsum(take) > -spare] = 0
        if not take.any():
            take[0] = min(-spare, slots[order[0]] - 1)
        slots[order] -= take
        spare += int(take.sum())
    return slots


def _tables(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return slots.astype(np.uint64), (np.cumsum(slots) - slots).astype(np.uint64)


def encode_block(ids: np.ndarray, f: np.ndarray, c: np.ndarray) -> bytes:
    """ids are indices into the table."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    grid = np.full(steps * lanes, int(np.argmax(f)), np.int64)
    grid[:n] = ids
    grid = grid.reshape(steps, lanes)
    freq, cum = f[grid], c[grid]
    limit = freq << np.uint64(63 - BITS)
    x = np.full(lanes, _LOW, np.uint64)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * steps
    marks: list[tuple[int, np.ndarray]] = []
    for i in range(steps - 1, -1, -1):
        over = x >= limit[i]
        out = x[over]
        words[i] = out.astype(np.uint32)
        x[over] = out >> _WORD
        q = x // freq[i]
        x = (q << np.uint64(BITS)) + (x - q * freq[i]) + cum[i]
        if i and i % MARK == 0:
            marks.append((i, x.copy()))
    at = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    marks.reverse()
    stream = np.concatenate(words).tobytes()
    saved = b"".join(struct.pack("<I", at[i]) + s.tobytes() for i, s in marks)
    body = x.tobytes() + saved + stream
    return _BLOCK.pack(n, lanes, len(stream) // 4, len(marks), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(data: memoryview, at: int, symbol: np.ndarray, f: np.ndarray, bias: np.ndarray, part: int | None = None) -> tuple[np.ndarray, int]:
    """The ids of the block at a place in data, or those from checkpoint part to the next one, and where the block ends.

    symbol: by slot; f, bias: by slot, the frequency and the slot's place in its symbol's range.
    """
    n, lanes, size, count, crc_ids, crc_body = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    end = at + lanes * 8 + count * (4 + lanes * 8) + size * 4
    if zlib.crc32(data[at:end]) != crc_body:
        raise ValueError("block is damaged")
    steps = -(-n // lanes)
    first, last, word, states = 0, steps, 0, at
    if part is not None:
        first, last = part * MARK, min(steps, (part + 1) * MARK)
        if part:
            states = at + lanes * 8 + (part - 1) * (4 + lanes * 8) + 4
            (word,) = struct.unpack_from("<I", data, states - 4)
    x = np.frombuffer(data, np.uint64, lanes, states).copy()
    words = np.frombuffer(data, np.uint32, size, end - size * 4)
    out = np.empty((last - first, lanes), symbol.dtype)
    mask = np.uint64((1 << BITS) - 1)
    for i in range(last - first):
        slot = (x & mask).astype(np.int64)
        out[i] = symbol[slot]
        x = f[slot] * (x >> np.uint64(BITS)) + bias[slot]
        under = np.flatnonzero(x < _LOW)
        x[under] = (x[under] << _WORD) | words[word : word + len(under)]
        word += len(under)
    ids = out.ravel()[: n - first * lanes]
    if part is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("ids don't match their checksum")
    return ids, end


def encode_segment(ids: np.ndarray) -> bytes:
    counts = np.bincount(ids)
    present = np.flatnonzero(counts)
    if len(present) > 1 << BITS:
        raise ValueError("more symbols than slots")
    slots = frequencies(counts[present])
    f, c = _tables(slots)
    table = zlib.compress(present.astype("<u4").tobytes() + slots.astype("<u4").tobytes(), 1)
    index = np.zeros(len(counts), np.int64)
    index[present] = np.arange(len(present))
    local = index[ids]
    return b"".join([_HEAD.pack(MAGIC, VERSION, len(present), len(table)), table, *[encode_block(local[i : i + BLOCK], f, c) for i in range(0, len(ids), BLOCK)]])


def decode_segment(payload: bytes) -> np.ndarray:
    data = memoryview(payload)
    magic, version, count, size = _HEAD.unpack_from(data, 0)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment")
    table = np.frombuffer(zlib.decompress(data[_HEAD.size : _HEAD.size + size]), "<u4")
    present, slots = table[:count], table[count:].astype(np.int64)
    symbol = np.repeat(np.arange(count, dtype=np.int32), slots)
    f, c = _tables(slots)
    by_slot, bias = f[symbol], np.arange(1 << BITS, dtype=np.uint64) - c[symbol]
    at, out = _HEAD.size + size, []
    while at < len(data):
        ids, at = decode_block(data, at, symbol, by_slot, bias)
        out.append(ids)
    return present[np.concatenate(out)].astype(np.uint32)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class LibraryCodec(Codec):
    """The vocabulary and merges of a file of the tokenizers library, which itself merges long pieces and encodes texts with added tokens."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model, letters = self.tokenizer.model, _byte_letters()
        ids = self.tokenizer.get_vocab(with_added_tokens=False)
        with open(path, encoding="utf-8") as f:
            pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in json.load(f)["model"]["merges"]]
        left, right, made = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3).T
        self.merges = Merges(np.array([ids[letters[b]] for b in range(256)]), left, right, np.arange(len(pairs)), made)
        self.merge = lambda piece: [t.id for t in model.tokenize(piece.decode("latin-1").translate(letters))]
        self.offsets = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def encode_texts(self, texts: list[str], encode_special_tokens: bool) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts and where each text's ids begin (and the end). Texts with a literal added token go through the library as a whole, unless such tokens are encoded like other text."""
        whole = {} if encode_special_tokens else {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for i, t in enumerate(texts) if any(a in t for a in self.added)}
        if len(texts) == 1 and len(texts[0]) > POINTS:
            ids = whole[0] if whole else _encode_long(self, texts[0])[0]
            return ids, np.array([0, len(ids)])
        ids, first, _ = self.encode(["" if i in whole else t for i, t in enumerate(texts)])
        if whole:
            parts = [whole[i] if i in whole else ids[first[i] : first[i + 1]] for i in range(len(texts))]
            ids, first = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, first


@cache
def library_codec(path: str) -> LibraryCodec:
    return LibraryCodec(path)


def write(docs: DataFrame, path: str, out: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, encode_special_tokens: bool = False) -> None:
    """Encodes docs by the tokenizer file at path, an end id behind each, and writes segments to the folder out.

    encode_special_tokens is the library's setting: whether a literal added token is text like any other (by the library's default it is its id).
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).repartitionByRange(n, F.col("doc").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("doc").asc_nulls_first(), F.xxhash64("t"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("tokens", T.LongType()), T.StructField("within", T.LongType()), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        c = library_codec(path)
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        total = seq = within = 0

        def segment() -> pa.RecordBatch:
            payload = encode_segment(np.concatenate(held))
            lengths = np.concatenate(sizes)
            docs_ = pa.concat_arrays(names)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), x) for x in (docs_, pa.array(lengths, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *lists, pa.array([total], pa.int64()), pa.array([within], pa.int64()), pa.array([payload], pa.binary())], names=schema.names)

        for batch in batches:
            for i, j in _runs(np.array(pc.binary_length(batch["t"].fill_null("")))):
                texts = batch["t"].slice(i, j - i).fill_null("").to_pylist()
                ids, first = c.encode_texts(texts, encode_special_tokens)
                lengths = np.diff(first)
                held.append(np.insert(ids, first[1:], end_id))
                names.append(batch["doc"].slice(i, j - i))
                sizes.append(lengths + 1)
                total += int(lengths.sum()) + len(lengths)
                if total >= SEGMENT:
                    yield segment()
                    held, names, sizes, total, seq, within = [], [], [], 0, seq + 1, within + total
        if total:
            yield segment()

    rows.mapInArrow(run, schema).write.option("compression", "none").parquet(out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc, start (ids of all documents before it), ids: what the files of a folder hold."""
    return _decoded(spark, out, T.StructField("ids", T.ArrayType(T.LongType())), lambda ids, cuts: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))


def checksums(spark: SparkSession, out: str) -> DataFrame:
    """doc, start, n_tokens, ids_crc32: read from the files of a folder."""
    def crc(ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        data = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64())

    return _decoded(spark, out, T.StructField("ids_crc32", T.LongType()), crc)


def _decoded(spark: SparkSession, out: str, field: T.StructField, value) -> DataFrame:
    files = spark.read.parquet(out)
    # where each task's ids begin: one row for each task that wrote, not for each segment
    by_part = files.groupBy("part").agg(F.sum("tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rows = files.join(F.broadcast(by_part), "part").select((F.col("before") + F.col("within")).alias("base"), "docs", "sizes", "payload")
    schema = T.StructType([T.StructField("doc", files.schema["docs"].dataType.elementType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), field])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1)
                sizes = np.array(row["sizes"].flatten())
                ids = decode_segment(row["payload"][0].as_py())
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([row["docs"].flatten(), pa.array(cuts[:-1] + row["base"][0].as_py()), pa.array(sizes), value(ids, cuts)], names=schema.names)

    return rows.mapInArrow(run, schema)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
