"""Sets of word shingles as 64-bit hashes, computed for whole Arrow batches of texts at once.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. The hash of a word is a chain of mixed
eight-byte lanes, taken from the text in place, so that no word is ever cut out as a string; words of up to eight
bytes and equal length never share a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are hashed in one go; what is held at once is a small multiple of it, for texts of any length.
CHUNK = 1 << 19
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first 0 to 8 bytes of a lane.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words in data, and where each begins; begins: where texts begin, as words don't run on."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[begins] = True
    before = np.concatenate(([False], inner[:-1])) & ~cut[:n]
    starts = np.flatnonzero(inner & ~before)
    after = np.concatenate((inner[1:], [False])) & ~cut[1:]
    ends = np.flatnonzero(inner & ~after) + 1
    lower = np.zeros(n + 8, np.uint8)
    lower[:n] = _LOWER[data]
    lanes = np.ndarray((n,), "<u8", buffer=lower, strides=(1,))  # eight bytes from every place on
    left = ends - starts
    hashes = mix(left.astype(np.uint64) * _P)
    long = np.flatnonzero(left > LONG_WORD)
    some, at = slice(None), starts
    while len(at):
        hashes[some] = mix(hashes[some] * _P + (lanes[at] & _KEEP[np.minimum(left, 8)]))
        more = np.flatnonzero((left > 8) & (left <= LONG_WORD))
        some = more if isinstance(some, slice) else some[more]
        at, left = at[more] + 8, left[more] - 8
    for k in long.tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(lower[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return hashes, starts


def _long_text(data: np.ndarray) -> np.ndarray:
    """The word hashes of one long text, in windows that end at white space."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data):
            gap = np.flatnonzero(_SPACE[data[at:end]])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(len(data), end + CHUNK)
        found.append(word_hashes(data[at:end], np.array([0]))[0])
        at = end
    return np.concatenate(found)


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts with counts words each, and the text each belongs to."""
    first = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(counts)), counts)
    hashes, owners = [], []
    for k in range(1, width + 1):  # texts of fewer words than width are one shingle of all their words
        if k == width:
            at = np.flatnonzero(np.arange(len(words)) + k <= first[owner + 1])
        else:
            at = first[:-1][counts == k]
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = mix(h * _P + words[at + j])
        hashes.append(h)
        owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of texts: the number of the first, and the sorted distinct shingle hashes of each. Null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        part, begins = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(part) > CHUNK:
            words = _long_text(part)
            counts = np.array([len(words)])
        else:
            words, starts = word_hashes(part, begins)
            counts = np.diff(np.searchsorted(starts, begins))
        hashes, owners = shingles(words, counts, width)
        if width > 1:
            order = np.argsort(owners, kind="stable")
            hashes, owners = hashes[order], owners[order]
        bounds = np.searchsorted(owners, np.arange(j - i + 1))
        yield i, [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        i = j
