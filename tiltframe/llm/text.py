"""Word hashes of whole texts, computed with numpy over the bytes of an Arrow column.

A word is a maximal run of bytes other than the ASCII white space ``\\x20 \\x09-\\x0D``; only A-Z
are lower-cased, so bytes of other letters never need decoding. All hashes are 64 bits wide, depend
on nothing but the word, and are the same in every process.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C55)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that are worked on at once, but for a single longer text.
SLICE = 1 << 21
#: Bytes hashed at a time; a longer run is only met where one document or one word is longer.
BLOCK = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finalizer)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return series(BASE), series(BASE_INVERSE)


def slices(batches: Iterable[pa.RecordBatch], text: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of record batches in pieces of about ``size`` bytes of the text column, which bounds
    what a worker makes of them."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the place where each text begins; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _plain_table() -> np.ndarray:
    """Every ASCII sign that is no letter or digit becomes a space."""
    return np.array([b if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


_PLAIN = _plain_table()


def _block_words(
    data: np.ndarray, begins: np.ndarray, prefixes: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Hash, start and prefix hashes of each word of a run of bytes; ``begins`` are places where a
    text begins."""
    solid = (data != 32) & ((data - np.uint8(9)) > 4)
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[begins] = False
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, [np.zeros(0, np.uint64) for _ in prefixes]
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[begins[begins > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    upper = (data - np.uint8(65)) < 26
    low = (data + (upper.view(np.uint8) << np.uint8(5))).astype(np.uint64) + np.uint64(1)
    size = 1 << max(12, int(len(data) - 1).bit_length())
    power, inverse = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(low * power[: len(data)], out=total[1:])

    def hashes(ends: np.ndarray) -> np.ndarray:
        raw = (total[ends] - total[starts]) * inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    heads = []
    for size in prefixes:
        head = hashes(np.minimum(starts + size, ends)) ^ np.uint64(size)
        head[ends - starts <= size] = 0
        heads.append(head)
    return hashes(ends), starts, heads


def word_hashes(column: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of a text column in order, and for each text the index of its first word
    (one more entry than texts). ``plain``: ASCII signs that are no letters or digits part words."""
    words, first, _ = word_features(column, (), plain)
    return words, first


def word_features(
    column: pa.Array, prefixes: tuple[int, ...], plain: bool = True
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``word_hashes``, and for each prefix length the hashes of the words' first bytes (0 where the
    word is no longer than that)."""
    data, offsets = text_bytes(column)
    hashes, places = [], []
    heads: list[list[np.ndarray]] = [[] for _ in prefixes]
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        low, high = offsets[at], offsets[end]
        if high > low:
            begins = np.unique(offsets[at:end] - low)
            block = _PLAIN[data[low:high]] if plain else data[low:high]
            h, s, p = _block_words(block, begins[begins < high - low], prefixes)
            hashes.append(h)
            places.append(s + low)
            for column_heads, own in zip(heads, p, strict=True):
                column_heads.append(own)
        at = end
    if not hashes:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(len(offsets), np.int64), [none for _ in prefixes]
    first = np.searchsorted(np.concatenate(places), offsets)
    return np.concatenate(hashes), first, [np.concatenate(h) for h in heads]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words, at the index of its first word; runs may cross texts."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * BASE + words[j : len(words) - k + 1 + j]
    return mix(out + np.uint64(k))


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; a text of fewer words has
    its whole sequence as the only one, a text without words none."""
    runs = window_hashes(words, k)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = window_hashes(words[a:b], b - a)
        else:
            s = np.zeros(0, np.uint64)
        sets.append(s)
    return sets
