"""Periodic runs of words: stretches that repeat themselves at least four times.

A run is a stretch of consecutive words with smallest period q, at least ``max(6, 4 q)`` words long, that
no neighbouring word extends. Words are numbered from 0 within their text and compared byte by byte.

Method, over the words of many texts at once, each followed by a separator of its own:

1. *Harmonic grid.* In a run of period q, three grid points k q in a row have equal words q apart. For
   each q up to a quarter of a text, the grid has n / q points, so all q have n log n together. Points
   that fail this are no part of a run; texts without any other point are done.
2. *Longest common extensions.* From the places that remain, the agreement of a text with itself q words
   later is extended to both sides. Suffixes are sorted only where their place modulo ``COVER`` is in a
   difference cover: for any two places there is a shift, of fewer than ``COVER`` words, that brings both
   to sorted ones. So a few words are compared, and the rest is a minimum over the common prefixes of
   neighbours in the sorted order, which a sparse table answers in two lookups. The same over the
   reversed words extends to the left.
3. Stretches that several periods or points have found are one run, of the smallest period.

A slice of texts is worked on at a time, at most about ``SLICE`` bytes or one longer text; memory is in
proportion to that. Nothing is shuffled. A null or empty text, or one of white space, has no words and no
runs; equal texts have equal runs, row by row. An empty table gives no rows. Other columns are carried
along, but for those that have the names of new columns.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tiltframe.llm.text import SLICE, slices

#: Sampled places modulo COVER; all differences modulo COVER occur among them. Fixed values (the
#: difference set of the projective plane of order 5).
COVER = 31
SAMPLED = np.array([1, 5, 11, 24, 25, 27])
#: Grid points looked at together.
POINTS = 1 << 20
#: A run has this many words, and this many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4


@functools.cache
def shifts() -> np.ndarray:
    """For two places modulo COVER, the least shift that brings both to sampled places."""
    sampled = np.zeros(COVER, bool)
    sampled[SAMPLED] = True
    at = np.arange(COVER)
    both = sampled[(at[:, None, None] + at) % COVER] & sampled[(at[None, :, None] + at) % COVER]
    return both.argmax(2)


class Extensions:
    """Longest common extensions of the suffixes of a word sequence, whose last word occurs only once."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate((words.astype(np.int64), np.zeros(COVER, np.int64)))
        residues = np.zeros(COVER, bool)
        residues[SAMPLED] = True
        places = np.flatnonzero(residues[np.arange(n) % COVER])
        self.number = np.full(n + COVER, -1, np.int32)  # of a sampled place, among sampled places
        self.number[places] = np.arange(len(places))
        after = self.number[np.minimum(places + COVER, n)]
        # Ranks by the first COVER words, then by twice as many places each time.
        rank = self._first_ranks(places)
        levels, jumps = [rank], [after]
        while len(rank) and rank.max() + 1 < len(rank):
            then = np.where(jumps[-1] >= 0, rank[jumps[-1]] + 1, 0)
            rank = _ranks([rank.astype(np.int64) * (len(rank) + 2) + then])
            levels.append(rank)
            jumps.append(np.where(jumps[-1] >= 0, jumps[-1][jumps[-1]], -1))
        self.rank = rank
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        common = self._neighbours(places, order, levels, jumps)
        self.table = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _first_ranks(self, places: np.ndarray) -> np.ndarray:
        bits = max(1, int(self.words.max(initial=0)).bit_length())
        in_one = max(1, 63 // bits)
        keys = []
        for at in range(0, COVER, in_one):
            key = np.zeros(len(places), np.int64)
            for t in range(at, min(at + in_one, COVER)):
                key = (key << bits) | self.words[places + t]
            keys.append(key)
        return _ranks(keys)

    def _neighbours(self, places, order, levels, jumps) -> np.ndarray:
        """The number of words that each sampled suffix has in common with the next in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        live = np.ones(len(a), bool)  # suffixes that have not ended
        for level in range(len(levels) - 1, -1, -1):
            same = live & (levels[level][a] == levels[level][b])
            common[same] += COVER << level
            to_a, to_b = jumps[level][a], jumps[level][b]
            live &= ~same | ((to_a >= 0) & (to_b >= 0))
            a, b = np.where(same & (to_a >= 0), to_a, a), np.where(same & (to_b >= 0), to_b, b)
        rest = np.flatnonzero(live)
        common[rest] += self._compared(places[a[rest]], places[b[rest]], np.full(len(rest), COVER))
        return common.astype(np.int32)

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from the places i and j on, ``most`` at most, by comparing them."""
        out = np.zeros(len(i), np.int64)
        live = np.arange(len(i))
        for t in range(int(most.max(initial=0))):
            live = live[most[live] > t]
            live = live[self.words[i[live] + t] == self.words[j[live] + t]]
            out[live] += 1
            if not len(live):
                break
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of equal words from the different places i and j on."""
        shift = shifts()[i % COVER, j % COVER]
        out = self._compared(i, j, shift)
        on = np.flatnonzero(out == shift)
        a, b = self.rank[self.number[i[on] + shift[on]]], self.rank[self.number[j[on] + shift[on]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        more = np.zeros(len(on), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            more[own] = np.minimum(self.table[k][low[own]], self.table[k][high[own] - (1 << k)])
        out[on] += more
        return out


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """The rank of each row of keys, from 0; equal rows have one."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new)
    return out


def grid(words: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place and period of the grid points at which a run may be."""
    most = lengths // LEAST_PERIODS
    text = np.repeat(np.arange(len(lengths)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    # The places k q to (k + LEAST_PERIODS - 1) q are within the text.
    points = (lengths[text] - 1) // period - LEAST_PERIODS + 2
    ends = np.cumsum(points)
    for at in range(0, int(ends[-1]) if len(ends) else 0, POINTS):
        numbers = np.arange(at, min(at + POINTS, int(ends[-1])))
        pair = np.searchsorted(ends, numbers, "right")
        q = period[pair]
        place = first[text[pair]] + (numbers - (ends - points)[pair]) * q
        for step in range(LEAST_PERIODS - 1):
            same = words[place + step * q] == words[place + (step + 1) * q]
            pair, place, q = pair[same], place[same], q[same]
        yield text[pair], place, q


def find_runs(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of all runs of texts, whose words (numbers from 1) follow each
    other; sorted by text, start and period."""
    first = np.cumsum(lengths) - lengths
    with_points = np.zeros(len(lengths), bool)
    for text, _, _ in grid(words, first, lengths):
        with_points[text] = True
    texts = np.flatnonzero(with_points)
    if not len(texts):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    lengths = lengths[texts]
    # The chosen texts, each between two separators that occur once.
    own = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1] + 1
    total = int(lengths.sum()) + len(lengths) + 1
    joined = np.zeros(total, np.int64)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined[np.repeat(own, lengths) + inside] = words[np.repeat(first[texts], lengths) + inside]
    gaps = np.concatenate(([0], own + lengths))
    joined[gaps] = int(words.max()) + 1 + np.arange(len(gaps))
    right, left = Extensions(joined), Extensions(joined[::-1])
    found = np.zeros((0, 4), np.int64)
    for text, place, q in grid(joined, own, lengths):
        after = right.common(place, place + q)
        before = left.common(total - place, total - place - q)
        size = before + after + q
        enough = size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        new = np.stack((text, place - before - own[text], size, q), axis=1)[enough]
        found = np.concatenate((found, new))
        # A stretch is one run, that of its smallest period.
        found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:, :3] != found[:-1, :3]).any(1)
        found = found[fresh]
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    return texts[found[:, 0]], found[:, 1], found[:, 2], found[:, 3]


RUN = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))


def with_runs(docs: DataFrame) -> DataFrame:
    """The rows with n_words, runs (by start, then period) and collapsed: the words joined by single
    spaces, but of each run only what no run holds after its first period."""
    new = ["n_words", "runs", "collapsed"]
    kept = docs.select(*(F.col(f"`{c}`").cast("string") if c == "text" else f"`{c}`" for c in docs.columns if c not in new))
    at = kept.columns.index("text")
    kinds = StructType([*kept.schema.fields]).add("n_words", "long").add("runs", RUN).add("collapsed", "string")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, SLICE):
            texts = [(t or b"").split() for t in batch.column(at).cast(pa.binary()).to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            flat = np.empty(int(lengths.sum()), object)
            flat[:] = [w for t in texts for w in t]
            words = pd.factorize(flat)[0].astype(np.int64) + 1
            text, start, length, period = find_runs(words, lengths)
            ends = np.cumsum(lengths)
            # A word is dropped where more runs' repetitions have begun than ended.
            marks = np.zeros(len(flat) + 1, np.int64)
            np.add.at(marks, ends[text] - lengths[text] + start + period, 1)
            np.add.at(marks, ends[text] - lengths[text] + start + length, -1)
            keep = np.cumsum(marks)[:-1] == 0
            texts = [b" ".join(flat[b - n : b][keep[b - n : b]]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            offsets = np.searchsorted(text, np.arange(len(lengths) + 1)).astype(np.int32)
            fields = [pa.array(c, pa.int64()) for c in (start, length, period)]
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            found = [pa.array(lengths), runs, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.record_batch([*batch.columns, *found], [*batch.schema.names, *new])

    return kept.mapInArrow(searched, kinds)
