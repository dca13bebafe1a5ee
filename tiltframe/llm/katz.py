"""Katz backoff scores of documents by n-grams, ``ORDER`` tokens long at most.

Counts of n-grams of every order k (a history of k - 1 tokens, and a token) are taken from the training
documents; before a text stand as many starts as its first histories need. With ``K``, counts r up to K
are discounted by Good-Turing, larger ones keep all but a 1 / (N + 2) share, so that every history leaves
some mass. H is a history of k - 1 tokens, H' is H without its oldest token:

    P(t | H) = d_k(r) r / c(H)             if r = c(H, t) > 0
             = alpha(H) P(t | H')          else, if c(H) > 0
             = P(t | H')                   else
    P(t)     = d_1(r) r / N                if r = c(t) > 0
             = 1 - sum of all those        else: the mass of all unknown tokens together
    alpha(H) = (1 - sum_seen P(t | H)) / (1 - sum_seen P(t | H'))

so the probabilities of all known tokens and of "unknown" add up to 1 after every history. Where the
counts of counts n(1) to n(K + 1) give a discount outside (0, 1), they are smoothed as in Simple
Good-Turing, by a line fitted to their logarithms, which gives proper Good-Turing discounts as long as
they fall faster than 1 / r. Only where they do not, or fewer than three of them are there to fit,
absolute discounting by n1 / (n1 + 2 n2) stands in. The log says which was used.

How it runs. Texts are read once: a piece of the documents (a chunk) becomes the list of its words and the
places of its tokens in this list, in a table. The words of all chunks meet by their hash, are counted and
numbered, frequent ones with small numbers, and each chunk gets the numbers of its words. It sends every position
with its history, packed into arrays of numbers, to the bucket of its token, one share of the buckets after the
other (``ROUNDS``); positions of a frequent token (there are at most ``HEAVY``) are spread by the token before.
The number of buckets follows the number of positions; only a pair of tokens that makes up more than a bucket
outgrows it. A bucket holds all of each of its n-grams of every order. It leaves, in a table partitioned by kind,

* ``doc``: for each position of each document the counts of its n-grams, and of its token if that is all;
* ``history``: the n-grams of each order with their counts, for the block of their history;
* ``top``: how many pairs of which count follow a frequent token, a few numbers for the driver;
* ``miss``: the histories of the positions whose longest n-gram was never seen, for the same blocks;
* ``part``: what a chunk knows of its documents by itself.

Chunks are deleted once they are counted. A block is that of the last token of a history; histories that end in
a frequent token are spread by the token before it. Counts of counts of all buckets give the discounts; a block
works out c(H) and alpha(H) of its histories, order by order, writes them to a table (``weight``) and answers
its misses; and all that concerns the documents of a chunk is summed up. Positions are never joined one by one with a table.

Words, ``history`` and ``weight`` are the model. ``words``, ``counts`` and ``weights`` read them as rows, and
``score_stored`` scores any other text with them, by joins and the recursion above.

Null or empty text is one end token. Rows without an id are training rows. Rows that repeat an id and a
text are counted and returned each. Without training tokens every probability is 1. An empty table gives
no rows. Further columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiltframe.llm.packed import pack, small, steps, unpack
from tiltframe.llm.text import SLICE, mix, slices, word_hashes
from tiltframe.session import drop_table, new_table_path, short_lived_shuffles

log = logging.getLogger(__name__)

#: Counts that are discounted.
K = 5
#: Tokens of the longest n-gram.
ORDER = 3
HEAVY = 1024
BUCKET_TOKENS = 1_500_000
CHUNK_TOKENS = 1_000_000
#: Bytes of text, by which words are spread before they are counted.
WORD_BYTES = 64 << 20
#: Rounds in which the buckets are counted, so that no more than their share of the positions is under way.
ROUNDS = 2
#: The numbers of the start and of the end; words have larger ones.
START, END, FIRST = 0, 1, 2
NO_ID = -(1 << 63)
#: Numbers per frequent history: its pairs by count, and what follows it by count.
TOP = 2 * K + 2
_FEW = K + 2


def held_out(doc_id) -> F.Column:
    """If a document is not trained on: the checksum of its id as text leaves 2 when divided by 7."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(7)) == 2


def _rows(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"),
        (~held_out(doc_id)).cast("int").alias("train"),
        text.alias("text"),
    )


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key that occurs, with the places where it does."""
    order = np.argsort(small(keys), kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return ((int(keys[own[0]]), own) for own in np.split(order, cuts[1:]) if len(own))


def _is_in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would be, and if it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _chain(past: list[np.ndarray]) -> list[np.ndarray]:
    """The histories of one token, two tokens and so on; ``past``: the last token, the one before, .."""
    out = [past[0].astype(np.uint64)]
    for older in past[1:]:
        out.append(mix(mix(older.astype(np.uint64)) + out[-1]))
    return out


def _chunks(rows: DataFrame, blocks: int) -> DataFrame:
    """(kind, chunk, block, data, totals): the tokens of each chunk as places in its list of words, and
    for each block of words this list with the counts in training texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        n, held, waiting = 0, 0, []
        for batch in slices(batches, 2):
            words, first = word_hashes(batch.column(2))
            waiting.append((words, np.diff(first), *(batch.column(i).to_numpy() for i in range(2))))
            held += len(words) + len(first) - 1
            if held >= CHUNK_TOKENS:
                yield _listed((part << 32) | n, *(np.concatenate(c) for c in zip(*waiting, strict=True)), blocks)
                n, held, waiting = n + 1, 0, []
        if held:
            yield _listed((part << 32) | n, *(np.concatenate(c) for c in zip(*waiting, strict=True)), blocks)

    return rows.select("doc", "train", "text").mapInArrow(
        cut, "kind string, chunk long, block int, data binary, totals array<long>"
    )


def _listed(chunk: int, words: np.ndarray, sizes: np.ndarray, ids: np.ndarray, learned: np.ndarray, blocks: int) -> pa.RecordBatch:
    unique, place = np.unique(words, return_inverse=True)
    block = _bucket(mix(unique), blocks)
    by_block = np.argsort(block, kind="stable")
    moved = np.empty(len(unique), np.int64)
    moved[by_block] = np.arange(len(unique))
    place = moved[place]
    count = np.bincount(place, np.repeat(learned, sizes), len(unique)).astype(np.int64)
    all_count = np.bincount(place, minlength=len(unique))
    totals = [int(sizes.sum()) + len(sizes), int(learned.sum()), int((sizes * learned).sum())]
    rows = [("stream", chunk, 0, pack(small(place), small(sizes), ids, learned.astype(np.uint8)), totals)]
    for b, own in _groups(block[by_block]) if len(block) else ():
        rows.append(("words", chunk, b, pack(steps(unique[by_block[own]]), small(count[own]), small(all_count[own])), None))
    return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=_CHUNK.names), _CHUNK, preserve_index=False)


_CHUNK = pa.schema(
    [("kind", pa.string()), ("chunk", pa.int64()), ("block", pa.int32()), ("data", pa.binary()), ("totals", pa.list_(pa.int64()))]
)


def _numbered(block: int, chunks: list[int], data: list[bytes], blocks: int, total: int) -> list[tuple]:
    """The words of a block with their numbers and counts, and the numbers for each chunk."""
    found = [unpack(d) for d in data]
    every = [np.cumsum(f[0]) for f in found]
    known, at = np.unique(np.concatenate(every), return_inverse=True)
    count, all_count = (np.bincount(at, np.concatenate([f[j] for f in found])).astype(np.int64) for j in (1, 2))
    rank = np.empty(len(known), np.int64)
    rank[np.lexsort((known, -all_count))] = np.arange(len(known))
    number = FIRST + rank * blocks + block
    rows = [("word", 0, block, pack(steps(known), small(number), small(count)), None, None)]
    begin = 0
    for chunk, words in zip(chunks, every, strict=True):
        own = at[begin : begin + len(words)]
        begin += len(words)
        rows.append(("number", chunk, block, pack(small(number[own]), small(count[own])), None, None))
    often = all_count * HEAVY > total
    rows.append(("heavy", 0, block, b"", number[often].tolist(), all_count[often].tolist()))
    rows.append(
        ("totals", 0, block, b"", list(range(1, K + 3)), [int((count > 0).sum()), *(int((count == r).sum()) for r in range(1, K + 2))])
    )
    return rows


def _past(token: np.ndarray, begins: np.ndarray, order: int) -> list[np.ndarray]:
    """The tokens before each token, the last one first."""
    past = [token]
    for _ in range(order - 1):
        before = np.empty_like(token)
        before[1:] = past[-1][:-1]
        before[begins] = START
        past.append(before)
    return past[1:]


def _sent(chunk: int, stream: bytes, numbers: bytes, ends: int, heavy: np.ndarray, buckets: int, order: int, turn: int):
    """Rows of (bucket, data) for the positions of a chunk that are due in a round, and in the first one
    (-1, data) for what concerns its documents."""
    place, sizes, ids, train = unpack(stream)
    number, count = unpack(numbers)
    sizes = sizes.astype(np.int64) + 1
    last = np.cumsum(sizes) - 1
    inner = np.ones(int(last[-1]) + 1, bool)
    inner[last] = False
    token, ones = np.full(len(inner), END, np.uint64), np.full(len(inner), ends, np.int64)
    if len(place):
        token[inner], ones[inner] = number[place], count[place]
    doc = small(np.repeat(np.arange(len(sizes)), sizes))
    ones = small(ones)
    past = _past(small(token), last - sizes + 1, order)
    out = []
    mark = np.array([chunk])
    if turn == 0:
        known, base = np.bincount(doc, ones > 0), np.bincount(doc, np.log10(ones.astype(float) + 1))
        follow = [np.bincount(doc, np.log10(np.maximum(ones, 1.0)))] if order == 2 else []
        out.append((-1, pack(mark, ids, small(sizes), small(known), base, *follow)))
    keys = mix(token)
    hot = np.flatnonzero(_is_in(heavy, token)[1])
    keys[hot] = mix(keys[hot] ^ past[0][hot].astype(np.uint64))
    bucket = _bucket(keys, buckets)
    del keys
    due = np.flatnonzero(bucket % ROUNDS == turn)
    for b, own in _groups(bucket[due]) if len(due) else ():
        own = due[own]
        own = own[np.lexsort((past[0][own], token[own]))]
        tokens, head, n = np.unique(token[own], return_index=True, return_counts=True)
        docs, at = np.unique(doc[own], return_inverse=True)
        values = (steps(tokens), small(n), small(ones[own[head]]), *(small(p[own]) for p in past), small(at))
        out.append((b, pack(mark, *values, small(steps(docs)), train[docs])))
    return out


def _history_block(past: list[np.ndarray], top: np.ndarray, n: int, other: np.ndarray | None = None) -> np.ndarray:
    """The block of a history: that of its last token, or of its last two (else of ``other``) after a frequent one."""
    keys = mix(past[0].astype(np.uint64))
    hot = np.flatnonzero(_is_in(top, past[0])[1])
    if len(hot):
        keys[hot] = mix(keys[hot] ^ mix((past[1] if len(past) > 1 else other)[hot].astype(np.uint64)))
    return _bucket(keys, n)


def _counted(data: list[bytes], top: np.ndarray, blocks: int, order: int):
    """What one bucket leaves: rows of (kind, block, data, tokens, at, totals)."""
    tokens, ones, pasts, docs, ids, chunks, trains = [], [], [], [], [], [], []
    base = 0
    for blob in data:
        chunk, t, n, one, *past, place, i, train = unpack(blob)
        tokens.append(small(np.repeat(np.cumsum(t), n)))
        ones.append(np.repeat(one, n))
        pasts.append(past)
        docs.append(place.astype(np.int64) + base)
        ids.append(np.cumsum(i))
        chunks.append(np.repeat(chunk, len(i)))
        trains.append(train)
        base += len(i)
    token, doc = np.concatenate(tokens), np.concatenate(docs)
    past = [np.concatenate([p[j] for p in pasts]) for j in range(order - 1)]
    counts = [np.concatenate(ones)]
    del tokens, ones, docs, pasts, data
    ids, chunks, trains = np.concatenate(ids), np.concatenate(chunks), np.concatenate(trains)
    learned = trains[doc] == 1

    rows: list[tuple] = []
    totals: list[int] = []
    for k, history in enumerate(_chain(past), 2):
        key = mix(mix(history) + token.astype(np.uint64))
        by_key = np.argsort(key)
        starts = np.flatnonzero(np.concatenate(([True], np.diff(key[by_key]) != 0)))
        grams = np.add.reduceat(learned[by_key].astype(np.int64), starts)
        grams = small(grams)
        each = np.empty(len(token), grams.dtype)
        each[by_key] = np.repeat(grams, np.diff(np.append(starts, len(token))))
        heads = by_key[starts[grams > 0]]
        counts.append(each)
        del key, by_key, starts, each
        totals += [int((grams == r).sum()) for r in range(1, K + 2)]
        rows += _histories(k, token[heads], [p[heads] for p in past[: k - 1]], counts[-1][heads], counts[-2][heads], top, blocks)
    rows.append(("totals", 0, b"", None, list(range(len(totals))), totals))

    # Documents: the counts of each of their positions here, ends first. Those of a chunk follow each other.
    by_doc = np.lexsort((token != END, doc))
    each = [c[by_doc] for c in counts]
    sizes, ends = np.bincount(doc, minlength=base), np.bincount(doc, token == END, base).astype(np.int64)
    stops = np.append(0, np.cumsum(sizes))
    cuts = [*np.flatnonzero(np.diff(chunks, prepend=-1)), base]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        values = [c[stops[low] : stops[high]] for c in each]
        values = (small(values[0][values[1] == 0]), *(small(c) for c in values[1:]))
        head = (small(np.diff(ids[low:high], prepend=0)), small(sizes[low:high]), small(ends[low:high]))
        rows.append(("doc", int(chunks[low]), pack(*head, *values), None, None, None))
    # Misses, with the order at which something was seen.
    missed = np.flatnonzero(counts[-1] == 0)
    if len(missed):
        found = np.ones(len(missed), np.int64)
        for k in range(2, order):
            found[counts[k - 1][missed] > 0] = k
        lost = [p[missed] for p in past]
        for b, own in _groups(_history_block(lost, top, blocks, doc[missed])):
            docs_, place = np.unique(doc[missed[own]], return_inverse=True)
            values = (*(small(p[own]) for p in lost), small(found[own]), small(place), chunks[docs_], small(ids[docs_]))
            rows.append(("miss", b, pack(*values), None, None, None))
    return rows


def _histories(
    k: int, token: np.ndarray, past: list[np.ndarray], grams: np.ndarray, lower: np.ndarray, top: np.ndarray, blocks: int
) -> list[tuple]:
    """The n-grams of order k with the counts of themselves and without their oldest token."""
    rows = []
    if k == 2:
        at, hot = _is_in(top, past[0])
        at, of, follow = at[hot], grams[hot].astype(np.int64), lower[hot].astype(np.int64)
        sums = np.zeros((len(top), TOP), np.int64)
        np.add.at(sums, (at, np.minimum(of, K + 1) - 1), np.where(of > K, of, 1))
        np.add.at(sums, (at, np.minimum(follow, K + 1) + K), np.where(follow > K, follow, 1))
        some = np.flatnonzero(sums)
        rows.append(("top", 0, b"", None, some.tolist(), sums.ravel()[some].tolist()))
    for b, own in _groups(_history_block(past, top, blocks, token)) if len(token) else ():
        own = own[np.lexsort([p[own] for p in past[::-1]])]
        values = (small(past[0][own]), *(small(p[own]) for p in past[1:]), small(grams[own]), small(lower[own]))
        first = np.concatenate((values[0][:1], np.diff(values[0])))
        rows.append(("history", b, pack(np.array([k], np.uint8), small(first), *values[1:]), pack(small(token[own])), None, None))
    return rows


def _good_turing(counts: np.ndarray) -> np.ndarray | None:
    """Good-Turing d(r) for r = 1 to K, or None if one of them lies outside (0, 1)."""
    r = np.arange(1, K + 1)
    if not (counts > 0).all():
        return None
    common = (K + 1) * counts[K] / counts[0]
    if common >= 1:
        return None
    d = ((r + 1) * counts[1:] / (r * counts[:-1]) - common) / (1 - common)
    return d if ((d > 0) & (d < 1)).all() else None


def _smoothed(counts: np.ndarray) -> np.ndarray | None:
    """The counts of counts on a line fitted to their logarithms, each first spread over the gap of
    zeros around it; None if there are fewer than three."""
    r = np.flatnonzero(counts) + 1
    if len(r) < 3:
        return None
    below, above = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - r[-2])
    slope, level = np.polyfit(np.log(r), np.log(2 * counts[r - 1] / (above - below)), 1)
    return np.exp(level + slope * np.log(np.arange(1, K + 2)))


def chosen_discounts(n: list[int]) -> tuple[str, np.ndarray]:
    """The kind of discount and d(r) for r = 1 to K from the counts of counts n(1) to n(K + 1)."""
    counts = np.array(n, float)
    if (d := _good_turing(counts)) is not None:
        return "Good-Turing", d
    smooth = _smoothed(counts)
    if smooth is not None and (d := _good_turing(smooth)) is not None:
        return "Good-Turing, smoothed", d
    r = np.arange(1, K + 1)
    total = counts[0] + 2 * counts[1]
    return "absolute", (r - min(0.95, max(0.05, counts[0] / total if total else 0.5))) / r


def discounts(n: list[int]) -> np.ndarray:
    """d(r) for r = 1 to K from the counts of counts n(1) to n(K + 1)."""
    return chosen_discounts(n)[1]


class Model:
    """The numbers that all documents share: N, the number of words, the discounts of every order, and
    c(h) and alpha(h) of the frequent tokens as histories."""

    def __init__(self, totals: list[int], order: int, ends: int, top: np.ndarray, sums: np.ndarray):
        self.order, self.ends, self.tokens, self.words, self.top = order, ends, totals[0], totals[1], top
        self.keep = 1 - 1 / (self.tokens + 2)
        self.kept = np.ones((order, K + 2))
        for k in range(order):
            kind, d = chosen_discounts(totals[2 + k * (K + 1) : 2 + (k + 1) * (K + 1)])
            log.info("discounts of order %s: %s %s", k + 1, kind, d)
            self.kept[k, 1:] = [*d, self.keep]
        n1 = np.array(totals[2 : 2 + K]) * np.arange(1, K + 1)
        mass = float(n1 @ self.kept[0, 1 : K + 1]) + self.keep * (self.tokens - int(n1.sum()))
        self.unknown = 1 - mass / self.tokens if self.tokens else 1.0
        r = np.append(np.arange(1, K + 1), 1)
        pairs, follow = sums[:, : K + 1] * r, sums[:, K + 1 :] * r
        n = pairs.sum(1)
        left = pairs @ (1 - self.kept[1, 1:])
        rest = self.tokens - follow.sum(1) + follow @ (1 - self.kept[0, 1:])
        self.top_count, self.top_alpha = self._weights(n, left, rest, self.tokens)

    @staticmethod
    def _weights(n, left, rest, lower) -> tuple[np.ndarray, np.ndarray]:
        """log10 of c(H) and of alpha(H), 0 for a history that was never seen. What is left is added up
        from the discounts, not taken as a small difference."""
        seen = n > 0
        n, left, rest = (np.where(seen, a, 1.0) for a in (n, left, rest))
        return np.log10(n), np.where(seen, np.log10(left / n) - np.log10(rest / np.where(seen, lower, 1.0)), 0.0)

    def lost(self, k: int, r: np.ndarray) -> np.ndarray:
        """What discounting takes from counts r of order k."""
        return (1 - self.kept[k - 1, np.minimum(r, K + 1)]) * r

    def histories(self, data: list[bytes]):
        """For each order from 2: the histories of a block, sorted, log10 c(H) and log10 alpha(H); and what
        is stored of them."""
        found = [unpack(d) for d in data]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stored: list[tuple[int, bytes]] = []
        for k in range(2, self.order + 1):
            own = [f for f in found if f[0][0] == k]
            if not own:
                out.append((np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)))
                continue
            past = _read_past(own, k)
            grams, lower = (np.concatenate([f[j].astype(np.int64) for f in own]) for j in (-2, -1))
            if k == 2:  # those after frequent tokens are summed up by the driver
                rare = ~_is_in(self.top, past[0])[1]
                past, grams, lower = [past[0][rare]], grams[rare], lower[rare]
            chain = _chain(past)
            histories, one, of = np.unique(chain[-1], return_index=True, return_inverse=True)
            m = len(histories)
            if k == 2:
                below: np.ndarray | int = self.tokens
            else:
                below = np.rint(10.0 ** self.look(out, k - 1, chain[-2][one], past[0][one])[0])
            n = np.bincount(of, grams, m)
            rest = below - np.bincount(of, lower, m) + np.bincount(of, self.lost(k - 1, lower), m)
            log_n, alpha = self._weights(n, np.bincount(of, self.lost(k, grams), m), rest, below)
            out.append((histories, log_n, alpha))
            if m:
                stored.append((k, packed_weights([p[one] for p in past], n.astype(np.int64), alpha)))
        return out, stored

    def look(self, known, k: int, history: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 c(H) and log10 alpha(H), 0 where H was never seen."""
        at, hit = _is_in(known[k - 2][0], history)
        n, alpha = (np.where(hit, a[at], 0.0) if len(a) else np.zeros(len(at)) for a in known[k - 2][1:])
        if k == 2:
            at, hot = _is_in(self.top, last)
            n, alpha = np.where(hot, self.top_count[at], n), np.where(hot, self.top_alpha[at], alpha)
        return n, alpha

    def missing(self, known, past: list[np.ndarray], found: np.ndarray) -> np.ndarray:
        """What histories add to the logarithms of ``seen`` for positions whose longest n-gram is unknown."""
        out = np.zeros(len(found))
        for k, history in enumerate(_chain(past), 2):
            n, alpha = self.look(known, k, history, past[0])
            out += np.where(found < k, alpha, 0.0) - np.where(found == k, n, 0.0)
            if k == self.order:
                out += n
        return out

    def seen(self, counts: list[np.ndarray], end: np.ndarray) -> np.ndarray:
        """log10 of d(r) r of the longest n-gram that was seen, less log10 c(H) of the longest history. ``counts``:
        of the tokens whose pair was never seen, then of all pairs and so on."""
        log_kept = np.log10(self.kept)
        r, level = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
        r[counts[1] == 0] = counts[0]
        for k in range(1, self.order):
            hit = counts[k] > 0
            r, level = np.where(hit, counts[k], r), np.where(hit, k, level)
        out = log_kept[level, np.minimum(r, K + 1)] + np.log10(np.maximum(r, 1))
        out -= np.where((level == 0) & (r > 0), np.log10(max(1, self.tokens)), 0.0)
        out = np.where(r > 0, out, np.log10(self.unknown))
        # The longest history of a token is the next shorter n-gram of the token before; that of a first
        # token, all starts, occurs as often as the end. Of pairs it is a token, which the chunks have summed up.
        if self.order > 2:
            out -= np.log10(np.maximum(np.where(end, max(1, self.ends), counts[self.order - 2]), 1))
        return out


def packed_weights(past: list[np.ndarray], n: np.ndarray, alpha: np.ndarray) -> bytes:
    """Histories by their tokens, their counts, and places in a list of the different weights."""
    sort = np.lexsort(past[::-1])
    values, place = np.unique(alpha[sort], return_inverse=True)
    last = past[0][sort].astype(np.int64)
    return pack(values, small(place), small(n[sort]), small(np.diff(last, prepend=0)), *(small(p[sort]) for p in past[1:]))


def _read_past(found: list[list[np.ndarray]], k: int) -> list[np.ndarray]:
    return [np.concatenate([np.cumsum(f[1], dtype=np.uint64) if not j else f[1 + j] for f in found]) for j in range(k - 1)]


def _totals(stage: DataFrame, kind: str) -> dict[int, int]:
    rows = stage.where(F.col("kind") == kind).select(F.explode(F.arrays_zip("at", "totals")).alias("z"))
    return {r.at: r.n for r in rows.groupBy(F.col("z.at").alias("at")).agg(F.sum("z.totals").alias("n")).collect()}


def score(docs: DataFrame, order: int = ORDER, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model is left in tables below ``path`` (a fresh place in the shared folder, if None).
    """
    if order < 2:
        raise ValueError("a backoff model needs an order of 2 at least")
    spark = docs.sparkSession
    path = path or new_table_path(spark, "katz")
    rows = _rows(docs)
    blocks = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // WORD_BYTES)
    _chunks(rows, blocks).write.partitionBy("kind").parquet(f"{path}/chunks")
    chunks = _read(spark, f"{path}/chunks", "chunk long, block int, data binary, totals array<long>")
    found = chunks.where("kind = 'stream'").select(F.posexplode("totals").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    found = {r.at: r.n for r in found.collect()}
    total, ends, inner = (found.get(i, 0) for i in range(3))
    buckets = max(1, -(-total // BUCKET_TOKENS))

    def number(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        left = _numbered(int(key[0]), own["chunk"].tolist(), own["data"].tolist(), blocks, total)
        return pd.DataFrame(left, columns=["kind", "chunk", "block", "data", "at", "totals"])

    schema = "kind string, chunk long, block int, data binary, at array<long>, totals array<long>"
    words_ = chunks.where("kind = 'words'").select("chunk", "block", "data")
    with short_lived_shuffles(spark):
        words_.groupBy("block").applyInPandas(number, schema).write.partitionBy("kind").parquet(f"{path}/words")
    drop_table(spark, f"{path}/chunks/kind=words")
    numbered = _read(spark, f"{path}/words", "chunk long, block int, data binary, at array<long>, totals array<long>")
    first_order = _totals(numbered, "totals")
    totals = [inner + ends] + [first_order.get(i, 0) for i in range(1, K + 3)]
    if ends:
        totals[1] += 1
        if ends <= K + 1:
            totals[1 + ends] += 1
    heavy = np.array(sorted([END, *_totals(numbered, "heavy")]), np.uint64)
    top = np.append(np.uint64(START), heavy)

    def code(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        (stream,) = own["data"][own["kind"] == "stream"]
        chosen = own[own["kind"] == "number"].sort_values("block")
        found = [unpack(d) for d in chosen["data"]] or [[np.zeros(0, np.uint8)] * 2]
        number, count = (small(np.concatenate([f[j].astype(np.int64) for f in found])) for j in range(2))
        return pd.DataFrame({"chunk": [key[0]], "stream": [stream], "numbers": [pack(number, count)]})

    pieces = chunks.where("kind = 'stream'").select("kind", "chunk", "block", "data")
    pieces = pieces.unionByName(numbered.where("kind = 'number'").select("kind", "chunk", "block", "data"))
    coded = "chunk long, stream binary, numbers binary"
    with short_lived_shuffles(spark):
        pieces.groupBy("chunk").applyInPandas(code, coded).write.parquet(f"{path}/coded")
    drop_table(spark, f"{path}/chunks")
    drop_table(spark, f"{path}/words/kind=number")

    def sender(turn: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    out = _sent(row["chunk"], row["stream"], row["numbers"], ends, heavy, buckets, order, turn)
                    own, data = zip(*out, strict=True) if out else ((), ())
                    yield pa.record_batch([pa.array(own, pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])

        return send

    def count(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            left = [("part", int(unpack(d)[0][0]), d, None, None, None) for d in own["data"]]
        else:
            left = _counted(own["data"].tolist(), top, buckets, order)
        return pd.DataFrame(left, columns=["kind", "block", "data", "tokens", "at", "totals"])

    schema = "block long, data binary, tokens binary, at array<long>, totals array<long>"
    for turn in range(ROUNDS):
        sent = spark.read.schema(coded).parquet(f"{path}/coded").mapInArrow(sender(turn), "bucket int, data binary")
        counted = sent.groupBy("bucket").applyInPandas(count, f"kind string, {schema}")
        with short_lived_shuffles(spark):
            counted.write.mode("append").partitionBy("kind").parquet(f"{path}/counted")
    drop_table(spark, f"{path}/coded")
    stage = _read(spark, f"{path}/counted", schema)
    found = _totals(stage, "totals")
    totals += [found.get(i, 0) for i in range((order - 1) * (K + 1))]
    sums = np.zeros(len(top) * TOP)
    for at, n in _totals(stage, "top").items():
        sums[at] = n
    model = Model(totals, order, ends, top, sums.reshape(len(top), TOP))

    def meet(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        known, stored = model.histories(own["data"][own["kind"] == "history"].tolist())
        out: list[tuple] = [("weight", k, w) for k, w in stored]
        answers = []
        for data in own["data"][own["kind"] == "miss"]:
            *past, found, place, chunks_, ids = unpack(data)
            answers.append((chunks_, ids.astype(np.int64), np.bincount(place, model.missing(known, past, found), len(ids))))
        if answers:
            chunks_, ids, more = (np.concatenate(c) for c in zip(*answers, strict=True))
            names, at = np.unique(chunks_, return_inverse=True)
            for c, those in _groups(at):
                docs_, place = np.unique(ids[those], return_inverse=True)
                out.append(("more", int(names[c]), pack(small(docs_), np.bincount(place, more[those]))))
        return pd.DataFrame(out, columns=["kind", "block", "data"])

    both = stage.where("kind IN ('history', 'miss')").select("kind", "block", "data")
    met = both.groupBy("block").applyInPandas(meet, "kind string, block long, data binary")
    frequent = model.top_count > 0
    first = packed_weights([top[frequent]], np.rint(10 ** model.top_count[frequent]).astype(np.int64), model.top_alpha[frequent])
    met = met.unionByName(spark.createDataFrame([("weight", 2, first)], "kind string, block long, data binary"))
    with short_lived_shuffles(spark):
        met.write.partitionBy("kind").parquet(f"{path}/weighted")
    spark.createDataFrame(
        [(order, ends, model.tokens, model.words, float(model.unknown), model.kept.ravel().tolist())], _NUMBERS
    ).write.parquet(f"{path}/numbers")
    more = _read(spark, f"{path}/weighted", "block long, data binary").where("kind = 'more'")

    def finish(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        (part,) = own["data"][own["kind"] == "part"]
        _, ids, tokens, known, base, *follow = unpack(part)
        m = len(ids)
        values = -follow[0] if follow else np.zeros(m)
        for data in own["data"][own["kind"] == "doc"]:
            docs_, sizes, ends_, *counts_ = unpack(data)
            sizes = sizes.astype(np.int64)
            place = np.repeat(np.cumsum(docs_, dtype=np.int64), sizes)
            end = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(ends_, sizes)
            values += np.bincount(place, model.seen([c.astype(np.int64) for c in counts_], end), m)
        for data in own["data"][own["kind"] == "more"]:
            docs_, more_ = unpack(data)
            values += np.bincount(docs_, more_, m)
        return pd.DataFrame(
            {
                "doc": ids,
                "n_tokens": tokens.astype(np.int64),
                "n_known": known.astype(np.int64),
                "base_score": base - tokens * np.log10(model.tokens + model.words + 1.0),
                "score": values,
            }
        )

    parts = stage.where("kind IN ('doc', 'part')").select("kind", "block", "data").unionByName(more.select("kind", "block", "data"))
    done = parts.groupBy("block").applyInPandas(
        finish, "doc long, n_tokens long, n_known long, base_score double, score double"
    )
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return done.select(
        doc_id.alias("doc_id"),
        held_out(doc_id).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


_NUMBERS = "order int, ends long, tokens long, words long, unknown double, kept array<double>"


def _read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(f"{columns}, kind string").parquet(path)


def words(spark: SparkSession, path: str) -> DataFrame:
    """(word, token, n): the hash, the number and the count of each word that was trained on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                known, number, n = (a.astype(np.int64) for a in unpack(data))
                columns = (c[n > 0] for c in (np.cumsum(known.view(np.uint64)).view(np.int64), number, n))
                yield pa.record_batch([pa.array(c) for c in columns], ["word", "token", "n"])

    stored = _read(spark, f"{path}/words", "data binary").where("kind = 'word'").select("data")
    return stored.mapInArrow(rows, "word long, token long, n long")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(order, history, token, n): the stored n-grams of two and more tokens, by a number that stands for
    the history and the number of the token."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, (token,) = unpack(data), unpack(tokens)
                k, n = int(found[0][0]), found[-2].astype(np.int64)
                history = _chain(_read_past([found], k))[-1].view(np.int64)
                columns = (np.full(len(n), k, np.int32), history, token.astype(np.int64), n)
                yield pa.record_batch([pa.array(c) for c in columns], ["order", "history", "token", "n"])

    stored = _read(spark, f"{path}/counted", "data binary, tokens binary").where("kind = 'history'").select("data", "tokens")
    return stored.mapInArrow(rows, "order int, history long, token long, n long")


def weights(spark: SparkSession, path: str) -> DataFrame:
    """(order, history, log_count, log_alpha): the stored weights of the histories of each order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values, place, n, *past = unpack(data)
                history = _chain([np.cumsum(past[0], dtype=np.uint64), *past[1:]])[-1]
                columns = (np.full(len(n), k, np.int32), history.view(np.int64), np.log10(n.astype(float)), values[place])
                yield pa.record_batch([pa.array(c) for c in columns], ["order", "history", "log_count", "log_alpha"])

    stored = _read(spark, f"{path}/weighted", "block long, data binary").where("kind = 'weight'").select("block", "data")
    return stored.mapInArrow(rows, "order int, history long, log_count double, log_alpha double")


def score_stored(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score): any documents scored by the model stored below ``path``.

    Every position meets the counts and the weights of its n-grams by joins. Rows that repeat an id and
    a text are scored once.
    """
    spark = docs.sparkSession
    (numbers,) = spark.read.schema(_NUMBERS).parquet(f"{path}/numbers").collect()
    order = numbers.order
    hashes = [f"h{k}" for k in range(2, order + 1)]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE):
            found, first = word_hashes(batch.column(2))
            ids, prints = (batch.column(i).to_numpy() for i in range(2))
            sizes = np.diff(first)
            at = np.arange(len(found)) - np.repeat(first[:-1] - first[0], sizes)
            # The place after the last word is that of the end, which has no hash.
            columns = (
                np.concatenate((np.repeat(ids, sizes), ids)), np.concatenate((np.repeat(prints, sizes), prints)),
                np.concatenate((at, sizes)),
            )
            end = np.arange(len(found) + len(ids)) >= len(found)
            word = pa.array(np.concatenate((found, np.zeros(len(ids), np.uint64))).view(np.int64), mask=end)
            yield pa.record_batch([*(pa.array(c) for c in columns), word], ["doc", "print", "at", "word"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            past = [batch.column(4 + j).to_numpy().view(np.uint64) for j in range(order - 1)]
            chain = [pa.array(h.view(np.int64)) for h in _chain(past)]
            yield pa.record_batch([*(batch.column(i) for i in range(4)), *chain], ["doc", "print", "token", "n1", *hashes])

    rows = _rows(docs).select("doc", F.xxhash64("text").alias("print"), "text").distinct().mapInArrow(listed, "doc long, print long, at long, word long")
    rows = rows.join(words(spark, path).withColumnRenamed("n", "n1"), "word", "left")
    is_end = F.col("word").isNull()
    token = F.when(is_end, F.lit(END)).otherwise(F.coalesce("token", F.lit(-1))).cast("long")
    rows = rows.select("doc", "print", "at", token.alias("token"), F.when(is_end, F.lit(numbers.ends)).otherwise(F.col("n1")).alias("n1"))
    before = Window.partitionBy("doc", "print").orderBy("at")
    past = [F.lag("token", j, START).over(before).alias(f"p{j}") for j in range(1, order)]
    rows = rows.select("doc", "print", "token", "n1", *past)
    rows = rows.mapInArrow(hashed, ", ".join(f"{n} long" for n in ["doc", "print", "token", "n1", *hashes]))
    every, weight = counts(spark, path), weights(spark, path)
    for k in range(2, order + 1):
        own = every.where(F.col("order") == k).select(F.col("history").alias(f"h{k}"), "token", F.col("n").alias(f"n{k}"))
        rows = rows.join(own, [f"h{k}", "token"], "left")
        own = weight.where(F.col("order") == k)
        own = own.select(F.col("history").alias(f"h{k}"), F.col("log_count").alias(f"c{k}"), F.col("log_alpha").alias(f"a{k}"))
        rows = rows.join(own, f"h{k}", "left")

    def kept(k: int) -> F.Column:
        table = F.array(*(F.lit(x) for x in numbers.kept[(k - 1) * _FEW : k * _FEW]))
        return F.log10(F.get(table, F.least(F.col(f"n{k}"), F.lit(K + 1)).cast("int")) * F.col(f"n{k}"))

    log_p = F.when(F.col("n1") > 0, kept(1) - F.log10(F.lit(float(max(1, numbers.tokens)))))
    log_p = log_p.otherwise(F.log10(F.lit(numbers.unknown)))
    for k in range(2, order + 1):
        backed_off = F.coalesce(F.col(f"a{k}"), F.lit(0.0)) + log_p
        log_p = F.when(F.col(f"n{k}") > 0, kept(k) - F.col(f"c{k}")).otherwise(backed_off)
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc"))
    sums = rows.groupBy("doc", "print").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(log_p).alias("score"))
    return sums.select(doc_id.alias("doc_id"), "n_tokens", "score")
