"""Token ids of whole text columns.

A byte-level tokenizer cuts a text into parts (a word with the space before it, a number, other
signs, white space) and encodes each part by itself. Here the parts of a block of texts are found
with numpy, the ids of a part are looked up by its hash, and only parts not met before go to the
tokenizer's model. The ids are those of encoding each text alone. Texts that hold one of the tokenizer's
added tokens (``<|endoftext|>``), which stand for one id each, are encoded by the tokenizer itself, unless
``added`` is false: then they are read as plain text.
"""

from __future__ import annotations

import functools
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tiltframe.llm.text import _powers, mix, text_bytes

#: Code points worked on at a time.
BLOCK = 1 << 20
#: Parts whose ids a worker keeps; beyond, it begins anew.
CACHE_PARTS = 300_000

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points with the White_Space property (fixed values).
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    table[list(WHITE)] = SPACE
    return table


@functools.cache
def _byte_signs() -> list[str]:
    """The printable sign by which the vocabulary writes each byte: itself if it is printable, else
    the next unused code point from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in printable else next(rest)) for b in range(256)]


def part_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the parts of concatenated texts start. ``begins`` are the starts of nonempty texts."""
    n = len(points)
    kind = _classes()[points]
    head = np.zeros(n + 1, bool)
    head[begins] = True
    head[n] = True
    space = kind == SPACE
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, kind[:-1]
    changed = (kind != before) | head[:-1]
    blank = np.zeros(n, bool)
    blank[1:] = points[:-1] == 32
    blank[begins] = False
    followed = np.zeros(n, bool)
    followed[:-1] = ~space[1:] & ~head[1:-1]
    start = (changed & ~(blank & ~space)) | (space & followed)
    start[begins] = True
    # An apostrophe not joined to a space, with the letters of a contraction after it.
    for i in np.flatnonzero((points == 39) & start).tolist():
        a = int(points[i + 1]) if i + 1 < n and not head[i + 1] else 0
        b = int(points[i + 2]) if a and i + 2 < n and not head[i + 2] else 0
        if a in (115, 116, 109, 100):
            size = 2
        elif (a, b) in ((114, 101), (118, 101), (108, 108)):
            size = 3
        else:
            continue
        start[i + 1 : i + size] = False
        if i + size < n:
            start[i + size] = True
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin: list[int] = []
        self.size: list[int] = []
        self.used = 0

    def _add(self, key: int, part: str) -> None:
        signs = _byte_signs()
        ids = [t.id for t in self.model.tokenize("".join([signs[b] for b in part.encode()]))]
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.known[key] = len(self.begin)
        self.begin.append(self.used)
        self.size.append(len(ids))
        self.used += len(ids)

    def _block(self, points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of nonempty concatenated texts, and the place in them where each text begins."""
        starts = part_starts(points, begins)
        ends = np.append(starts[1:], len(points))
        power, inverse = _powers(1 << max(12, int(len(points) - 1).bit_length()))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], out=total[1:])
        keys = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > CACHE_PARTS:
            self._clear()
        known = self.known
        slots = np.empty(len(unique), np.int64)
        for i, key in enumerate(unique.tolist()):
            slot = known.get(key)
            if slot is None:
                at = first[i]
                self._add(key, points[starts[at] : ends[at]].tobytes().decode("utf-32-le"))
                slot = known[key]
            slots[i] = slot
        begin = np.array([self.begin[s] for s in slots.tolist()], np.int64)[which]
        size = np.array([self.size[s] for s in slots.tolist()], np.int64)[which]
        after = np.cumsum(size)
        ids = self.ids[np.repeat(begin - after + size, size) + np.arange(after[-1])]
        heads = np.searchsorted(starts, begins)
        return ids, (after - size)[heads]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string column."""
        out = self._plain(column)
        for token in self.added:
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)).tolist():
                out[i] = np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out

    def _plain(self, column: pa.Array) -> list[np.ndarray]:
        data, offsets = text_bytes(column)
        out: list[np.ndarray] = []
        none = np.zeros(0, np.uint32)
        at = 0
        while at < len(offsets) - 1:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            raw = data[offsets[at] : offsets[end]]
            points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            chars = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
            places = chars[offsets[at : end + 1] - offsets[at]]
            full = places[:-1] < places[1:]
            if len(points):
                ids, heads = self._block(points, places[:-1][full])
                cuts = iter(np.split(ids, heads[1:]))
                out.extend(next(cuts) if f else none for f in full.tolist())
            else:
                out.extend([none] * (end - at))
            at = end
        return out


@functools.cache
def encoder(path: str, added: bool = False) -> Encoder:
    """The worker's encoder, kept from task to task."""
    return Encoder(path, added)
