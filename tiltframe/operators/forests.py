"""Random forests of all folds, grown together level by level over stored blocks of bin numbers.

A pass over the blocks counts, for every node of a level of every tree, the classes in each bin; the counts
of a tree meet in one place, where its best splits are found, and only these reach the driver. A row carries
no state from level to level: its node is looked up from its bins.

A tree learns from each row as often as a Poisson number says that hangs on the row and the tree alone, so
the forests do not depend on where rows lie. Splits, random features of a node and the merging of leaves
that call the same class are those of Spark's forests.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltframe.session import drop_table, new_table_path

#: Rows of a block.
ROWS = 1 << 16
#: Levels that are looked up at once, as bits of one number.
AT_ONCE = 6
#: Combinations of the bins of features that share one table.
CODES = 4096
#: Bytes of counts and tables that a task holds for the trees of one pass.
BUDGET = 128 << 20
#: Deeper trees would outgrow their arrays, which have a place for every possible node.
DEEPEST = 12
NO_CUT = 255
_SPLIT = np.dtype([("feature", "<i2"), ("cut", "u1"), ("all", "<f8", 2), ("left", "<f8", 2)])


def _groups(bins: Sequence[int]) -> list[list[int]]:
    """Features in groups whose bins have at most ``CODES`` combinations."""
    out, size = [], CODES + 1
    for f, n in enumerate(bins):
        if size * n > CODES:
            out.append([])
            size = 1
        out[-1].append(f)
        size *= n
    return out


def _codes(cells: np.ndarray, bins: Sequence[int]) -> list[np.ndarray]:
    out = []
    for group in _groups(bins):
        code = cells[group[0]].astype(np.intp)
        for f in group[1:]:
            code = code * bins[f] + cells[f]
        out.append(code)
    return out


class Trees:
    """Splits of trees, one row of ``feature`` and ``cut`` per tree. Node 2^l - 1 + p is the p-th of level l,
    its children are the 2p-th and the one after it of the next level; bins up to the cut go left. At a node
    without split, ``cut`` is ``NO_CUT`` and everything goes left."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, bins: Sequence[int], level: int):
        self.feature, self.cut, self.bins, self.level = feature, cut, list(bins), level
        self.tables = None

    def _tables(self) -> list[np.ndarray]:
        """For each group of features and each tree: which nodes, as bits, the codes of the group leave open."""
        levels, trees = min(self.level, AT_ONCE), np.arange(len(self.feature))
        every = (1 << (1 << levels)) - 1
        values = np.arange(max(self.bins))
        open_ = np.full((len(trees), len(self.bins), len(values)), every, np.uint64)
        for level in range(levels):
            wide = 1 << (levels - level - 1)
            for p in range(1 << level):
                node, side = (1 << level) - 1 + p, ((1 << wide) - 1) << (2 * wide * p)
                right = values > self.cut[:, node, None]
                keeps = np.where(right, np.uint64(every & ~side), np.uint64(every & ~(side << wide)))
                open_[trees, self.feature[:, node]] &= keeps
        out = []
        for group in _groups(self.bins):
            table = open_[:, group[0], : self.bins[group[0]]]
            for f in group[1:]:
                table = (table[:, :, None] & open_[:, f, None, : self.bins[f]]).reshape(len(trees), -1)
            out.append(np.ascontiguousarray(table))
        return out

    def places(self, tree: int, codes: list[np.ndarray], cells: np.ndarray | None, at: np.ndarray | None, stride: int):
        """The node of each row at ``level``: from the codes of its groups and, below the first levels, its
        bins, feature by feature in ``cells``, where ``at`` is its place."""
        if self.tables is None:
            self.tables = self._tables()
        left = self.tables[0][tree].take(codes[0], mode="wrap")
        for table, code in zip(self.tables[1:], codes[1:], strict=True):
            left &= table[tree].take(code, mode="wrap")
        # One bit is left, and a power of two has its exponent there.
        place = (left.astype(np.float64).view(np.int64) >> 52) - 1023
        for level in range(AT_ONCE, self.level):
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            start = self.feature[tree, nodes].astype(np.intp) * stride
            found = start.take(place, mode="wrap")
            found += at
            right = cells.take(found, mode="wrap") > self.cut[tree, nodes].take(place, mode="wrap")
            place += place
            place += right
        return place


class BinnedForest:
    """The mean of the trees' shares of class 1, for a batch of features."""

    def __init__(self, trees: Trees, values: np.ndarray, edges: Sequence[Sequence[float]]):
        self.trees, self.values, self.edges = trees, values, [np.asarray(e, np.float64) for e in edges]

    def __call__(self, batch: pd.DataFrame) -> np.ndarray:
        cells = binned(batch.to_numpy(np.float64).T, self.edges)
        n, total = cells.shape[1], np.zeros(cells.shape[1])
        if n == 0:
            return total
        codes, flat, at = _codes(cells, self.trees.bins), cells.ravel(), np.arange(n)
        for tree, values in enumerate(self.values):
            total += values.take(self.trees.places(tree, codes, flat, at, n), mode="wrap")
        return total / len(self.values)


def binned(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """How many edges are not above each value; NaN is above all."""
    cells = [np.searchsorted(e, x, side="right").astype(np.uint8) for x, e in zip(columns, edges, strict=True)]
    return np.stack(cells)


def _packed(edges: Sequence[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (features, label, fold, key) to blocks of one fold each: bins and label as bytes, and keys."""

    def block(fold: int, rows: pa.Table) -> pa.RecordBatch:
        columns = [c.to_numpy() for c in rows.columns]
        cells = np.concatenate((binned(columns[:-3], edges), columns[-3][None].astype(np.uint8)))
        values = [pa.array([fold], pa.int32()), pa.array([cells.tobytes()]), pa.array([columns[-1].tobytes()])]
        return pa.record_batch(values, ["fold", "cells", "keys"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            folds = batch.column(batch.num_columns - 2).to_numpy()
            for fold in np.unique(folds).tolist():
                held = waiting.setdefault(fold, [])
                held.append(batch.filter(pa.array(folds == fold)))
                if sum(b.num_rows for b in held) >= ROWS:
                    rows = pa.Table.from_batches(held)
                    yield block(fold, rows.slice(0, ROWS))
                    waiting[fold] = rows.slice(ROWS).to_batches()
        for fold, held in waiting.items():
            if sum(b.num_rows for b in held):
                yield block(fold, pa.Table.from_batches(held))

    return pack


def _often() -> list[np.uint32]:
    """From which 32-bit numbers on a row counts 1, 2, ... times: a Poisson number of mean 1."""
    out, share, total = [], math.exp(-1), 0.0
    for k in range(1, 20):
        total += share
        share /= k
        if round(total * 2**32) < 2**32:
            out.append(np.uint32(round(total * 2**32)))
    return out


OFTEN = _often()


def draws(low: np.ndarray, high: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often the tree learns from each row, by the halves of its key."""
    one, two = np.random.SeedSequence([seed, tree]).generate_state(2, np.uint32)
    z = high * (two | np.uint32(1))
    z += low ^ one
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        z ^= z >> np.uint32(shift)
        z *= np.uint32(factor)
    z ^= z >> np.uint32(16)
    out = np.zeros(len(z), np.uint8)
    for least in OFTEN:
        out += z >= least
    return out


def _chosen(seed: int, tree: int, fold: int, level: int, features: int, k: int) -> np.ndarray:
    """The random features of each node of a level, ``k`` a node."""
    rng = np.random.default_rng([seed, tree, fold, level])
    return np.sort(rng.random((1 << level, features)).argsort(1)[:, :k], axis=1)


def _wide(bins: Sequence[int]) -> int:
    """Places for the bins of each feature, so many that there is one to cut at."""
    return max(2, *bins)


def _counting(some: Trees, models: np.ndarray, seed: int, k: int):
    """A function of blocks: for each of the models (tree, fold) the counts by slot (a feature, or one of
    each node's random ones if these are far fewer), node, class and bin. Indices are right by their making;
    they are taken with "wrap" as this is the quickest check."""
    bins, level = some.bins, some.level
    wide, nodes, every = _wide(bins), 1 << level, len(bins) <= 2 * k
    slots = len(bins) if every else k
    by_tree: dict[int, list[tuple[int, int]]] = {}
    for m, (tree, fold) in enumerate(models.tolist()):
        by_tree.setdefault(tree, []).append((fold, m))

    def add(held: int, cells: np.ndarray, keys: np.ndarray, sums: np.ndarray, picks) -> None:
        codes, side = _codes(cells[:-1], bins), cells[-1] * np.uint8(wide)
        low, high = keys[::2].copy(), keys[1::2].copy()
        spots = cells[:-1] + side if every else None
        for tree, own in by_tree.items():
            own = [(fold, m) for fold, m in own if fold != held]
            if not own:
                continue
            often = draws(low, high, seed, tree)
            picked = np.flatnonzero(often != 0)
            n, weights = len(picked), often.take(picked, mode="wrap").astype(np.float64)
            mine = [c.take(picked, mode="wrap") for c in codes]
            marks = [s.take(picked, mode="wrap") for s in spots] if every else side.take(picked, mode="wrap")
            flat, at, spot = None, None, np.empty(n, np.intp)
            if level > AT_ONCE or not every:
                flat, at = np.concatenate([x.take(picked, mode="wrap") for x in cells[:-1]]), np.arange(n)
            for _, m in own:
                node = some.places(m, mine, flat, at, n)
                base = node * (2 * wide)
                for slot in range(slots):
                    if every:
                        np.add(base, marks[slot], out=spot)
                    else:
                        start = picks[m][:, slot].astype(np.intp) * n
                        np.add(base, marks + flat.take(start.take(node, mode="wrap") + at, mode="wrap"), out=spot)
                    sums[m, slot] += np.bincount(spot, weights, nodes * 2 * wide)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(models), slots, nodes * 2 * wide))
        picks = None if every else [_chosen(seed, int(t), int(h), level, len(bins), k) for t, h in models]
        for batch in batches:
            for held, cells, keys in zip(batch["fold"], batch["cells"], batch["keys"], strict=True):
                keys = np.frombuffer(keys.as_buffer(), np.uint32)
                cells = np.frombuffer(cells.as_buffer(), np.uint8).reshape(len(bins) + 1, -1)
                add(held.as_py(), cells, keys, sums, picks)
        for m, found in enumerate(sums):
            small = found.astype(np.uint16 if found.max() < 1 << 16 else np.uint32)
            yield pa.record_batch([pa.array([m], pa.int32()), pa.array([small.tobytes()])], ["model", "counts"])

    return counted


def _gini(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and Gini impurity of counts whose first place is the class."""
    n = counts.sum(0)
    share = np.divide(counts, n, out=np.zeros_like(counts), where=n > 0)
    return n, 1 - (share**2).sum(0)


def best_splits(counts: np.ndarray, chosen: np.ndarray, every: bool) -> np.ndarray:
    """The best split of each node from its counts (slot, node, class, bin); without one, the cut is
    ``NO_CUT``. ``chosen`` are the random features of the nodes."""
    slots, nodes = counts.shape[:2]
    out = np.zeros(nodes, _SPLIT)
    left = counts.cumsum(3)
    total = left[0, :, :, -1]
    left = np.moveaxis(left[..., :-1], 2, 0)
    right = total.T[:, None, :, None] - left
    n, impurity = _gini(total.T)
    n_left, of_left = _gini(left)
    n_right, of_right = _gini(right)
    share = np.divide(n_left, n[None, :, None], out=np.zeros_like(n_left), where=n[None, :, None] > 0)
    gain = impurity[None, :, None] - share * of_left - (1 - share) * of_right
    gain[(n_left < 1) | (n_right < 1)] = -1
    if every:
        allowed = np.zeros((nodes, slots), bool)
        np.put_along_axis(allowed, chosen, True, 1)
        gain[~allowed.T] = -1
    gain = np.moveaxis(gain, 0, 1).reshape(nodes, -1)
    best, at = gain.argmax(1), np.arange(nodes)
    slot, cut = np.divmod(best, counts.shape[3] - 1)
    found = gain[at, best] > 0
    out["feature"] = np.where(found, slot if every else chosen[at, slot], 0)
    out["cut"] = np.where(found, cut, NO_CUT)
    out["all"], out["left"] = total, left[:, slot, at, cut].T
    return out


def _level(blocks: DataFrame, trees: Trees, models: np.ndarray, seed: int, k: int) -> dict[int, np.ndarray]:
    """The best splits of the nodes of a level, by model."""
    level, wide, features = trees.level, _wide(trees.bins), len(trees.bins)
    every = features <= 2 * k

    def met(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        m = key[0].as_py()
        total = 0
        for counts in table["counts"]:
            found = np.frombuffer(counts.as_buffer(), np.uint8)
            size = (features if every else k) * (1 << level) * 2 * wide
            total = total + found.view(np.uint16 if len(found) == 2 * size else np.uint32).astype(np.float64)
        tree, held = (int(v) for v in models[m])
        chosen = _chosen(seed, tree, held, level, features, k)
        splits = best_splits(total.reshape(-1, 1 << level, 2, wide), chosen, every)
        return pa.table({"model": pa.array([m], pa.int32()), "splits": pa.array([splits.tobytes()])})

    counted = blocks.mapInArrow(_counting(trees, models, seed, k), "model int, counts binary")
    found = counted.groupBy("model").applyInArrow(met, "model int, splits binary").collect()
    return {r["model"]: np.frombuffer(r["splits"], _SPLIT) for r in found}


def _bytes(bins: Sequence[int], level: int, k: int) -> int:
    """What a task holds for one tree."""
    slots = len(bins) if len(bins) <= 2 * k else k
    codes = sum(math.prod(bins[f] for f in group) for group in _groups(bins))
    return 8 * slots * 2 * _wide(bins) * (1 << level) + 8 * (codes + len(bins) * _wide(bins))


def grow(
    blocks: DataFrame, bins: Sequence[int], folds: int, trees: int, depth: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, cut and the classes' counts of all nodes of all models, fold by fold; the trees of a fold
    learn from the rows outside of it. Each node splits by one of the root of the number of features."""
    k = math.ceil(math.sqrt(len(bins)))
    models = np.array([(t, held) for held in range(folds) for t in range(trees)])
    inner = (1 << depth) - 1
    feature = np.zeros((len(models), inner), np.int16)
    cut = np.full((len(models), inner), NO_CUT, np.uint8)
    counts = np.zeros((len(models), 2 * inner + 1, 2))
    open_ = np.ones((len(models), 1), bool)
    by_tree = models[:, 0].argsort(kind="stable")
    for level in range(depth):
        here = slice((1 << level) - 1, (2 << level) - 1)
        live = [m for m in by_tree if open_[m].any()]
        some = max(1, BUDGET // _bytes(bins, level, k))
        for first in range(0, len(live), some):
            part = np.array(live[first : first + some])
            state = Trees(feature[part, : here.start], cut[part, : here.start], bins, level)
            for i, splits in _level(blocks, state, models[part], seed, k).items():
                m = part[i]
                has = open_[m] & (splits["cut"] != NO_CUT)
                feature[m, here], cut[m, here] = np.where(has, splits["feature"], 0), np.where(has, splits["cut"], NO_CUT)
                counts[m, here] = splits["all"]
                below = np.stack((splits["left"], splits["all"] - splits["left"]), 1)
                counts[m, here.stop : 2 * here.stop + 1] = below.reshape(-1, 2)
        open_ = np.repeat(cut[:, here] != NO_CUT, 2, axis=1)
    return feature, cut, counts


def merged(cut: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``cut`` without splits into leaves that call the same class."""
    cut, calls = cut.copy(), counts[:, :, 1] > counts[:, :, 0]
    leaf = np.ones(calls.shape, bool)
    for level in range((cut.shape[1] + 1).bit_length() - 2, -1, -1):
        here, below = slice((1 << level) - 1, (2 << level) - 1), slice((2 << level) - 1, (4 << level) - 1)
        both = leaf[:, below].reshape(len(cut), -1, 2).all(2)
        same = calls[:, below][:, ::2] == calls[:, below][:, 1::2]
        cut[:, here][both & same] = NO_CUT
        leaf[:, here] = cut[:, here] == NO_CUT
    return cut


def leaf_values(cut: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each place of the last level: the share of class 1 in the leaf that leads there."""
    n = counts.sum(2)
    share = np.divide(counts[:, :, 1], n, out=np.zeros(n.shape), where=n > 0)
    values = share[:, :1]
    for level in range((cut.shape[1] + 1).bit_length() - 1):
        here, below = slice((1 << level) - 1, (2 << level) - 1), slice((2 << level) - 1, (4 << level) - 1)
        split = np.repeat(cut[:, here] != NO_CUT, 2, axis=1)
        values = np.where(split, share[:, below], np.repeat(values, 2, axis=1))
    return values


def fit_forests(
    rows: DataFrame,
    features: Sequence[str],
    label: str,
    fold: str,
    key: str,
    edges: dict[str, Sequence[float]],
    folds: int,
    trees: int,
    depth: int,
    seed: int,
) -> list[BinnedForest]:
    """A forest for each fold, from the rows outside of it. ``key`` is a 64-bit hash of the row; labels are
    0 or 1 and ``edges`` has at most 127 for each feature."""
    spark = rows.sparkSession
    sorted_edges = [np.asarray(edges[f], np.float64) for f in features]
    bins = [len(e) + 1 for e in sorted_edges]
    columns = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    chosen = rows.select(*columns, F.col(label).cast("int").alias("y"), F.col(fold).cast("int").alias("f"), F.col(key).alias("k"))
    path = new_table_path(spark, "forest-blocks")
    # Every level reads all blocks: alike pieces keep all cores busy to its end.
    pieces = chosen.repartition(spark.sparkContext.defaultParallelism)
    pieces.mapInArrow(_packed(sorted_edges), "fold int, cells binary, keys binary").write.parquet(path)
    feature, cut, counts = grow(spark.read.parquet(path), bins, folds, trees, depth, seed)
    drop_table(spark, path)
    cut = merged(cut, counts)
    feature = np.where(cut == NO_CUT, 0, feature)
    values = leaf_values(cut, counts)
    out = []
    for held in range(folds):
        own = slice(held * trees, (held + 1) * trees)
        out.append(BinnedForest(Trees(feature[own], cut[own], bins, depth), values[own], sorted_edges))
    return out
