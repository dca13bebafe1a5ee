"""Dense networks fitted over a table: sigmoid layers, then a softmax over two classes (labels 0 and 1).

A pass over stored blocks of rows gives the summed loss and its gradient as one sum of numbers per task;
the driver, which holds nothing but weights, steps by L-BFGS. Weights lie as in Spark's multilayer
perceptron: layer by layer, a matrix by columns, then its offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a task works on at once, so that its matrices stay in the processor's cache.
ROWS = 1024
#: Products of matrices and of a vector that the library leaves to one thread; the tasks use all cores already.
ONE_THREAD, ONE_THREAD_VECTOR = 1 << 18, 9216
#: Rows of a stored block.
BLOCK = 1 << 16
#: Steps that L-BFGS remembers, and those over which its gain is judged.
MEMORY, LOOK_BACK = 10, 20


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for n, m in zip(sizes[:-1], sizes[1:], strict=True):
        matrix = weights[at : at + n * m].reshape(m, n, order="F")
        out.append((matrix, weights[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def network_part(weights: np.ndarray, sizes: Sequence[int]) -> Callable[[np.ndarray], np.ndarray]:
    """A function of a block of rows (features, label, how often each counts): the rows, their summed loss
    and its gradient. Of two classes the softmax is the sigmoid of the difference of their sums."""
    *inner, (last, ends) = _layers(weights, sizes)
    # With the sign turned, so that a sigmoid is 1 / (1 + exp(sum)).
    turned = [(np.ascontiguousarray(-matrix.T), -offset) for matrix, offset in inner]
    apart, shift = last[1] - last[0], ends[1] - ends[0]

    chunk = max(1, min(ONE_THREAD // max(m.size for m, _ in turned), ONE_THREAD_VECTOR // max(sizes)))
    chunks = max(1, ROWS // chunk)

    def of_rows(x: np.ndarray, y: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Of chunks of rows."""
        seen = [x]
        for matrix, offset in turned:
            z = seen[-1] @ matrix
            z += offset
            np.exp(z, out=z)
            z += 1
            seen.append(np.reciprocal(z, out=z))
        margin = seen[-1] @ apart + shift
        loss = (often * (np.logaddexp(0, margin) - y * margin)).sum()
        slope = often * (1 / (1 + np.exp(-margin)) - y)
        found = (slope[:, None] @ seen[-1]).sum((0, 1))
        parts = [np.array([-slope.sum(), slope.sum()]), np.stack((-found, found)).ravel(order="F")]
        slope = slope[:, :, None] * apart
        ones = np.ones((1, x.shape[1]))
        for k in range(len(inner) - 1, -1, -1):
            slope *= seen[k + 1]
            np.subtract(1, seen[k + 1], out=seen[k + 1])
            slope *= seen[k + 1]
            parts += [(ones @ slope).sum((0, 1)), (slope.swapaxes(1, 2) @ seen[k]).sum(0).ravel(order="F")]
            if k:
                slope = slope @ inner[k][0]
        return np.concatenate(([often.sum(), loss], *parts[::-1]))

    def part(block: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(weights) + 2), len(block)
        whole = n - n % (chunk * chunks)
        ends = [*range(chunk * chunks, whole + 1, chunk * chunks), *range(whole + chunk, n, chunk), n]
        # A sum too large for exp gives 0 or 1.
        with np.errstate(over="ignore"):
            for start, end in zip([0, *ends], ends, strict=False):
                if start < end:
                    rows = block[start:end].reshape(chunks if end - start == chunk * chunks else 1, -1, block.shape[1])
                    total += of_rows(np.ascontiguousarray(rows[:, :, :-2]), rows[:, :, -2], rows[:, :, -1])
        return total

    return part


def _direction(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient times the inverse curvature that the last steps tell."""
    q, shares = gradient.copy(), []
    for s, y in reversed(pairs):
        share = (s @ q) / (s @ y)
        shares.append(share)
        q -= share * y
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), share in zip(pairs, reversed(shares), strict=True):
        q += (share - (y @ q) / (s @ y)) * s
    return -q


def descend(
    of: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, tolerance: float = 1e-6
) -> np.ndarray:
    """At most ``steps`` steps of L-BFGS from ``start``; ``of`` gives the loss and its gradient. Ends, as
    Spark's, when the gradient is no more than ``tolerance`` of the loss, or the last twenty steps gained no
    more than that of the first loss."""
    x, (value, gradient) = start, of(start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    values = [value]
    for _ in range(steps):
        if np.linalg.norm(gradient) <= max(tolerance * abs(value), 1e-8):
            break
        if len(values) > LOOK_BACK and max(values[-LOOK_BACK:]) - value <= tolerance * abs(values[0]):
            break
        way = _direction(gradient, pairs)
        fall = way @ gradient
        if fall >= 0:
            pairs, way, fall = [], -gradient, -(gradient @ gradient)
        size, low, high = 1.0 if pairs else 1.0 / np.linalg.norm(gradient), 0.0, np.inf
        for _ in range(20):
            found, slope = of(x + size * way)
            if not found <= value + 1e-4 * size * fall:
                high = size
            elif slope @ way < 0.9 * fall:
                low = size
            else:
                break
            size = 2 * size if np.isinf(high) else (low + high) / 2
        if not found < value:
            break
        move, turn = size * way, slope - gradient
        if move @ turn > 1e-12 * (turn @ turn):
            pairs = [*pairs, (move, turn)][-MEMORY:]
        x, value, gradient = x + move, found, slope
        values.append(value)
    return x


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (features, label, how often) of doubles to blocks of bytes."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        values = np.column_stack([c.to_numpy() for c in rows.columns])
        return pa.record_batch([pa.array([values.tobytes()])], ["rows"])

    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        while n >= BLOCK:
            rows = pa.Table.from_batches(waiting)
            yield block(rows.slice(0, BLOCK))
            waiting, n = rows.slice(BLOCK).to_batches(), n - BLOCK
    if n:
        yield block(pa.Table.from_batches(waiting))


def fit_network(blocks: DataFrame, sizes: Sequence[int], start: np.ndarray, steps: int) -> np.ndarray:
    """The weights after at most ``steps`` steps from ``start`` on the mean loss over all rows of the
    ``packed`` blocks, which should be stored: every step reads them."""

    def of(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, total = network_part(weights, sizes), np.zeros(len(weights) + 2)
            for batch in batches:
                for rows in batch["rows"]:
                    total += part(np.frombuffer(rows.as_buffer()).reshape(-1, sizes[0] + 2))
            yield pa.record_batch([pa.array([total.tobytes()])], ["sums"])

        # A few thousand numbers per task.
        found = blocks.mapInArrow(summed, "sums binary").collect()
        total = np.sum([np.frombuffer(r["sums"]) for r in found], axis=0)
        return total[1] / total[0], total[2:] / total[0]

    return descend(of, start, steps)
