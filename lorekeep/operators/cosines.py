"""Cosines of pairs in blocks of unit vectors: products, twelve decimals as SQL has them, and their exact percentile.

Blocks meet in a Cartesian product of partitions, which reads both sides where they lie: nothing is written or shuffled but the vectors once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are multiplied at a time, sums that are made anew at a time, bins of a histogram, values that are sorted on the driver at last.
STRIP, ANEW, BINS, FEW = 256, 1 << 12, 1 << 14, 1 << 19
#: All cosines of unit vectors; how far off a product may be, on the safe side.
ALL, OFF = (-1.0 - 1e-9, 1.0 + 1e-9), 1e-12

Pairs = Iterator[tuple[np.ndarray, np.ndarray, bool]]


def met(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """left joined with right on any condition, a partition of one with a partition of the other at a time."""
    return left.join(right.hint("shuffle_replicate_nl"), on)


def strips(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, products) of the rows of x with those of y; of a block with itself each pair counts once, other places are NaN."""
    for at in range(0, len(x), STRIP):
        s = x[at : at + STRIP] @ y.T
        if same:
            s[np.arange(len(y))[None, :] <= np.arange(at, at + len(s))[:, None]] = np.nan
        yield at, s


def _decimals(t: np.ndarray) -> np.ndarray:
    whole = np.trunc(t)
    return (whole + np.sign(t) * (np.abs(t - whole) >= 0.5)) / 1e12


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x as a sum of two numbers of half its digits, whose products are exact."""
    high = 134217729.0 * x
    high = high - (high - x)
    return high, x - high


def _fused(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner products of the rows of x and y, summed in the order of the components with one rounding a component, as a fused multiply-add does."""
    (xh, xl), (yh, yl) = _halves(x), _halves(y)
    whole = x * y
    rest = xl * yl - (((whole - xh * yh) - xl * yh) - xh * yl)
    out = np.zeros(len(x))
    for p, e in zip(whole.T, rest.T, strict=True):
        s = out + p
        v = s - out
        out = s + (((out - (s - v)) + (p - v)) + e)
    return out


def rounded(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, s: np.ndarray) -> np.ndarray:
    """s, the products of rows i of x and j of y, with twelve decimals, halves away from zero.

    A product of matrices adds in an order of its own. Where that may decide the last decimal, the components are summed in their order, as the SQL
    engine does, so the same two vectors have the same cosine in any block.
    """
    t = s * 1e12
    w = np.rint(t) / 1e12
    near = np.flatnonzero(np.abs(np.abs(t - np.trunc(t)) - 0.5) < 3e-4 * x.shape[1] + 1e-3)
    for at in range(0, len(near), ANEW):
        k = near[at : at + ANEW]
        w[k] = _decimals(_fused(x[i[k]], y[j[k]]) * 1e12)
    return w


def between(x: np.ndarray, y: np.ndarray, same: bool, low: float, high: float = math.inf) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, w) of the pairs with low < w <= high."""
    for at, s in strips(x, y, same):
        k = np.flatnonzero(s > low - OFF if high == math.inf else (s > low - OFF) & (s < high + OFF))
        i, j = np.divmod(k, len(y)) if len(k) else (k, k)
        i += at
        w = rounded(x, y, i, j, s.ravel()[k])
        ok = np.flatnonzero((w > low) & (w <= high))
        yield i[ok], j[ok], w[ok]


def counted(run: Callable, low: float, high: float, bins: int) -> tuple[int, np.ndarray, int]:
    """How many products are under low, in each of equal bins up to high, and over it; run(use, kind) is the frame of use(Pairs) in each task."""

    def use(pairs: Pairs):
        n = np.zeros(bins + 2, np.int64)
        for x, y, same in pairs:
            for _, s in strips(x, y, same):
                v = s[(s >= low) & (s <= high)]
                n[0] += np.count_nonzero(s < low)
                n[-1] += np.count_nonzero(s > high)
                n[1:-1] += np.bincount(np.minimum(((v - low) * (bins / (high - low))).astype(np.int64), bins - 1), minlength=bins)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k])], ["k", "n"])

    found = run(use, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(bins + 2, np.int64)
    n[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return int(n[0]), n[1:-1], int(n[-1])


def _values(run: Callable, low: float, high: float) -> tuple[int, np.ndarray, np.ndarray]:
    """How many products are under low, and the different cosines of those from low to high with the ends of their places."""

    def use(pairs: Pairs):
        below, held = 0, [np.empty(0)]
        for x, y, same in pairs:
            for at, s in strips(x, y, same):
                below += np.count_nonzero(s < low)
                k = np.flatnonzero((s >= low) & (s <= high))
                i, j = np.divmod(k, len(y)) if len(k) else (k, k)
                held.append(rounded(x, y, i + at, j, s.ravel()[k]))
            if len(held) > 1000:
                held = [np.concatenate(held)]
        w, n = np.unique(np.concatenate(held), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(w, -math.inf)), pa.array(np.append(n, below).astype(np.int64))], ["w", "n"])

    found = run(use, "w double, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    w, n = found.column("w").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(w)
    return int(n[order[0]]), w[order[1:]], np.cumsum(n[order[1:]]) if len(w) > 1 else np.zeros(1, np.int64)


def percentile(run: Callable, p: float, low: float, high: float, counts: tuple[int, np.ndarray, int], bins: int = BINS, few: int = FEW) -> float | None:
    """The interpolated percentile of all cosines, None if there are none, from counts of them from low to high.

    Histograms narrow the range about each of the two order statistics until few values are left, or only equal ones; those are taken with their
    twelve decimals. No pair is written, and a task hands on at most bins or few numbers. Counts need only be right about their sum: where they lead
    to a range without the place, all cosines are counted anew.
    """
    start, total = (low, high, *counts[:2]), counts[0] + int(counts[1].sum()) + counts[2]
    if not total:
        return None
    held = (0, np.empty(0), np.zeros(1, np.int64))

    def value(rank: int) -> float:
        nonlocal held
        low, high, below, counts = start
        while not held[0] <= rank < held[0] + held[2][-1]:
            if below <= rank < below + counts.sum():
                k = int(np.searchsorted(below + np.cumsum(counts), rank, side="right"))
                width = (high - low) / len(counts)
                low, high = low + k * width - OFF, low + (k + 1) * width + OFF
                if counts[k] <= few or high - low < 1e-10:
                    held = _values(run, low, high)
                    low, high = ALL
                    if held[0] <= rank < held[0] + held[2][-1]:
                        break
            else:
                low, high = ALL
            below, counts, _ = counted(run, low, high, bins)
        return float(held[1][np.searchsorted(held[0] + held[2], rank, side="right")])

    at = p * (total - 1)
    first = value(math.floor(at))
    return first + (value(math.ceil(at)) - first) * (at - math.floor(at))
