"""Overlap of n-grams inside a row, on whole numbers.

Words of a batch get ranks, once, in Arrow. A gram is the pair of the ranks of two shorter ones, its first half and its
last (1 and 1, 2 and 1, 2 and 2), so that no text of a gram is ever built. Grams are counted as longs, by
one sort of (row, gram, side) for each order: n log n for texts of any length, nothing is shuffled, and ranks
are exact, not hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERS = 4
SLICE_WORDS = 1 << 19  # words counted at a time: two ranks, the row and a bit fit into a long
COUNTS = "struct<n_p:int,n_t:int,overlaps:array<int>>"


def _clipped(grams: np.ndarray, stride: int, rows: np.ndarray, predicted: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row, the sum over its different grams (numbers below ``stride``) of the smaller of the two counts."""
    marked = np.sort((rows * stride + grams) * 2 + predicted)
    keys = marked >> 1
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    count = np.diff(np.append(first, len(keys)))
    in_prediction = np.add.reduceat(marked & 1, first)
    smaller = np.minimum(in_prediction, count - in_prediction)
    return np.bincount(keys[first] // stride, smaller, n_rows).astype(np.int64)


def overlaps_of(words: np.ndarray, lengths: np.ndarray, n_rows: int) -> np.ndarray:
    """(rows, orders): clipped overlaps, of the ranks of all words of 2 x n_rows texts, predictions first."""
    out = np.zeros((n_rows, ORDERS), np.int64)
    if not len(words):
        return out
    text = np.repeat(np.arange(len(lengths)), lengths)
    row, predicted = text % n_rows, text < n_rows
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))  # words from here to the end of the text
    one = words.astype(np.int64)
    many = int(one.max()) + 1
    two = np.zeros(len(words), np.int64)
    two[:-1] = np.unique(one[:-1] * many + one[1:], return_inverse=True)[1]
    pairs = int(two.max()) + 1
    grams = {1: (one, many), 2: (two, pairs), 3: (two[:-2] * many + one[2:], pairs * many), 4: (two[:-2] * pairs + two[2:], pairs * pairs)}
    for n, (gram, stride) in grams.items():
        at = np.flatnonzero(left >= n)
        if not len(at):
            break
        out[:, n - 1] = _clipped(gram[at], stride, row[at], predicted[at], n_rows)
    return out


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Rows in runs of about ``SLICE_WORDS`` words; a longer row is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > SLICE_WORDS:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _sides(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return lists.flatten(), np.diff(np.asarray(lists.offsets))


def _counted(predictions: pa.Array, truths: pa.Array) -> pa.Array:
    known = np.asarray(predictions.is_valid()) & np.asarray(truths.is_valid())
    rows = np.flatnonzero(known)
    some = pa.array(rows)
    (p_words, n_p), (t_words, n_t) = _sides(predictions.take(some)), _sides(truths.take(some))
    coded = pa.chunked_array([p_words, t_words]).combine_chunks().dictionary_encode()
    ranks = np.asarray(coded.indices).astype(np.int64)
    p_ranks, t_ranks = ranks[: len(p_words)], ranks[len(p_words) :]
    p_ends, t_ends = np.append(0, np.cumsum(n_p)), np.append(0, np.cumsum(n_t))
    found = np.zeros((len(known), ORDERS), np.int32)
    for part in _slices(n_p + n_t):
        words = np.concatenate([p_ranks[p_ends[part.start] : p_ends[part.stop]], t_ranks[t_ends[part.start] : t_ends[part.stop]]])
        found[rows[part]] = overlaps_of(words, np.concatenate([n_p[part], n_t[part]]), part.stop - part.start)
    sizes = np.zeros((2, len(known)), np.int32)
    sizes[0, rows], sizes[1, rows] = n_p, n_t
    offsets = pa.array(np.arange(len(known) + 1, dtype=np.int32) * ORDERS)
    lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
    return pa.StructArray.from_arrays(
        [pa.array(sizes[0]), pa.array(sizes[1]), lists], names=["n_p", "n_t", "overlaps"], mask=pa.array(~known)
    )


def overlap_counts(prediction: str, truth: str) -> Column:
    """Struct of the number of words on each side and the clipped overlaps of all orders; NULL for a NULL text.
    Words lie between single spaces."""

    @F.arrow_udf(COUNTS)
    def of(predictions: pa.Array, truths: pa.Array) -> pa.Array:
        return _counted(predictions, truths)

    return of(F.split(f"`{prediction}`", " "), F.split(f"`{truth}`", " "))


def single_order_bleu(counts: str, n: int) -> Column:
    """Clipped precision of one order times the brevity penalty; 0 without overlap."""
    n_p, n_t, overlap = f"{counts}.n_p", f"{counts}.n_t", f"{counts}.overlaps[{n - 1}]"
    brevity = f"if({n_p} > {n_t}, 1D, exp(1 - {n_t} / {n_p}))"
    return F.expr(f"if({overlap} = 0, 0D, {brevity} * ({overlap} / greatest({n_p} - {n - 1}, 1)))")
