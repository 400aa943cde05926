"""Threshold joins of integer vectors by an inverted index with norm bounds, tile by tile.

A tile is a part of the rows and a block of the queries. Dimensions come in one order, those of least energy
first. Of a row, the leading dimensions whose norm times the query's stays below the threshold are
left out of the index: they alone cannot reach it. Rows are sorted by how much is left out, so
that the postings of a dimension are the first so many rows. A query adds up partial scores from
the last dimensions to the first, a group at a time, and drops a row as soon as its score and the
product of the remaining norms stay below the query's threshold. What is left is verified by exact integer products.
"""

from __future__ import annotations

import numpy as np

GROUP = 8  # dimensions added between two prunings


class Index:
    """Rows of a tile (integers, dimensions in order) for queries of at least ``least`` per unit of norm."""

    def __init__(self, rows: np.ndarray, least: float):
        values = rows.astype(np.float64)
        groups = -(-max(rows.shape[1], 1) // GROUP)
        values = np.pad(values, ((0, 0), (0, groups * GROUP - rows.shape[1])))
        squares = (values * values).reshape(len(rows), groups, GROUP).sum(axis=2)
        norms = np.sqrt(np.concatenate([np.zeros((len(rows), 1)), np.cumsum(squares, axis=1)], axis=1))
        # Groups left out: the norm up to their end is too small. With a share to spare for rounding.
        left_out = (norms[:, 1:] * (1 + 1e-9) < least).sum(axis=1)
        self.order = np.argsort(left_out, kind="stable")
        self.rows, self.values, self.norms = rows[self.order], values[self.order], norms[self.order]
        self.first = left_out[self.order]
        self.posted = [int(np.searchsorted(self.first, g, side="right")) for g in range(groups)]
        self.groups, self.largest = groups, float(norms[:, -1].max(initial=0.0))

    def at_least(self, query: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(places of the rows whose product with the query is at least the threshold, products)."""
        wide = np.pad(query.astype(np.float64), (0, self.groups * GROUP - len(query))).reshape(self.groups, GROUP)
        norms = np.sqrt(np.concatenate([[0.0], np.cumsum((wide * wide).sum(axis=1))]))
        spare = 1.0 + 1e-9 * norms[-1] * self.largest
        alive = np.arange(self.posted[-1])
        score = np.zeros(len(alive))
        for g in range(self.groups - 1, -1, -1):
            if not len(alive):
                break
            # Places are in order: those whose postings end here only keep what they have.
            there = int(np.searchsorted(alive, self.posted[g]))
            score[:there] += self.values[alive[:there], g * GROUP : (g + 1) * GROUP] @ wide[g]
            rest = np.minimum(self.first[alive], self.groups)
            rest = np.maximum(rest, g)
            keep = score + norms[rest] * self.norms[alive, rest] >= threshold - spare
            alive, score = alive[keep], score[keep]
        exact = self.products(alive, query, norms[-1])
        good = exact >= threshold
        return self.order[alive[good]], exact[good]

    def products(self, places: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        rows = self.rows[places]
        if norm * self.largest < 2.0**52:
            return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        if norm * self.largest < 2.0**62:
            return rows @ query
        return rows.astype(object) @ query.astype(object)  # a product beyond a long is an error later on
