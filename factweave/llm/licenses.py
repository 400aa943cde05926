"""License scans by patience alignment of texts with license notices.

Words that occur once in a stretch of text and once in the notice are anchors; the longest run of
anchors in the same order on both sides is kept, and the gaps between them are aligned alike, with
the words unique there. A gap without anchors is matched from both its ends. The share of the
notice's words that are aligned is its coverage. A text is compared stretch by stretch, each twice as
long as the notice and begun a notice after the one before, so that words strewn over a long text
do not add up; a stretch is aligned only if enough different words of the notice occur in it.

Contract for odd input: null and empty texts hold no license; a null id, repeated rows and columns of
any name do no harm; of several stretches with equal coverage the first counts; licenses are reported
in the order of their coverage, then of their names; templates without words are an error.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.license_texts import TEMPLATES

COVERAGE = 0.8
HIT = "array<struct<license: string, coverage: double, first_word: int, last_word: int>>"
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops, piles, back = [], [], []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
        back.append(piles[p - 1] if p else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _once(words: list[str], low: int, high: int) -> dict[str, int]:
    found: dict[str, int] = {}
    for i in range(low, high):
        found[words[i]] = -1 if words[i] in found else i
    return {w: i for w, i in found.items() if i >= 0}


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing on both sides."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        there = _once(b, b0, b1)
        both = [(i, there[w]) for w, i in _once(a, a0, a1).items() if w in there]
        both.sort()
        anchors = [both[k] for k in longest_increasing([j for _, j in both])]
        if anchors:
            out.extend(anchors)
            for (i, j), (m, n) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
                open_.append((i + 1, m, j + 1, n))
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
    return sorted(out)


class Scanner:
    """Finds which templates a text holds."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.names = sorted(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        if not all(self.words):
            raise ValueError("a template has no words")
        self.coverage = coverage
        self.known: dict[str, int] = {}
        for words in self.words:
            for w in words:
                self.known.setdefault(w, len(self.known))
        self.holds = np.zeros((len(self.names), len(self.known)), np.int32)
        for i, words in enumerate(self.words):
            self.holds[i, [self.known[w] for w in words]] = 1
        # If a share c of the words is aligned, at most the rest can be missing, so at least
        # (different words - unaligned words) different ones are there.
        missing = np.array([int((1 - coverage) * len(w) + 1e-9) for w in self.words])
        self.least = np.maximum(self.holds.sum(axis=1) - missing, 1)

    def hits(self, text: str | None) -> list[tuple[float, str, int, int]]:
        words = words_of(text)
        codes = np.array([self.known.get(w, -1) for w in words], np.int64)
        there = np.zeros(len(self.known), np.int32)
        there[codes[codes >= 0]] = 1
        found = []
        for t in np.flatnonzero(self.holds @ there >= self.least):
            best = self._best(words, codes, int(t))
            if best:
                found.append(best)
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def _best(self, words: list[str], codes: np.ndarray, t: int) -> tuple[float, str, int, int] | None:
        template, best = self.words[t], None
        step, at = len(template), np.flatnonzero(codes >= 0)
        at = at[self.holds[t][codes[at]] > 0]
        for begin in (np.unique(np.concatenate([at // step, np.maximum(at // step - 1, 0)])) * step).tolist():
            low, high = np.searchsorted(at, (begin, begin + 2 * step))
            if len(np.unique(codes[at[low:high]])) < self.least[t]:
                continue
            pairs = align(words[begin : begin + 2 * step], template)
            share = len(pairs) / step
            if share >= self.coverage and (best is None or share > best[0]):
                best = (share, self.names[t], begin + pairs[0][0], begin + pairs[-1][0])
        return best


def license_hits(text: Column, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> Column:
    """The licenses a text holds, best first: license, coverage, first and last aligned word."""

    @F.pandas_udf(HIT)
    def of(texts: pd.Series) -> pd.Series:
        scanner = Scanner(templates, coverage)
        names = ("coverage", "license", "first_word", "last_word")
        return pd.Series([[dict(zip(names, h, strict=True)) for h in scanner.hits(t)] for t in texts])

    return of(text)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of the documents: id, license and coverage of the best hit (null if none) and all hits."""
    found = docs.select(F.col(f"`{id_col}`").alias("id"), license_hits(F.col(f"`{text_col}`"), **options).alias("hits"))
    best = F.get("hits", F.lit(0))
    return found.select("id", best["license"].alias("license"), best["coverage"].alias("coverage"), "hits")
