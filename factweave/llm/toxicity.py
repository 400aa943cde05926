"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Features are the different words, pairs of neighbours and pairs with one word between of a text, each
hashed to one of ``2**BITS`` places. Each place has its own learning rate, and the L1 penalty leaves
most weights zero, so the weights which are sent to all executors are few and never more than the
places. The fit runs on at most ``max_rows`` labelled documents, the first in the order of a hash of
the id, whatever the size of the corpus; every text is scored whole.

Contract for odd input: null and empty texts have no features and score by the intercept; a null id
is scored and is not held out; labels without id or value are left out, and of repeated labels of one
id the larger counts; without any labels every score is one half; ties in the hash order go by id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.components import first_by_hash

BITS = 20
MAX_ROWS = 20_000
MAX_KNOWN = 200_000
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """FTRL-proximal: rate alpha / (beta + sqrt(sum of squared gradients)) per weight, penalties l1, l2."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.01
    epochs: int = 5


class Features:
    """Places of a text's features. Hashes of words are kept for the most recent words."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = np.uint64((1 << bits) - 1), {}

    def _hash(self, word: str) -> int:
        if len(self.known) > MAX_KNOWN:
            self.known.clear()
        found = self.known[word] = zlib.crc32(word.encode()) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)
        return found

    def places(self, text: str | None) -> np.ndarray:
        known = self.known
        words = np.array([known.get(w) or self._hash(w) for w in _WORD.findall((text or "").lower())], np.uint64)
        grams = [words, self._pair(words, 1), self._pair(words, 2)]
        h = np.concatenate(grams)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((h >> np.uint64(40)) & self.mask).astype(np.int64)

    def _pair(self, words: np.ndarray, gap: int) -> np.ndarray:
        if len(words) <= gap:
            return words[:0]
        return words[:-gap] * np.uint64(0x94D049BB133111EB) + words[gap:] * np.uint64(2 * gap + 1) + np.uint64(gap)


def fit(examples: list[tuple[np.ndarray, int]], places: int, settings: Settings) -> np.ndarray:
    """Weights (the last is the intercept) after some passes over (places, label) examples."""
    z, n = np.zeros(places + 1), np.zeros(places + 1)
    s = settings

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where((np.abs(zs) <= s.l1) & (at < places), 0.0, w)

    for _ in range(s.epochs):
        for at, label in examples:
            at = np.append(at, places)
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            old = np.sqrt(n[at])
            n[at] += gradient * gradient
            z[at] += gradient - (np.sqrt(n[at]) - old) / s.alpha * w
    return weights(np.arange(places + 1))


def calibration(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift which make scores of unseen rows log odds (Platt scaling), by Newton steps.
    Targets are drawn in from 0 and 1 by one row each, so that perfect scores give finite numbers."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x = np.stack([scores, np.ones(len(scores))], axis=1)
    found = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (found - [1, 0]))
        found -= np.clip(step, -1, 1)
    return max(float(found[0]), 0.0), float(found[1])


def fit_calibrated(examples: list[tuple[np.ndarray, int]], places: int, settings: Settings) -> np.ndarray:
    """Weights of all examples, scaled by what a fit without every fifth example scores these."""
    weights = fit(examples, places, settings)
    kept, unseen = [x for i, x in enumerate(examples) if i % 5], examples[::5]
    if len({label for _, label in unseen}) < 2 or not kept:
        return weights
    part = fit(kept, places, settings)
    scores = np.array([part[at].sum() + part[-1] for at, _ in unseen])
    slope, shift = calibration(scores, np.array([label for _, label in unseen]))
    weights *= slope
    weights[-1] += shift
    return weights


def labelled(labels: DataFrame, value: str, held_out: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the rows which may be learned from, one per id."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(value).isNotNull() & ~held_out)
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(value).cast("int")).alias("label"))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in one fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, examples: DataFrame, id_col: str, text_col: str, settings: Settings, bits: int = BITS) -> dict[int, float]:
    """Weights by place; place ``2**bits`` is the intercept. ``examples`` (id, label) is bounded
    (see ``first_by_hash``), so it is sent to the scan of the documents and its texts to one task."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    chosen = texts.join(F.broadcast(examples), "id").select("id", "text", "label")
    ordered = chosen.repartition(1).sortWithinPartitions(F.xxhash64("id", "text"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, rows = Features(bits), []
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                rows.append((features.places(text).astype(np.int32), label))
        weights = fit_calibrated(rows, 1 << bits, settings)
        at = np.flatnonzero(weights)
        yield pa.record_batch([pa.array(at), pa.array(weights[at])], names=["place", "weight"])

    found = ordered.mapInArrow(run, "place long, weight double").toPandas()
    return dict(zip(found.place.tolist(), found.weight.tolist(), strict=True))


def score(text: Column, weights: dict[int, float], spark, bits: int = BITS) -> Column:
    """Probability that the text is toxic."""
    sent = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        dense = np.zeros((1 << bits) + 1)
        dense[list(sent.value)] = list(sent.value.values())
        features = Features(bits)
        sums = np.array([dense[features.places(t)].sum() + dense[-1] for t in texts])
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))), dtype="float64")

    return of(text)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.7,
    max_rows: int = MAX_ROWS,
    settings: Settings = Settings(),
) -> DataFrame:
    """One row per document: doc (all its columns), score and predicted (1 from the threshold on).
    ``held`` is a condition on the id column; labels of such rows are not learned from."""
    examples = first_by_hash(labelled(labels, "toxic", held, id_col), max_rows, "id")
    weights = train(docs, examples, id_col, text_col, settings)
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scored = docs.select(doc.alias("doc"), score(F.col(f"`{text_col}`"), weights, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
