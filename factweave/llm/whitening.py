"""Whitening of vectors by exact covariances from bit planes.

Components become integers, x = floor(scale * c) + shift. A slab of rows is turned into bit planes:
bit p of dimension i, over all rows of the slab, packed into 64-bit words. The number of common bits of
two planes is a popcount of their AND, and the sum over all pairs of planes, weighted by 2^(p + q),
is the exact sum of the products of two dimensions. So a task gives one row per pair of dimensions, whatever
its number of rows, and the sums over tasks are exact decimals. Covariances are centred as integers,
n * sum(x y) - sum(x) sum(y), and only then become doubles for the eigenvectors.

Vectors are projected in a second pass, and the covariance of the whitened values is measured in a third one, over all rows.
The driver holds matrices of dimensions x dimensions and nothing that grows with the rows.

Contract for odd input: a vector that is null, of another length than most (ties: the shorter
one), or holds a null or non-finite entry is dropped; null ids stay; rows that repeat count as often as they
come; equal eigenvalues come in any order; a component without variance (an eigenvalue below the rounding of
the largest) has no whitened value (null), and takes no part in the error; no rows, or vectors of length zero, give no rows. scale * c must fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.components import shared_folder, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
SLAB = 1 << 15  # rows of a slab
_SUM = pa.decimal128(38, 0)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(planes, dimensions, words) of values of at least zero: bit p of each, over rows packed in words."""
    bits = max(int(values.max(initial=0)).bit_length(), 1)
    words = -(-len(values) // 64)
    planes = np.zeros((bits, values.shape[1], words * 8), np.uint8)
    for p in range(bits):
        packed = np.packbits((values >> np.uint64(p)).astype(np.uint8) & 1, axis=0)
        planes[p, :, : len(packed)] = packed.T
    return planes.view(np.uint64)


def scatter(values: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums of each dimension, and of the products of each pair of them (j <= i), by popcounts."""
    low = values.min(axis=0)
    planes = bit_planes((values - low).view(np.uint64))
    bits, width, _ = planes.shape
    n, base = len(values), [int(x) for x in low]
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
    sums = [sum(int(ones[p, i]) << p for p in range(bits)) for i in range(width)]
    products = []
    for i in range(width):
        total = [0] * (i + 1)
        for p in range(bits):
            if not ones[p, i]:
                continue
            common = np.bitwise_count(planes[:, : i + 1] & planes[p, i]).sum(axis=2, dtype=np.int64)
            for q in range(bits):
                total = [t + (c << (p + q)) for t, c in zip(total, common[q].tolist(), strict=True)]
        # Back from the slab's own least values to the common origin.
        products.append([t + base[i] * sums[j] + base[j] * sums[i] + n * base[i] * base[j] for j, t in enumerate(total)])
    return [s + n * b for s, b in zip(sums, base, strict=True)], products


def _long_rows(lists: pa.Array, n: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(n, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, total) of a task: counts at (-1, -1), sums at (i, -1), products at (i, j)."""
    totals: dict[tuple[int, int], int] = {}

    def add(i: int, j: int, x: int) -> None:
        totals[i, j] = totals.get((i, j), 0) + x

    for batch in batches:
        rows = _long_rows(batch.column("x"), batch.num_rows) if batch.num_rows else np.zeros((0, 0), np.int64)
        for at in range(0, len(rows), SLAB):
            some = rows[at : at + SLAB]
            sums, products = scatter(some)
            add(-1, -1, len(some))
            for i, (s, row) in enumerate(zip(sums, products, strict=True)):
                add(i, -1, s)
                for j, x in enumerate(row):
                    add(i, j, x)
    if totals:
        i, j = zip(*totals, strict=True)
        values = pa.array([Decimal(x) for x in totals.values()], _SUM)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], names=["i", "j", "total"])


@dataclass(frozen=True)
class Fit:
    """Exact counts and sums of all vectors, and the components of their covariance."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column per component
    explained: np.ndarray

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt of each eigenvalue; nan where there is no variance."""
        floor = max(self.values.max(initial=0.0), 0.0) * len(self.values) * np.finfo(float).eps
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > floor, 1 / np.sqrt(self.values), np.nan)


def fit_of(n: int, sums: list[int], products: dict[tuple[int, int], int]) -> Fit:
    """Centred as integers: n^2 times each covariance is exact."""
    width = len(sums)
    v = np.zeros((width, width))
    for (i, j), total in products.items():
        v[i, j] = v[j, i] = (n * total - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    trace = np.trace(v)
    explained = values[order] / trace if trace > 0 else np.zeros(width)
    return Fit(n, sums, v, values[order], vectors[:, order], explained)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x) of the vectors that take part; x as longs of one length."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), x.alias("x")).where(F.col("x").isNotNull() & good)
    width = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("x") == (width.n if width else 0)).where(F.size("x") > 0)
    return rows.select("id", F.transform("x", lambda v: F.floor(v * scale) + F.lit(shift).cast("long")).alias("x"))


def covariance_fit(rows: DataFrame) -> Fit | None:
    """The fit over all rows (id, x); None if there are none."""
    totals = rows.select("x").mapInArrow(_sums, "i int, j int, total decimal(38,0)")
    found = {(r.i, r.j): int(r.total) for r in totals.groupBy("i", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
    if not found:
        return None
    n, width = found[-1, -1], max(i for i, _ in found) + 1
    return fit_of(n, [found[i, -1] for i in range(width)], {k: x for k, x in found.items() if k[1] >= 0})


def _deviations(centred: np.ndarray) -> pa.Array:
    """Exact sums of squares of each row."""
    largest = int(np.abs(centred).max(initial=0))
    if centred.dtype != object and largest * largest * centred.shape[1] < 1 << 63:
        return pa.array((centred * centred).sum(axis=1)).cast(_SUM)
    return pa.array([Decimal(sum(x * x for x in row)) for row in centred.tolist()], _SUM)


def whitened(rows: DataFrame, fit: Fit, components: int = COMPONENTS) -> DataFrame:
    """(id, deviation, values) of rows (id, x): the sum of (n x - S)^2 and the whitened components."""
    basis = fit.vectors[:, :components] * fit.scales[:components]
    n, sums = fit.n, np.array(fit.sums, dtype=object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _long_rows(batch.column("x"), batch.num_rows)
            fits = n * max(int(x.max()), -int(x.min())) < 1 << 62  # then the sums fit as well
            centred = n * x - sums.astype(np.int64) if fits else n * x.astype(object) - sums
            values = (centred / n).astype(np.float64) @ basis
            places = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * values.shape[1])
            flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
            lists = pa.ListArray.from_arrays(places, flat)
            yield pa.record_batch([batch.column("id"), _deviations(centred), lists], names=["id", "deviation", "values"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(project, f"id {kind}, deviation decimal(38,0), values array<double>")


def identity_error(white: DataFrame) -> float:
    """The largest entry of the covariance of the whitened values minus the identity, over all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                v = np.nan_to_num(np.asarray(batch.column(0).flatten().fill_null(0.0)).reshape(batch.num_rows, -1))
                n, first, second = n + len(v), first + v.sum(axis=0), second + v.T @ v
        if n:
            flat = [float(n), *first.tolist(), *second.ravel().tolist()]
            yield pa.record_batch([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["place", "total"])

    parts = white.select("values").mapInArrow(moments, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    flat = np.array([r.total for r in sorted(parts.collect())])
    if not len(flat):
        return 0.0
    width = int(round(((4 * len(flat) - 3) ** 0.5 - 1) / 2))
    mean = flat[1 : width + 1] / flat[0]
    covariance = flat[width + 1 :].reshape(width, width) / flat[0] - np.outer(mean, mean)
    some = np.diag(covariance) > 0  # components without variance take no part
    return float(np.abs(covariance - np.eye(width))[np.ix_(some, some)].max(initial=0.0))


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> tuple[DataFrame, Fit | None, float]:
    """(rows, fit, error): (id, deviation, values) of every vector that takes part, the fit over all of
    them, and the measured error of the identity. Tables are written to the shared folder."""
    folder = shared_folder(vectors.sparkSession, "whitening")
    rows = stored(integer_vectors(vectors, id_col, vector_col, scale, shift), f"{folder}/rows")
    fit = covariance_fit(rows)
    if fit is None:
        return rows.select("id", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("values")), None, 0.0
    white = stored(whitened(rows, fit, components), f"{folder}/whitened")
    return white, fit, identity_error(white)
