"""Vector and token-id array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions.text import _col, let
from factweave.schemas import LABEL_PAD

EPSILON = 1e-15  # fixed value under the square root


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(c: Column | str) -> Column:
    """x / sqrt(sum(x * x) + 1e-15), in double precision."""
    v = _col(c).cast("array<double>")
    return let(F.sqrt(_dot(v, v) + F.lit(EPSILON)), lambda length: F.transform(v, lambda x: x / length))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product of the normalised vectors."""
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    return _dot(a, b) / (F.sqrt(_dot(a, a) + F.lit(EPSILON)) * F.sqrt(_dot(b, b) + F.lit(EPSILON)))


def strip_pad(c: Column | str, pad: int = LABEL_PAD) -> Column:
    """Ids before the first pad."""
    c = _col(c)
    place = F.array_position(c, F.lit(pad)).cast("int")
    return F.when(place > 0, F.slice(c, F.lit(1), place - 1)).otherwise(c)


def pad_to(c: Column | str, size: Column, pad: int) -> Column:
    c = _col(c)
    return F.concat(c, F.array_repeat(F.lit(pad), size - F.size(c)))
