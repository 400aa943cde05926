"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its share of the wanted rows over its rows. A document draws
a number in [0, 1) from a hash of seed and id, the Poisson distribution of its source's rate is
inverted at it, and the document is repeated that many times. Copies are put in the order of a hash of
seed, id and copy, so the order, like the draw, is the same on any cluster and in any rerun. A rate
above ``MAX_MEAN`` is drawn as a sum of equal smaller ones, since its chance of none is too small for
a double. Rates are one row per named source and one for the rest, so that table is sent to all
executors; documents of a hot source stay where they are.

Contract for odd input: a null source, or one without a weight, belongs to the rest, with weight
``other``; sources without rows get no share; a null id draws as the empty text; rows which repeat an
id draw alike and each is repeated; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.order import ordered_by_hash

MAX_MEAN = 500
SEED = 17


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _cumulative(mean: Column) -> Column:
    """Chances of at most 0, 1, 2, ... in a Poisson distribution, beyond what a double tells from 1."""
    many = (mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def add(state: Column, k: Column) -> Column:
        p = state.p * mean / k
        return F.struct(p.alias("p"), F.concat(state.sums, F.array(F.element_at(state.sums, -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), many), start, add, lambda state: state.sums)


def rates(docs: DataFrame, weights: dict[str, float], other: float, rows_out: float | None, source_col: str) -> DataFrame:
    """(mixed, mean, parts, sums): the rate of each source and what its inversion needs."""
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(float(w))) for k, w in weights.items()))
    counted = docs.groupBy(_mixed(source_col, weights).alias("mixed")).agg(F.count("*").alias("n"))
    weighed = counted.withColumn("weight", F.coalesce(known[F.col("mixed")], F.lit(float(other))))
    all_weights = weighed.agg(F.sum("weight")).scalar()
    wanted = weighed.agg(F.sum("n").cast("double")).scalar() if rows_out is None else F.lit(float(rows_out))
    mean = F.when(all_weights > 0, wanted * F.col("weight") / all_weights / F.col("n")).otherwise(0.0)
    found = weighed.select("mixed", mean.alias("mean"))
    found = found.withColumn("parts", F.greatest(F.ceil(F.col("mean") / MAX_MEAN).cast("int"), F.lit(1)))
    return found.withColumn("sums", _cumulative(F.col("mean") / F.col("parts")))


def _mixed(source_col: str, weights: dict[str, float]) -> Column:
    source = F.col(f"`{source_col}`").cast("string")
    return F.when(source.isin(list(weights)), source)


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float],
    other: float = 0.0,
    rows_out: float | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Rows (doc, copy, place): the documents with all their columns in ``doc``, copies numbered from
    1, in the order of ``place``. ``rows_out`` is the wanted number of rows, by default as many as
    there are."""
    if not weights or min([*weights.values(), other]) < 0:
        raise ValueError("weights must be given and not be negative")
    table = rates(docs, weights, other, rows_out, source_col)
    sent = F.broadcast(table.withColumnRenamed("mixed", "_mixed"))
    key = F.coalesce(F.col(f"doc.`{id_col}`").cast("string"), F.lit(""))
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(doc, _mixed(source_col, weights).alias("_source"))
    rows = rows.join(sent, F.col("_source").eqNullSafe(F.col("_mixed")))

    def drawn(part: Column) -> Column:
        u = unit_hash(F.lit(str(seed)), key, part.cast("string"))
        return F.size(F.filter("sums", lambda s: s <= u))

    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), drawn)
    copies = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    rows = rows.select("doc", copies.alias("copies")).where("copies > 0")
    rows = rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    place = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), key, F.col("copy").cast("string")).cast("binary"))
    return ordered_by_hash(rows.withColumn("place", place), "place", "copy")
