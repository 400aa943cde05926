"""Joins between items and results on the item key.

A key may have any number of items; see ``skew`` for hot keys, and for ``hot_rows=None`` where
the items are known to have different keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.skew import HOT_ROWS, join_to_unique


def _keys(done: DataFrame, key: str) -> DataFrame:
    # Equal keys collapse before the shuffle.
    return done.select(key).distinct()


def pending(
    items: DataFrame,
    done: DataFrame,
    key: str = "item_id",
    result: str | None = None,
    retry_rejected: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Items without a result. Rejected items have an empty result and count as done,
    unless ``retry_rejected`` asks for them again."""
    if retry_rejected:
        done = done.where(F.size(result) > 0)
    return join_to_unique(items, _keys(done, key), key, "left_anti", min_rows=hot_rows)


def completed(
    items: DataFrame, done: DataFrame, key: str = "item_id", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Items with a result."""
    return join_to_unique(items, _keys(done, key), key, "left_semi", min_rows=hot_rows)


def attach(
    items: DataFrame,
    results: DataFrame,
    key: str = "item_id",
    how: str = "left",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Items with their result columns. A key with two results fails the job instead of repeating
    its items; see ``results.latest_results`` for tables which results are appended to."""
    columns = [c for c in results.columns if c != key]
    alone = F.when(F.col("_n") > 1, F.raise_error(F.lit("two results for one key"))).otherwise(F.col("_r"))
    one = results.groupBy(key).agg(F.first(F.struct(*columns)).alias("_r"), F.count("*").alias("_n"))
    one = one.select(key, alone.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
    return join_to_unique(items, one, key, how, min_rows=hot_rows)
