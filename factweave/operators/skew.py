"""Joins which stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
PARTS = 4  # a key is hot from a fourth of a mean partition on


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """(key, salts): keys with more rows than a fourth of a mean shuffle partition, and with at
    least ``min_rows``; the number of salts follows from a key's rows.

    There are fewer than 4 x partitions such keys, whatever the data, so the table can be broadcast.
    Counts are combined before the shuffle and only the key column is read.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    share = counts.agg(F.sum("_rows")).scalar() / (PARTS * partitions(df))
    hot = counts.where((F.col("_rows") > share) & (F.col("_rows") >= min_rows))
    return hot.select(key, F.greatest(F.ceil(F.col("_rows") / share), F.lit(2)).cast("int").alias("salts"))


def join_to_unique(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "inner",
    spread_by: str | None = None,
    min_rows: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join many rows per key to a side with one row per key: inner, left, left_semi, left_anti.

    Rows of hot keys are spread over sub-keys, more for more rows, by the hash of ``spread_by``, and
    the one row of such a key is repeated for every sub-key. The hash, unlike a running number, is
    the same when a lost task is run again; rows are spread as far as they differ in
    ``spread_by`` (all columns by default). Rows without a key, which match nothing, are spread
    too. With ``min_rows=None``, for keys known to be unique, the join is a plain one and the
    count is saved. The adaptive split of skewed partitions would not do: it needs
    both sides fresh from a shuffle, and nothing after the join which relies on the key. Give
    ``hot``, a result of ``hot_keys``, where the keys can be counted on a cheaper table than ``many``.
    """
    if min_rows is None:
        return many.join(one, key, how)
    spread = F.xxhash64(*([spread_by] if spread_by else many.columns))
    hot = hot_keys(many, key, min_rows) if hot is None else hot
    hot = F.broadcast(hot.withColumnRenamed("salts", "_salts"))
    none = F.lit(0).cast("long")
    salts = F.when(F.col(key).isNull(), partitions(many)).otherwise(F.coalesce("_salts", F.lit(1)))
    left = many.join(hot, key, "left").withColumn("_salt", F.pmod(spread, salts))
    every = F.sequence(none, (F.coalesce("_salts", F.lit(1)) - 1).cast("long"))
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(every))
    return left.drop("_salts").join(right.drop("_salts"), [key, "_salt"], how).drop("_salt")
