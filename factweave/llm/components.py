"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.session import work_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one which all executors share."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The rows written and read again, so that a lost executor costs no more than its files."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def first_by_hash(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """The first ``most`` rows in the order of a hash of some columns, which tell rows apart.

    Of a longer table only hashes below a bound, about one and a half times as many rows as asked for,
    are ordered, so what meets in one task does not grow with the table.
    """
    total = rows.count()
    drawn = rows.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(*columns), 1))
    if total > 2 * most:
        drawn = drawn.where(F.col("_hash") < int((1 << 63) * min(1.0, (1.5 * most + 100) / total)))
    return drawn.orderBy("_hash", *columns).limit(most).drop("_hash")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least of its neighbours and itself."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours and itself to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a")
    sent = moved.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return sent.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b) but the roots; root is the least node it is
    linked with, over any number of links. Both rounds combine minima before the shuffle and no neighbour list
    is gathered. Each round is written to the shared folder."""
    folder = shared_folder(links.sparkSession, "links")
    state = F.struct(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).alias("state")
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before, step = stored(ordered.distinct(), f"{folder}/0"), None, 0
    while (now := edges.agg(state).first().state) != before:
        before, step = now, step + 1
        edges = stored(_small_star(_large_star(edges)), f"{folder}/{step}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
