"""Stored decompositions: what is done, what remains, and finishing it chunk by chunk."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.operators.joins import attach, pending
from factweave.operators.skew import partitions
from factweave.schemas import PARAPHRASE_RESULT
from factweave.sources.table import ResultTable, bucket_of

CHUNK_ROWS = 1_000_000
RESULTS = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("sentence", T.StringType()),
        T.StructField("sub_sentences", T.ArrayType(T.StringType())),
    ]
)


PARAPHRASE_RESULTS = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("paraphrases", T.ArrayType(T.StringType())),
        T.StructField("entries", T.ArrayType(PARAPHRASE_RESULT)),
    ]
)


def table_of(spark: SparkSession, path: str, schema: T.StructType = RESULTS, **options) -> ResultTable:
    return ResultTable(spark, path, schema, schema.names[0], **options)


def read_done(spark: SparkSession, path: str, schema: T.StructType = RESULTS, buckets: list[int] | None = None) -> DataFrame:
    """Stored results, of some hash buckets if given; an empty table before the first run."""
    return table_of(spark, path, schema).read(buckets)


def latest_results(done: DataFrame) -> DataFrame:
    """One row per item; an accepted result goes before a rejected one, then the greatest."""
    key, asked, found = done.columns
    best = F.max(F.struct(F.size(found).alias("n"), asked, found))
    return done.groupBy(key).agg(best.alias("r")).select(key, f"r.{asked}", f"r.{found}")


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def finish_in_chunks(
    questions: DataFrame,
    out: str,
    work: str,
    finish: Callable[[DataFrame], DataFrame],
    chunk_rows: int = CHUNK_ROWS,
    retry_rejected: bool = False,
    schema: T.StructType = RESULTS,
    tasks: int | None = None,
) -> DataFrame:
    """Apply ``finish`` to all (item_id, asked) rows without a result yet, and append.

    ``work`` is a folder which all executors share. The remaining work is written there once, then by
    chunks of about ``chunk_rows`` rows, so that each chunk reads its own rows only, and each finished
    chunk is appended to ``out``: what was paid for survives a lost executor or a stopped run. The
    folder's content is removed at the end. Equal questions are in the same chunk. Of several rows of
    one item the least counts, in every run. A chunk is dealt by item over ``tasks`` tasks before
    ``finish``, as many as the session runs at a time or shuffles to, so that a model uses the whole
    cluster however few files the chunk has.
    """
    spark, (key, asked, found) = questions.sparkSession, schema.names
    unique = questions.where(F.col(asked).isNotNull()).groupBy(key).agg(F.min(asked).alias(asked))
    table = table_of(spark, out, schema)
    tasks = tasks or max(spark.sparkContext.defaultParallelism, partitions(questions))
    done = table.read()
    todo = pending(unique, done, key, found, retry_rejected, hot_rows=None)
    folder = f"{work.rstrip('/')}/todo-{uuid.uuid4().hex}"
    kinds = T.StructType([schema[key], schema[asked]])
    try:
        todo.write.parquet(f"{folder}/rows")
        rows = spark.read.schema(kinds).parquet(f"{folder}/rows")
        chunks = -(-rows.count() // chunk_rows)
        dealt = rows.withColumn("chunk", bucket_of(asked, max(chunks, 1)))
        dealt.repartition("chunk", F.pmod(F.xxhash64(key), F.lit(tasks))).write.partitionBy("chunk").parquet(f"{folder}/chunks")
        parts = spark.read.schema(T.StructType([*kinds, T.StructField("chunk", T.IntegerType())])) if chunks else None
        for chunk in range(chunks):
            part = parts.parquet(f"{folder}/chunks").where(F.col("chunk") == chunk)
            table.append(finish(part.drop("chunk").repartition(tasks, key)))
    finally:
        _remove(spark, folder)
    return latest_results(table.read())


def attach_training(items: DataFrame, results: DataFrame) -> DataFrame:
    """Question records with the decomposition of their first paraphrase."""
    column = "synthesis_question_paraphrases_sub_sentences"
    entry = F.struct(F.col("sentence").alias("paraphrase"), "sub_sentences")
    found = results.select("item_id", F.array(entry).alias("_new"))
    joined = attach(items, found, hot_rows=None)  # item ids are unique
    return joined.withColumn(column, F.coalesce(column, "_new")).drop("_new")


def attach_validation(items: DataFrame, results: DataFrame) -> DataFrame:
    """Question records with the decomposition of the question which their split asks for."""
    joined = attach(items, results.select("item_id", F.col("sub_sentences").alias("_new")), hot_rows=None)
    dev = F.col("split") == "dev"
    new = {
        "synthesis_question_sub_sentences": F.when(dev, F.col("_new")),
        "nature_question_sub_sentences": F.when(~dev | dev.isNull(), F.col("_new")),
    }
    return joined.withColumns({c: F.coalesce(c, value) for c, value in new.items()}).drop("_new")
