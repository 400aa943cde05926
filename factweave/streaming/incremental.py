"""Decomposition of questions as they arrive in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.plans.few_shot import decompose
from factweave.plans.results import table_of


def decompose_stream(
    spark: SparkSession,
    in_dir: str,
    out: str,
    completer: Callable[..., str],
    checkpoint: str,
    prefix: str,
    question: str = "nature_question",
    fmt: str = "json",
    files_per_batch: int = 100,
    item: str = "item_id",
    event_time: str | None = None,
    delay: str = "7 days",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    schema: str | None = None,
    buckets: int | None = None,
    **options,
) -> StreamingQuery:
    """Decompose new items and stop when there are no new files left.

    Items seen before are dropped by Spark's state store, keyed by the item, so that no batch reads
    the results of others; of several rows of one item the first to arrive counts, and rows without an item or question
    are no questions. The state holds every key; with ``event_time`` (a timestamp column) it holds those of
    the last ``delay`` only, and an item that comes back later is asked again. A batch is written
    beside the checkpoint once, so that its plan is run once, and its results are one part of the result table,
    marked with the batch's number: a batch which is run again after a failure finds its number
    there and neither asks nor adds. ``prepare`` may derive the columns ``item`` and ``question`` from rows of ``schema``.
    """
    fields = schema or f"{item} string, {question} string" + (f", {event_time} timestamp" if event_time else "")
    rows = spark.readStream.schema(fields).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(in_dir)
    rows = prepare(rows) if prepare else rows
    rows = rows.where(F.col(item).isNotNull() & F.col(question).isNotNull())
    if event_time:
        fresh = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([item])
    else:
        fresh = rows.dropDuplicates([item])
    fresh = fresh.select(F.col(item).alias("item_id"), F.col(question).alias("_question"))
    made = {} if buckets is None else {"buckets": buckets}

    def run(batch: DataFrame, batch_id: int) -> None:
        table = table_of(spark, out, **made)
        folder = f"{checkpoint.rstrip('/')}/batch_rows"
        batch.write.mode("overwrite").parquet(folder)  # in a replay too: the state is written with it
        if table.manifest().batches.get(checkpoint, -1) >= batch_id:
            return
        stored = spark.read.schema("item_id string, _question string").parquet(folder)
        table.append(decompose(stored, "_question", completer, prefix, **options), (checkpoint, batch_id))

    return fresh.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
