"""A corpus pipeline: toxicity, near duplicates, repeated passages, benchmark items, source mixing.

Each stage takes (spark, docs, folder of the tables), works on all documents which the one before kept
and returns a table; all but the last return the columns of ``documents``. Rows with a null id are
kept by every stage but the last, which repeats or leaves out rows at random as asked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.components import shared_folder, stored
from factweave.llm.decontamination import without_benchmark
from factweave.llm.mixing import poisson_mix
from factweave.llm.queries_corpus import OTHER, WEIGHTS
from factweave.llm.register import table
from factweave.llm.simhash import one_of_each
from factweave.llm.substring_dedup import without_repeats
from factweave.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the classifier, fitted on all labels, does not reject."""
    found = toxicity(docs, table(spark, sf_dir, "labels"), F.lit(False))
    return found.where(F.coalesce("predicted", F.lit(0)) == 0).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of fingerprints of at most three differing bits."""
    return one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of 13 words seen in an earlier document; ``n_chars`` follows the text."""
    return _counted(without_repeats(docs))


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which hold no test item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the weights of their sources, in a global random order."""
    found = poisson_mix(docs, WEIGHTS, OTHER)
    names = [c for c in ("copy", "place") if c not in docs.columns]
    return found.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns], *names)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: SQL cannot fit the classifier or hash the shingles; the stages are tested against plain programs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
