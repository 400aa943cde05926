"""Queries of the classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.llm.ann import nearest
from factweave.llm.quality import quality
from factweave.llm.register import query, table
from factweave.llm.toxicity import held_out, toxicity


@query("op10_toxicity")
def op10(spark, folder):
    """Toxicity of every document; one third of the ids is never learned from."""
    held = held_out("doc_id", 3, 1)
    found = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), held)
    return found.select("doc.doc_id", "score", "predicted").withColumn("held_out", held)


@query("op3_quality_rules")
def op3(spark, folder):
    """Quality of every document; one fifth of the ids is never learned from."""
    held = held_out("doc_id", 5, 0)
    found = quality(table(spark, folder, "documents"), table(spark, folder, "labels"), held)
    return found.select(F.col("id").alias("doc_id"), "score", "predicted").withColumn("held_out", held)


@query("op9_multi_index_neighbours")
def op9(spark, folder):
    """The five nearest vectors of every fiftieth vector."""
    found = nearest(table(spark, folder, "embeddings"), F.col("id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")
