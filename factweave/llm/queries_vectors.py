"""Queries of the operators on vectors, but for the neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.llm.hard_negatives import HIGH, LOW, NEGATIVES, POSITIVES, SCALE, hard_negatives
from factweave.llm.register import query, table
from factweave.llm.whitening import COMPONENTS, whiten

_NEGATIVES_SQL = f"""
WITH vectors AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_dot_product(a.x, r.x)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.id % 100 = 0 AND a.id <> r.id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}
"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def op12(spark, folder):
    """Hard negatives of every hundredth vector; the label of every seventh is changed first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label).withColumn("rank", F.col("rank").cast("int"))


@query("op13_embedding_whitening")
def op13(spark, folder):
    """The first whitened components of every vector, and how well they are white."""
    found, fit, error = whiten(table(spark, folder, "embeddings"))
    explained = F.array(*[F.lit(float(e)) for e in fit.explained[:COMPONENTS]]) if fit else F.array().cast("array<double>")
    values = found.select("*", F.posexplode("values").alias("place", "whitened"))
    return values.select(
        F.col("id").alias("vec_id"),
        (F.col("place") + 1).alias("component"),
        F.lit(fit.n if fit else 0).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(explained, "place").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
