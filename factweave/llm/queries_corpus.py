"""Queries of the operators on corpora: decontamination and mixing."""

from __future__ import annotations

from factweave.llm.decontamination import contaminated
from factweave.llm.mixing import MAX_MEAN, SEED, poisson_mix
from factweave.llm.register import query, table


@query("op6_benchmark_decontamination")
def op6(spark, folder):
    """Documents which hold a test item."""
    found = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


WEIGHTS = {f"src{i}": 1.0 + i % 5 for i in range(20)}
OTHER = 1.0

_MIX_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, CASE WHEN source IN ({", ".join(f"'{s}'" for s in WEIGHTS)}) THEN source END AS mixed FROM documents),
weighed AS (
  SELECT mixed, count(*) AS n,
         coalesce(CASE mixed {" ".join(f"WHEN '{s}' THEN {w}::DOUBLE" for s, w in WEIGHTS.items())} END, {OTHER}::DOUBLE) AS weight
  FROM docs GROUP BY mixed),
means AS (
  SELECT mixed, (SELECT sum(n) FROM weighed)::DOUBLE * weight / (SELECT sum(weight) FROM weighed) / n AS mean FROM weighed),
rates AS (SELECT mixed, mean, greatest(ceil(mean / {MAX_MEAN})::INT, 1) AS parts FROM means),
sums AS (
  SELECT mixed, mean / parts AS mean, 0 AS k, exp(-mean / parts) AS p, exp(-mean / parts) AS total FROM rates
  UNION ALL
  SELECT mixed, mean, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) FROM sums
  WHERE k < trunc(mean + 12 * sqrt(mean) + 30)),
draws AS (
  SELECT doc_id, docs.mixed, part,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || part), 1, 13))::BIGINT / {float(1 << 52)} AS u
  FROM docs JOIN rates ON docs.mixed IS NOT DISTINCT FROM rates.mixed, generate_series(1, parts) AS s(part)),
counted AS (
  SELECT doc_id, count(*) AS copies FROM draws JOIN sums ON draws.mixed IS NOT DISTINCT FROM sums.mixed AND sums.total <= draws.u GROUP BY doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INT AS copy,
       md5('{SEED}:order:' || coalesce(d.doc_id::VARCHAR, '') || ':' || c.copy) AS place
FROM documents d JOIN counted USING (doc_id), generate_series(1, copies) AS c(copy)
"""


@query("op5_poisson_mixing", _MIX_SQL)
def op5(spark, folder):
    """Documents repeated towards the weights of their sources, in a global random order."""
    found = poisson_mix(table(spark, folder, "documents"), WEIGHTS, OTHER)
    return found.select("doc.doc_id", "doc.text", "doc.lang", "doc.source", "doc.n_chars", "copy", "place")
