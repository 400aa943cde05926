"""Queries of the dedup operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.llm.register import query, table
from factweave.llm.simhash import near_duplicates
from factweave.llm.suffix_dedup import dedup_bytes
from factweave.llm.substring_dedup import dedup_substrings


@query("op7_substring_dedup")
def op7(spark, folder):
    """Words left when windows of 13 words seen in an earlier document are removed."""
    found = dedup_substrings(table(spark, folder, "documents"))
    return found.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_suffix_dedup")
def op1(spark, folder):
    """Bytes left when strings of 50 bytes that also start in an earlier document are removed."""
    found = dedup_bytes(table(spark, folder, "documents"))
    return found.select(
        "doc.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op4_simhash_near_dedup")
def op4(spark, folder):
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, folder, "documents"))
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), hexed.alias("fingerprint"), F.col("component").alias("component_id"))
