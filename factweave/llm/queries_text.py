"""Queries of the operators on single texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.llm.licenses import scan_licenses
from factweave.llm.register import query, table
from factweave.llm.secret_scan import BASE_RULES, RULES, Rule, scan_secrets, span_list
from factweave.llm.tokens import with_token_counts

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_counts")
def op2(spark, folder):
    """Tokens of every document, and whether they are over a limit."""
    found = with_token_counts(table(spark, folder, "documents"), vocabulary(), TOKEN_LIMIT)
    return found.withColumnRenamed("id", "doc_id").select("doc_id", F.col("n_bytes"), "n_tokens", "over_limit")


@query("op8_license_scan")
def op8(spark, folder):
    """License notices in every document."""
    return scan_licenses(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def _any_case(pattern: str) -> str:
    """Letters in either case, as a class, since RE2 would fold further letters into them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


def _secret_pattern(rule: Rule) -> str:
    pattern = rule.pattern
    if rule.ignore_case:
        words, rest = pattern.split(")", 1)
        pattern = f"{_any_case(words)}){rest}"
    return "'" + pattern.replace("'", "''") + "'"


def _secret_spans(number: int, rule: Rule) -> str:
    """A match starts after all parts and matches before it."""
    parts, hits = f"parts{number}", f"hits{number}"
    start = f"(list_sum(list_transform({parts}[:i], lambda x: length(x))) + coalesce(list_sum(list_transform({hits}[:i - 1], lambda x: length(x))), 0))::BIGINT"
    size = f"length(regexp_extract({hits}[i], {_secret_pattern(rule)}, {rule.group}))"
    found = f"{{'start': {start}, 'number': {number}, 'stop': {start} + length({hits}[i]), 'size': {size}}}"
    return f"list_filter(list_transform(range(1, len({hits}) + 1), lambda i: {found}), lambda s: s.size >= {rule.least})"


def _written(spans: str) -> str:
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    return f"array_to_string(list_transform({spans}, lambda s: concat({kinds}[s.number + 1], ':', s.start, ':', s.stop)), ',')"


_MATCHED = ", ".join(
    f"string_split_regex(text, {_secret_pattern(r)}) AS parts{i}, regexp_extract_all(text, {_secret_pattern(r)}) AS hits{i}" for i, r in enumerate(RULES)
)
_BASE = f"list_filter(spans, lambda s: s.number < {len(BASE_RULES)})"
_SECRETS_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matched AS (SELECT doc_id, {_MATCHED} FROM texts),
found AS (SELECT doc_id, list_sort(list_concat({", ".join(_secret_spans(i, r) for i, r in enumerate(RULES))})) AS spans FROM matched)
SELECT doc_id,
       {", ".join(f"len(list_filter(spans, lambda s: s.number = {i})) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))},
       sha256({_written(_BASE)}) AS base_sha256,
       {_written("spans")} AS spans
FROM found
"""


@query("op11_secret_scan", _SECRETS_SQL)
def op11(spark, folder):
    """Secrets in every document: counts of the base kinds, a digest of their spans, and all spans."""
    found = scan_secrets(table(spark, folder, "documents"))

    def of_kinds(*kinds: str):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of_kinds(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    base = of_kinds(*[r.kind for r in BASE_RULES])
    return found.select("doc.doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))
