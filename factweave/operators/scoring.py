"""Scores per row and their means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.metrics import f1_of_words
from factweave.functions.overlap import overlap_counts, single_order_bleu
from factweave.functions.text import normalize_text, words
from factweave.schemas import GENERATION_MARGIN, LENGTH_SLICES, METRICS


def with_f1(df: DataFrame, prediction: str = "prediction", truth: str = "answer", em: bool = True) -> DataFrame:
    """Add ``f1`` and ``em``; each text is normalised once."""
    kept = df.columns
    df = df.withColumns({"_p": normalize_text(prediction), "_t": normalize_text(truth)})
    df = df.withColumns({"_pw": words("_p"), "_tw": words("_t")})
    scores = [f1_of_words("_pw", "_tw").alias("f1")]
    if em:
        scores.append((F.col("_p") == F.col("_t")).cast("int").alias("em"))
    return df.select(*kept, *scores)


def with_bleu(df: DataFrame, prediction: str = "prediction", truth: str = "answer") -> DataFrame:
    """Add ``bleu1`` ... ``bleu4``, each order alone, on the words between single spaces.

    All work stays in the row and nothing is shuffled, however long the texts are.
    """
    counted = df.withColumn("_counts", overlap_counts(prediction, truth))
    scores = [single_order_bleu("_counts", n).alias(f"bleu{n}") for n in (1, 2, 3, 4)]
    return counted.select(*df.columns, *scores)


def with_scores(df: DataFrame, prediction: str = "prediction", truth: str = "answer") -> DataFrame:
    return with_bleu(with_f1(df, prediction, truth), prediction, truth)


def length_slice(n: Column, slices: Sequence[tuple[int, int]] = LENGTH_SLICES) -> Column:
    """Name of the slice a number of sub-sentences falls into; NULL outside of all."""
    name = F.lit(None).cast("string")
    for lo, hi in reversed(slices):
        label = str(lo) if lo == hi else f"{lo}-{hi}"
        name = F.when(n.between(lo, hi), F.lit(label)).otherwise(name)
    return name


def mean_scores(scored: DataFrame, by: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Number of examples and mean of each score, in all or per group."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics]
    )


def evaluate(
    df: DataFrame, prediction: str = "prediction", truth: str = "answer", by: Sequence[str] = ()
) -> DataFrame:
    return mean_scores(with_scores(df, prediction, truth), by)


def evaluate_rollup(
    df: DataFrame, levels: Sequence[str], prediction: str = "prediction", truth: str = "answer", metrics: Sequence[str] = METRICS
) -> DataFrame:
    """Means for each group of all ``levels``, of all but the last, and so on down to the whole, in one pass.

    ``level`` is how many of them a row is grouped by; the others are NULL in it, as a missing value of a
    level itself may be. Each row is scored once, and its parts of every group are combined before the shuffle.
    """
    if not levels:
        raise ValueError("a rollup has one level at least")
    scored = with_scores(df, prediction, truth)
    grouped = sum((1 - F.grouping(c) for c in levels), F.lit(0)).cast("int")
    means = [F.avg(m).alias(m) for m in metrics]
    return scored.rollup(*levels).agg(grouped.alias("level"), F.count("*").alias("n"), *means)


def acceptance(df: DataFrame, lines: str, by: Sequence[str] = ()) -> DataFrame:
    """Items read, items with a decomposition, and their share."""
    accepted = F.count_if(F.size(lines) > 0)
    return df.groupBy(*by).agg(
        F.count("*").alias("loaded"),
        accepted.alias("saved"),
        (accepted / F.count("*")).alias("rate"),
    )


def length_profile(df: DataFrame, *columns: str) -> DataFrame:
    """Number of examples and greatest length of each list column."""
    return df.agg(
        F.count("*").alias("n"), *[F.max(F.size(c)).alias(f"max_{c}") for c in columns]
    )


def max_gen_length(df: DataFrame, outputs: str, margin: int = GENERATION_MARGIN) -> DataFrame:
    """How many ids a generator may write: the longest output and a margin."""
    return df.agg((F.max(F.size(outputs)) + margin).alias("max_length"))
