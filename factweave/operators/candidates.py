"""Choice among candidates of one example: by F1 against the truth or by similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.arrays import cosine
from factweave.operators.scoring import with_bleu, with_f1
from factweave.operators.skew import HOT_ROWS, hot_keys, join_to_unique, partitions

CUTS = 1_024
QUANTILES = ", ".join(f"{i / CUTS}D" for i in range(1, CUTS))
PART_BITS = 16  # 65,536 candidate numbers per part of equal scores


def rank_candidates(
    df: DataFrame,
    score: str,
    example: str = "example_id",
    tie: str = "cand_idx",
    top: int | None = None,
    hot_rows: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Rank by falling score, equal scores in candidate order; NULL and NaN are no score and come last.

    With ``top`` Spark drops the rows beyond it in every task before the shuffle. The full
    ranking sorts an example's candidates in one task, except for examples with very many of them
    (see ``hot_keys``): quantiles of their scores, more for more rows and up to 1,024, cut those into
    parts of like size, and ranks are counted inside the parts, after the rows of better parts. The
    input is computed once, dealt by example and candidate, and read from that shuffle by each step.
    """
    known = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    order = [F.desc_nulls_last("_known"), F.asc(tie)]
    kept, df = df.columns, df.withColumn("_known", known)
    if top is not None or hot_rows is None and hot is None:
        rank = F.row_number().over(Window.partitionBy(example).orderBy(*order)).cast("long")
        ranked = df.withColumn("rank", rank).select(*kept, "rank")
        return ranked if top is None else ranked.where(F.col("rank") <= top)
    df = df.repartition(partitions(df), example, tie)
    hot = hot_keys(df, example, hot_rows) if hot is None else hot
    cuts = df.join(F.broadcast(hot), example).groupBy(example).agg(
        F.expr(f"percentile_approx(_known, array({QUANTILES}))").alias("_all"), F.first("salts").alias("_n")
    )
    # Every so many of the quantiles, so that there are as many parts as the example has salts.
    step = F.greatest(F.lit(CUTS) / F.col("_n"), F.lit(1.0))
    some = F.filter("_all", lambda _, i: F.floor((i + 1) / step) > F.floor(i / step))
    cuts = cuts.select(example, F.array_distinct(F.coalesce(some, F.array().cast("array<double>"))).alias("_cuts"))
    # Usual examples are one part, 0, which starts at 0. A score so frequent that it fills a part is
    # itself a quantile: its rows are a part of their own, and cut by candidate number. So are rows
    # without a score, the last part.
    greater = F.size(F.filter("_cuts", lambda cut: cut > F.col("_known")))
    equal = F.col("_known").isNull() | F.array_contains("_cuts", F.col("_known"))
    last = 2 * F.size("_cuts") + 2
    part = F.when(F.col("_known").isNull(), last).otherwise(2 * greater + F.array_contains("_cuts", F.col("_known")).cast("int"))
    block = F.shiftright(F.col(tie).cast("long"), PART_BITS)
    usual = F.col("_cuts").isNull()
    rows = (
        df.join(F.broadcast(cuts), example, "left")
        .withColumn("_part", F.when(usual, 0).otherwise(part))
        .withColumn("_sub", F.when(~usual & equal, block).otherwise(0))
    )
    parts = [example, "_part", "_sub"]
    better = Window.partitionBy(example).orderBy("_part", "_sub").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        rows.where(~usual)
        .groupBy(*parts)
        .agg(F.count("*").alias("_rows"))
        .select(*parts, F.sum("_rows").over(better).alias("_start"))
    )
    inside = Window.partitionBy(*parts).orderBy(*order)
    start = F.coalesce("_start", F.lit(0))
    return (
        rows.join(starts, parts, "left")
        .withColumn("rank", start + F.row_number().over(inside))
        .select(*kept, "rank")
    )


def _best(df: DataFrame, score: str, example: str, tie: str, carry: list[str]) -> DataFrame:
    """The best row of every example as an aggregate, combined before the shuffle."""
    known = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    best = F.max(
        F.struct(known.alias("s"), (-F.col(tie)).alias("t"), *[F.col(c) for c in carry])
    )
    return df.groupBy(example).agg(best.alias("_b"), F.count("*").alias("n_candidates")).select(
        example,
        "n_candidates",
        (-F.col("_b.t")).alias(tie),
        F.col("_b.s").alias(score),
        *[F.col(f"_b.{c}").alias(c) for c in carry],
    )


def _paired(
    candidates: DataFrame, one: DataFrame, example: str, hot_rows: int | None, hot: DataFrame | None
) -> DataFrame:
    """Candidates with their example's row. Candidates may come from a model, so where their hot
    keys are counted they are dealt out once, and both the count and the join read that shuffle."""
    if hot is None and hot_rows is not None:
        candidates = candidates.repartition(partitions(candidates), example, "cand_idx")
    return join_to_unique(candidates, one, example, "inner", "cand_idx", hot_rows, hot)


def best_of_n(
    candidates: DataFrame,
    truths: DataFrame,
    example: str = "example_id",
    hot_rows: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The candidate with the best F1 per example, the first of equals, with all its scores.

    ``candidates(example, cand_idx, prediction)``, ``truths(example, answer)``. BLEU is
    computed after the choice, for one candidate per example.
    """
    paired = _paired(candidates, truths, example, hot_rows, hot)
    scored = with_f1(paired)
    chosen = _best(scored, "f1", example, "cand_idx", ["em", "prediction", "answer"])
    return with_bleu(chosen)


def similarity(
    candidates: DataFrame,
    questions: DataFrame,
    example: str = "example_id",
    hot_rows: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Cosine of each candidate's vector ``embedding`` with its question's ``question_embedding``."""
    paired = _paired(candidates, questions, example, hot_rows, hot)
    return paired.withColumn("similarity", cosine("embedding", "question_embedding"))


def semantic_rerank(
    candidates: DataFrame,
    questions: DataFrame,
    example: str = "example_id",
    carry: tuple[str, ...] = ("prediction",),
    hot_rows: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The candidate whose question, translated back, is most like the original question."""
    near = similarity(candidates, questions, example, hot_rows, hot)
    return _best(near, "similarity", example, "cand_idx", list(carry))


def rerank_scores(
    candidates: DataFrame,
    questions: DataFrame,
    truths: DataFrame,
    example: str = "example_id",
    hot_rows: int | None = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Scores of the re-ranked choice against the truth."""
    chosen = semantic_rerank(candidates, questions, example, ("prediction",), hot_rows, hot)
    return with_bleu(with_f1(chosen.join(truths, example)))
