"""Evaluation of a parser's candidates: plain, best of n, or re-ranked."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.arrays import strip_pad
from factweave.functions.text import clean_decoded
from factweave.operators.candidates import best_of_n, rerank_scores
from factweave.operators.inference import generate, with_embedding
from factweave.operators.scoring import mean_scores, with_scores
from factweave.schemas import METRICS


def decoded(df: DataFrame, *columns: str) -> DataFrame:
    """Clean decoder output before it is scored."""
    return df.withColumns({c: clean_decoded(c) for c in columns})


def truth_ids(df: DataFrame, ids: str = "label_ids") -> DataFrame:
    """Label ids without padding, ready for ``inference.with_text``."""
    return df.withColumn(ids, strip_pad(ids))


def evaluate_plain(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means over (prediction, answer) rows."""
    return mean_scores(with_scores(decoded(pairs, "prediction", "answer")), by)


def evaluate_best(candidates: DataFrame, truths: DataFrame) -> DataFrame:
    """Means over the best candidate of each example."""
    chosen = best_of_n(decoded(candidates, "prediction"), decoded(truths, "answer"))
    return mean_scores(chosen)


def evaluate_reranked(candidates: DataFrame, questions: DataFrame, truths: DataFrame) -> DataFrame:
    """Means over the candidate whose back-translation is nearest to the question."""
    chosen = rerank_scores(
        decoded(candidates, "prediction"), questions, decoded(truths, "answer")
    )
    return mean_scores(chosen)


def back_translated(
    candidates: DataFrame,
    make_question_model: Callable[[], Callable[[list[str]], list[str]]],
    make_embedder: Callable[[], Callable[[list[str]], list[list[float]]]],
    batch_size: int = 64,
) -> DataFrame:
    """Candidates with the question each of them answers and that question's vector."""
    asked = generate(candidates, "prediction", make_question_model, batch_size, "back_question")
    return with_embedding(decoded(asked, "back_question"), "back_question", make_embedder)


def evaluate_semantic_match(
    candidates: DataFrame,
    questions: DataFrame,
    truths: DataFrame,
    make_question_model: Callable[[], Callable[[list[str]], list[str]]],
    make_embedder: Callable[[], Callable[[list[str]], list[list[float]]]],
    batch_size: int = 64,
) -> DataFrame:
    """Re-ranked evaluation from texts: ``candidates(example_id, cand_idx, prediction)``,
    ``questions(example_id, question)``, ``truths(example_id, answer)`` and two models."""
    cleaned = decoded(candidates, "prediction")
    embedded = back_translated(cleaned, make_question_model, make_embedder, batch_size)
    asked = with_embedding(
        decoded(questions, "question"), "question", make_embedder, "question_embedding"
    )
    return evaluate_reranked(embedded, asked.select("example_id", "question_embedding"), truths)


def result_row(result: DataFrame, metrics: Sequence[str] = METRICS) -> dict[str, float]:
    """The one row of an evaluation over everything, on the driver."""
    row = result.select(*[F.col(m) for m in metrics]).first()
    return row.asDict() if row else {}
