"""Few-shot decomposition of a corpus, resumable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import (
    cut_at_stop,
    first_paraphrase,
    parse_completion,
    question_column,
    validate_decomposition,
)
from factweave.operators.inference import complete
from factweave.plans.results import CHUNK_ROWS, finish_in_chunks
from factweave.schemas import DECOMPOSE_HEAD, SENTENCE_HEAD


def training_questions(items: DataFrame) -> DataFrame:
    """(item_id, sentence) for training data: the first paraphrase."""
    return items.select(
        "item_id", first_paraphrase("synthesis_question_paraphrases").alias("sentence")
    )


def validation_questions(items: DataFrame) -> DataFrame:
    """(item_id, sentence) for dev and test data: the question kind which the split asks for."""
    return items.select("item_id", question_column("split").alias("sentence"))


def decompose(
    items: DataFrame, question: str, completer: Callable[[str], str], prefix: str, **options
) -> DataFrame:
    """Ask, cut, parse and check; a rejected completion gives an empty list."""
    asked = items.select("item_id", F.col(question).alias("sentence"))
    answered = complete(
        asked,
        "sentence",
        completer,
        prefix=prefix + SENTENCE_HEAD,
        suffix=DECOMPOSE_HEAD,
        **options,
    )
    lines = parse_completion(cut_at_stop("completion"))
    return answered.select(
        "item_id", "sentence", validate_decomposition(lines).alias("sub_sentences")
    )


def decompose_corpus(
    questions: DataFrame,
    out: str,
    work: str,
    completer: Callable[[str], str],
    prefix: str,
    chunk_rows: int = CHUNK_ROWS,
    retry_rejected: bool = False,
    tasks: int | None = None,
    **options,
) -> DataFrame:
    """Results of all (item_id, sentence) rows; only rows without a stored one are asked. ``work`` is a
    shared folder for the remaining work. With ``log`` among the options (see ``inference.complete``) answers outlive
    a chunk that fails half way, and are found again for other items, splits and runs."""

    def finish(part: DataFrame) -> DataFrame:
        return decompose(part, "sentence", completer, prefix, **options)

    return finish_in_chunks(questions, out, work, finish, chunk_rows, retry_rejected, tasks=tasks)
