"""Few-shot prompt files: blocks of a sentence and its decomposition, then the open block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.text import parse_completion, strip
from factweave.schemas import DECOMPOSE_HEAD, SENTENCE_HEAD, SLOT

MAX_EXAMPLES = 1_000


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Rows (example_no, sentence, sub_sentences) in file order, without the open block."""
    blocks = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split("value", "\n\n")).alias("example_no", "block")
    )
    head, body = F.split_part("block", F.lit(DECOMPOSE_HEAD), F.lit(1)), F.split_part(
        "block", F.lit(DECOMPOSE_HEAD), F.lit(2)
    )
    return (
        blocks.select(
            "example_no",
            strip(F.replace(head, F.lit(SENTENCE_HEAD), F.lit(""))).alias("sentence"),
            parse_completion(body).alias("sub_sentences"),
        )
        .where((F.col("sentence") != SLOT) & (F.col("sentence") != ""))
    )


def prompt_prefix(examples: DataFrame) -> str:
    """The blocks as one text, each followed by an empty line.

    A prompt is written by hand and fits into one request, so it is a literal of the plan;
    a table which is not a prompt is refused.
    """
    rows = examples.orderBy("example_no").limit(MAX_EXAMPLES + 1).collect()
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} few-shot examples")
    return "".join(block(r.sentence, r.sub_sentences) for r in rows)


def block(sentence: str, lines: list[str]) -> str:
    return SENTENCE_HEAD + sentence + DECOMPOSE_HEAD + "\n" + "\n".join(lines) + "\n\n"
