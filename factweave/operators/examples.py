"""From question records to training examples."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import decomposition_text, strip
from factweave.operators.order import head_n, positional_split

# form, mode -> whether a decomposition must be there
PARSER_MODES = {
    ("decomposition", "train"): True,
    ("decomposition", "dev"): True,
    ("decomposition", "test"): True,
    ("plain", "train"): True,
    ("plain", "dev"): False,
    ("plain", "test"): True,
}


def present(*columns: str) -> Column:
    """At least one of the columns has an entry."""
    return reduce(or_, [F.col(c).isNotNull() for c in columns])


def where_present(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(present(*columns))


def where_nonempty(df: DataFrame, c: str) -> DataFrame:
    """Rows whose list has an entry; absent lists go too."""
    return df.where(F.size(c) > 0)


def length_filter(
    df: DataFrame, in_max: int, out_max: int, inputs: str = "input_ids", outputs: str = "output_ids"
) -> DataFrame:
    """Rows with fewer input and output ids than the limits."""
    return df.where((F.size(outputs) < out_max) & (F.size(inputs) < in_max))


def explode_paraphrases(df: DataFrame, paraphrases: str, k: int) -> DataFrame:
    """One row per paraphrase for the first k, with its place ``pos``; other columns stay."""
    rest = [c for c in df.columns if c != paraphrases]
    return df.select(*rest, F.posexplode(F.slice(paraphrases, 1, k)).alias("pos", "paraphrase"))


def regroup(
    results: DataFrame,
    key: str,
    k: int,
    values: dict[str, Column] | None = None,
    name: str = "results",
) -> DataFrame:
    """Per-paraphrase rows back to one row per item, in order, with their number.

    One aggregate per place 0..k-1 instead of a collected list: the state has a fixed size and
    is combined before the shuffle, also where one key has very many rows. ``n_results`` counts
    all rows of the key; the caller compares it with what was sent (see ``check_complete``). A row
    at a place from k on fails the job.
    """
    values = values or {
        "paraphrase": F.col("paraphrase"),
        "sub_sentences": F.col("sub_sentences"),
    }
    entry = F.struct(*[v.alias(c) for c, v in values.items()])
    beyond = F.raise_error(F.concat(F.lit(f"result beyond place {k}: "), F.col("pos").cast("string")))
    results = results.withColumn("pos", F.when(F.col("pos") < k, F.col("pos")).otherwise(beyond))
    places = [F.max(F.when(F.col("pos") == i, entry)).alias(f"_{i}") for i in range(k)]
    return (
        results.groupBy(key)
        .agg(F.count("*").alias("n_results"), *places)
        .select(key, "n_results", F.array_compact(F.array(*[f"_{i}" for i in range(k)])).alias(name))
    )


def check_complete(df: DataFrame, expected: Column, name: str = "results") -> DataFrame:
    """Fail the job if an item has more or fewer results than expected."""
    complete = (F.col("n_results") == expected) & (F.size(name) == expected)
    message = F.lit("number of results differs from number of paraphrases")
    return df.withColumn(name, F.when(complete, F.col(name)).otherwise(F.raise_error(message)))


def decomposer_examples(df: DataFrame, question: str, lines: str, keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Question as input, its decomposition as output; absent and empty ones are left out."""
    return where_nonempty(where_present(df, lines), lines).select(
        *keep,
        strip(question).alias("input"),
        decomposition_text(lines, F.lit(None).cast("string")).alias("output"),
    )


def paraphrase_examples(df: DataFrame, keep: tuple[str, ...] = ("ord",)) -> DataFrame:
    """The same from decomposed paraphrases, one row for each of them."""
    entries = df.select(
        *keep, F.posexplode("synthesis_question_paraphrases_sub_sentences").alias("pos", "entry")
    )
    flat = entries.select(*keep, "pos", "entry.paraphrase", "entry.sub_sentences")
    return decomposer_examples(flat, "paraphrase", "sub_sentences", (*keep, "pos"))


def parser_examples(
    df: DataFrame,
    mode: str,
    form: str = "decomposition",
    question: str = "nature_question",
    lines: str = "nature_question_sub_sentences",
    text: str = "nature_question_sub_sentences_text",
    cap: int | None = None,
    num_examples: int = 0,
    order: str = "ord",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Question form as input, program as output, by mode and form (see ``PARSER_MODES``).

    All rows, unless the caller sets ``cap`` (the running cap of training) or ``num_examples``.
    """
    rows = where_present(df, lines, text) if PARSER_MODES[form, mode] else df
    asked = decomposition_text(lines, text) if form == "decomposition" else strip(question)
    limits = [n for n in (cap, num_examples) if n and n > 0]
    rows = head_n(rows, min(limits, default=0), order)
    return rows.select(order, *keep, asked.alias("question"), strip("program").alias("program"))


def decomposer_split(examples: DataFrame, lo: int, hi: int, order: str = "ord") -> DataFrame:
    """The examples at the places lo, ..., hi - 1."""
    return positional_split(examples, lo, hi, order).drop("idx")
