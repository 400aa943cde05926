"""Decomposition with a trained model, of questions or of their paraphrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions.text import clean_decoded, split_facts
from factweave.operators.examples import check_complete, explode_paraphrases, regroup
from factweave.operators.inference import generate, generate_lists
from factweave.operators.joins import attach
from factweave.plans.results import CHUNK_ROWS, PARAPHRASE_RESULTS, finish_in_chunks

MakePredict = Callable[[], Callable[[list[str]], list[str]]]


def decompose_questions(
    items: DataFrame, make_predict: MakePredict, question: str = "nature_question", batch_size: int = 64
) -> DataFrame:
    """Add ``<question>_sub_sentences``; one projection, no shuffle."""
    out = generate(items, question, make_predict, batch_size, "_generated")
    lines = split_facts(clean_decoded("_generated"))
    return out.withColumn(f"{question}_sub_sentences", lines).drop("_generated")


def decompose_corpus(
    questions: DataFrame,
    out: str,
    work: str,
    make_predict: MakePredict,
    chunk_rows: int = CHUNK_ROWS,
    batch_size: int = 64,
) -> DataFrame:
    """Results of all (item_id, sentence) rows, stored chunk by chunk; a new run goes on
    where the last one stopped. ``work`` is a shared folder for the remaining work."""

    def finish(part: DataFrame) -> DataFrame:
        done = decompose_questions(part, make_predict, "sentence", batch_size)
        return done.withColumnRenamed("sentence_sub_sentences", "sub_sentences")

    return finish_in_chunks(questions, out, work, finish, chunk_rows)


def _entries(asked: str, generated: str) -> Column:
    return F.zip_with(
        asked,
        generated,
        lambda p, g: F.struct(p.alias("paraphrase"), split_facts(clean_decoded(g)).alias("sub_sentences")),
    )


def decompose_paraphrase_corpus(
    items: DataFrame,
    out: str,
    work: str,
    make_predict: MakePredict,
    k: int,
    chunk_rows: int = CHUNK_ROWS,
    batch_size: int = 64,
) -> DataFrame:
    """``decompose_paraphrases`` with results stored chunk by chunk in ``out``: an item with stored
    results is not sent to the model again, in this run or a later one. Returns the filled items."""
    result = "synthesis_question_paraphrases_sub_sentences"
    paraphrases = F.slice("synthesis_question_paraphrases", 1, k).alias("paraphrases")
    asked = items.where(F.col(result).isNull()).select("item_id", paraphrases)

    def finish(part: DataFrame) -> DataFrame:
        done = generate_lists(part, "paraphrases", make_predict, batch_size, "_generated")
        return done.withColumn("entries", _entries("paraphrases", "_generated"))

    done = finish_in_chunks(asked, out, work, finish, chunk_rows, schema=PARAPHRASE_RESULTS)
    joined = attach(items, done.select("item_id", F.col("entries").alias("_new")), hot_rows=None)
    return joined.withColumn(result, F.coalesce(result, "_new")).drop("_new")


def decompose_paraphrases(
    items: DataFrame,
    make_predict: MakePredict,
    k: int,
    batch_size: int = 64,
) -> DataFrame:
    """Fill ``synthesis_question_paraphrases_sub_sentences`` for items without it.

    The first k paraphrases go to the model as a list and come back as a list, so items
    are not taken apart and nothing is shuffled.
    """
    result = "synthesis_question_paraphrases_sub_sentences"
    todo = items.where(F.col(result).isNull()).withColumn(
        "_asked", F.slice("synthesis_question_paraphrases", 1, k)
    )
    out = generate_lists(todo, "_asked", make_predict, batch_size, "_generated")
    filled = out.withColumn(result, _entries("_asked", "_generated")).drop("_asked", "_generated")
    return filled.unionByName(items.where(F.col(result).isNotNull()))


def decompose_exploded(
    items: DataFrame,
    make_predict: MakePredict,
    k: int,
    key: str = "item_id",
    batch_size: int = 64,
) -> DataFrame:
    """The same with one row per paraphrase: for items whose lists are uneven, since rows
    can be spread over more tasks than items. One shuffle, at the regrouping."""
    asked = items.select(key, F.col("synthesis_question_paraphrases").alias("_all"))
    rows = explode_paraphrases(asked, "_all", k)
    out = generate(rows, "paraphrase", make_predict, batch_size, "_generated")
    results = regroup(
        out,
        key,
        k,
        {"paraphrase": F.col("paraphrase"), "sub_sentences": split_facts(clean_decoded("_generated"))},
        "_results",
    )
    joined = attach(items, results, key, hot_rows=None).withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    entries = F.coalesce("_results", F.array().cast(results.schema["_results"].dataType))
    expected = F.size(F.slice(F.coalesce("synthesis_question_paraphrases", F.array()), 1, k))
    checked = check_complete(joined.withColumn("_results", entries), expected, "_results")
    return checked.withColumn(
        "synthesis_question_paraphrases_sub_sentences", F.col("_results")
    ).drop("_results", "n_results")
