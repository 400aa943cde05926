from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factweave.operators import examples as ex
from factweave.operators import joins
from factweave.schemas import QUESTIONS

LINES = ["FACT1: ENTITY1\\'s x.", "Question: y?"]
TEXT = "FACT1: ENTITY1's x. <FACT-SEP> Question: y?"


@pytest.fixture
def questions(spark):
    def row(i, lines=None, text=None, synthesis=None, paraphrases=None):
        return (i, str(i), "set", "train", f" s{i} ", f"\tn{i} ", f" p{i}\n", paraphrases, synthesis, lines, text, None)

    rows = [
        row(0, lines=LINES, synthesis=LINES, paraphrases=["a", "b", "c", "d", "e", "f"]),
        row(1, text=" ready <FACT-SEP> text\\ ", synthesis=[], paraphrases=["g"]),
        row(2, paraphrases=[]),
        row(3, lines=[], synthesis=["Question: z?"]),
        row(4, lines=["Question: last?"]),
    ]
    return spark.createDataFrame(rows, QUESTIONS)


def test_presence_and_emptiness(questions):
    assert ex.where_present(questions, "nature_question_sub_sentences").count() == 3
    both = ("nature_question_sub_sentences", "nature_question_sub_sentences_text")
    assert ex.where_present(questions, *both).count() == 4
    assert ex.where_nonempty(questions, "nature_question_sub_sentences").count() == 2


def test_decomposer_examples(questions):
    got = ex.decomposer_examples(questions, "synthesis_question", "synthesis_question_sub_sentences")
    assert [tuple(r) for r in got.orderBy("ord").collect()] == [(0, "s0", TEXT), (3, "s3", "Question: z?")]


def test_paraphrase_examples(spark):
    schema = "ord long, synthesis_question_paraphrases_sub_sentences array<struct<paraphrase: string, sub_sentences: array<string>>>"
    df = spark.createDataFrame([(1, [(" a ", LINES), ("b", []), ("c", ["Question: c?"])]), (2, None)], schema)
    got = [tuple(r) for r in ex.paraphrase_examples(df).orderBy("ord", "pos").collect()]
    assert got == [(1, 0, "a", TEXT), (1, 2, "c", "Question: c?")]


@pytest.mark.parametrize(
    "mode, form, want",
    [
        ("train", "decomposition", [(0, TEXT, "p0"), (1, "ready <FACT-SEP> text\\", "p1"), (3, "", "p3")]),
        ("dev", "decomposition", [(0, TEXT, "p0"), (1, "ready <FACT-SEP> text\\", "p1"), (3, "", "p3"), (4, "Question: last?", "p4")]),
        ("train", "plain", [(0, "n0", "p0"), (1, "n1", "p1"), (3, "n3", "p3")]),
        ("dev", "plain", [(i, f"n{i}", f"p{i}") for i in range(5)]),
        ("test", "plain", [(i, f"n{i}", f"p{i}") for i in (0, 1, 3, 4)]),
    ],
)
def test_parser_examples(questions, mode, form, want):
    got = ex.parser_examples(questions, mode, form, cap=3 if mode == "train" else None)
    assert [tuple(r) for r in got.orderBy("ord").collect()] == want


def test_number_of_examples_cuts_after_the_filter(questions):
    got = ex.parser_examples(questions, "test", "plain", num_examples=3)
    assert sorted(r.ord for r in got.collect()) == [0, 1, 3]


def test_length_filter_is_strict(spark):
    rows = [(99, 299), (100, 299), (99, 300), (0, 0)]
    df = spark.createDataFrame([([0] * i, [0] * o) for i, o in rows], "input_ids array<int>, output_ids array<int>")
    got = ex.length_filter(df, 100, 300).select(F.size("input_ids"), F.size("output_ids"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0), (99, 299)]


def test_decomposer_split(spark):
    rows = spark.range(0, 16_800, 3).withColumnRenamed("id", "ord")
    train, dev = ex.decomposer_split(rows, 0, 5_000), ex.decomposer_split(rows, 5_000, 5_300)
    assert train.count() == 5_000 and train.agg(F.max("ord")).first()[0] == 3 * 4_999
    assert sorted(r.ord for r in dev.collect()) == [3 * i for i in range(5_000, 5_300)]


def test_regroup_inverts_explode(questions):
    rows = ex.explode_paraphrases(questions.select("item_id", "synthesis_question_paraphrases"), "synthesis_question_paraphrases", 5)
    assert rows.where("item_id = '0'").count() == 5
    back = ex.regroup(rows.repartition(3), "item_id", 5, {"paraphrase": F.col("paraphrase")})
    got = {r.item_id: (r.n_results, [x.paraphrase for x in r.results]) for r in back.collect()}
    assert got == {"0": (5, ["a", "b", "c", "d", "e"]), "1": (1, ["g"])}


def test_regroup_keeps_null_results_and_complains_about_missing_ones(spark):
    df = spark.createDataFrame([("x", 0, "p", None), ("x", 1, "q", ["r"])], "item_id string, pos int, paraphrase string, sub_sentences array<string>")
    grouped = ex.regroup(df, "item_id", 2)
    with pytest.raises(Exception, match="result beyond place 1"):
        ex.regroup(df, "item_id", 1).collect()
    assert [tuple(x) for x in grouped.first().results] == [("p", None), ("q", ["r"])]
    assert ex.check_complete(grouped, F.lit(2)).count() == 1
    with pytest.raises(Exception, match="number of results differs"):
        ex.check_complete(grouped, F.lit(3)).collect()


def test_no_cap_unless_asked_for(spark, questions):
    many = spark.range(60_000).selectExpr("id AS ord", "'n' AS nature_question", "'p' AS program", "array('Question: x?') AS l", "CAST(NULL AS STRING) AS t")
    assert ex.parser_examples(many, "train", lines="l", text="t").count() == 60_000


def test_two_results_for_a_key_are_an_error(spark):
    items = spark.createDataFrame([("1", 0)], "item_id string, n int")
    twice = spark.createDataFrame([("1", ["a"]), ("1", ["b"])], "item_id string, lines array<string>")
    with pytest.raises(Exception, match="two results for one key"):
        joins.attach(items, twice).collect()


@pytest.mark.parametrize("hot_rows", [2, 1_000_000, None])
def test_joins_on_the_key(spark, hot_rows):
    items = spark.createDataFrame([(str(i % 4), i) for i in range(8)], "item_id string, n int")
    keyless = spark.createDataFrame([(None, i) for i in range(9)], "item_id string, n int")
    done = spark.createDataFrame([("0", ["a"]), ("1", []), ("1", []), ("9", ["b"])], "item_id string, lines array<string>")
    assert sorted(r.n for r in joins.pending(items, done, hot_rows=hot_rows).collect()) == [2, 3, 6, 7]
    assert joins.pending(keyless, done, hot_rows=hot_rows).count() == 9
    assert joins.attach(keyless, done.where("item_id = '0'"), hot_rows=hot_rows).count() == 9
    again = joins.pending(items, done, result="lines", retry_rejected=True, hot_rows=hot_rows)
    assert {r.item_id for r in again.collect()} == {"1", "2", "3"}
    assert sorted(r.n for r in joins.completed(items, done, hot_rows=hot_rows).collect()) == [0, 1, 4, 5]
    attached = joins.attach(items, done.where("item_id = '0'"), hot_rows=hot_rows).collect()
    assert sorted((r.n, r.lines) for r in attached) == [(i, ["a"] if i % 4 == 0 else None) for i in range(8)]
