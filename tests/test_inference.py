from __future__ import annotations

import os
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from factweave.operators import inference
from factweave.plans import evaluation, trained


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_equal_prompts_are_asked_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def ask(prompt):
        calls.add(1)
        return prompt.upper()

    df = spark.createDataFrame([(i, ["a", "b", "a", None][i % 4]) for i in range(40)], "n int, p string")
    got = inference.complete(df, "p", ask, wait=0, prefix="<", suffix=">", parallel_calls=3).collect()
    assert sorted((r.n, r.completion) for r in got) == [(i, ["<A>", "<B>", "<A>", None][i % 4]) for i in range(40)]
    assert calls.value == 2


def _failing(folder, times):
    """A completer which fails on its first calls, counted in files."""

    def ask(prompt):
        tries = len([f for f in os.listdir(folder) if f.startswith(prompt)])
        if tries < times:
            open(os.path.join(folder, f"{prompt}-{tries}"), "w").close()
            raise ConnectionError("no answer")
        return "fine"

    return ask


def test_one_failure_is_tried_again(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "p string")
    assert inference.complete(df, "p", _failing(str(tmp_path), 1), wait=0).first().completion == "fine"


def test_a_second_failure_fails_the_job(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "p string")
    with pytest.raises(Exception, match="no answer"):
        inference.complete(df, "p", _failing(str(tmp_path), 99), wait=0).collect()


def test_generation_in_batches(spark):
    def make():
        def predict(texts):
            assert len(texts) <= 3
            return [t + "!" for t in texts]

        return predict

    df = spark.createDataFrame([(str(i),) for i in range(10)], "t string").coalesce(1)
    assert [r.generated for r in inference.generate(df, "t", make, 3).collect()] == [f"{i}!" for i in range(10)]
    lists = spark.createDataFrame([(["a", "b", "c", "d"],), ([],), (None,), (["e"],)], "t array<string>").coalesce(1)
    got = [r.generated for r in inference.generate_lists(lists, "t", make, 3).collect()]
    assert got == [["a!", "b!", "c!", "d!"], [], None, ["e!"]]


def test_ids_and_vectors(spark):
    df = spark.createDataFrame([("ab c",)], "t string")
    ids = inference.with_ids(df, "t", lambda: lambda texts: [[len(w) for w in t.split()] for t in texts])
    assert ids.first().input_ids == [2, 1]
    vectors = inference.with_embedding(df, "t", lambda: lambda texts: [[0.5, 1.0] for _ in texts])
    assert vectors.first().embedding == [0.5, 1.0]
    assert df.select(inference.word_tokens("t").alias("w")).first().w == ["ab", "c"]
    assert df.select(inference.word_tokens(F.lit(" \n")).alias("w")).first().w == []


def test_absent_texts_do_not_go_to_the_model(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "t string").coalesce(1)

    def upper():
        return lambda texts: [t.upper() for t in texts]

    assert [r.generated for r in inference.generate(df, "t", upper).collect()] == ["A", None, "B"]
    assert [r.input_ids for r in inference.with_ids(df, "t", lambda: lambda x: [[len(t)] for t in x]).collect()] == [[1], None, [1]]
    assert [r.embedding for r in inference.with_embedding(df, "t", lambda: lambda x: [[0.5] for _ in x]).collect()] == [[0.5], None, [0.5]]
    several = inference.generate_candidates(df, "t", lambda: lambda x: [[t, t] for t in x])
    assert [(r.t, r.cand_idx) for r in several.collect()] == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert trained.decompose_questions(df, _model, "t").where("t_sub_sentences IS NULL").count() == 1


def test_as_many_outputs_as_inputs(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="1 outputs for 2 inputs"):
        inference.generate(df, "t", lambda: lambda texts: texts[:1]).collect()


def test_ids_to_text(spark):
    df = spark.createDataFrame([([1, 2, -100],), ([],), (None,)], "label_ids array<int>").coalesce(1)
    texts = inference.with_text(evaluation.truth_ids(df), "label_ids", lambda: lambda lists: [" ".join(map(str, x)) + "</s>" for x in lists])
    assert [r.text for r in evaluation.decoded(texts, "text").collect()] == ["1 2", "", None]


def _model():
    return lambda texts: [f"<pad> FACT1: {t}. <FACT-SEP> Question: {t}?</s>" for t in texts]


def test_decompose_questions(spark):
    df = spark.createDataFrame([("x",)], "nature_question string")
    got = trained.decompose_questions(df, _model).first()
    assert got.nature_question_sub_sentences == ["FACT1: x.", "Question: x?"]


RESULT = "synthesis_question_paraphrases_sub_sentences"
SCHEMA = f"item_id string, synthesis_question_paraphrases array<string>, {RESULT} array<struct<paraphrase: string, sub_sentences: array<string>>>"


def _lines(p):
    return (p, [f"FACT1: {p}.", f"Question: {p}?"])


def test_decompose_paraphrases(spark):
    rows = [("1", list("abcdefg"), None), ("2", ["h"], [("h", ["old"])]), ("3", [], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.item_id: [tuple(x) for x in r[RESULT]] for r in trained.decompose_paraphrases(df, _model, 5).collect()}
    assert got == {"1": [_lines(p) for p in "abcde"], "2": [("h", ["old"])], "3": []}


def test_both_ways_give_the_same_paraphrase_results(spark):
    df = spark.createDataFrame([("1", list("abcdefg"), None), ("3", [], None), ("4", ["z"], None)], SCHEMA)
    listed = trained.decompose_paraphrases(df, _model, 5).select("item_id", RESULT)
    exploded = trained.decompose_exploded(df.drop(RESULT), _model, 5).select("item_id", RESULT)
    assert sorted(map(str, listed.collect())) == sorted(map(str, exploded.collect()))


def test_candidates_and_semantic_match_with_models(spark):
    """Two candidates per question; the back-translation of the longer one is the question."""

    def parser():
        return lambda texts: [[f"<pad> count {t}</s>", f"find {t} all</s>"] for t in texts]

    def back():
        return lambda texts: ["<pad>" + t.removeprefix("find ").removesuffix(" all") for t in texts]

    def embedder():
        return lambda texts: [[float(t.startswith("count")), float(len(t))] for t in texts]

    questions = spark.createDataFrame([(1, "x y"), (2, "z")], "example_id long, question string")
    truths = spark.createDataFrame([(1, "find x y all"), (2, "count z")], "example_id long, answer string")
    candidates = inference.generate_candidates(questions, "question", parser).drop("question")
    assert sorted((r.example_id, r.cand_idx) for r in candidates.collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]
    result = evaluation.evaluate_semantic_match(candidates, questions, truths, back, embedder).first()
    assert (result.n, result.em) == (2, 0.5)


def _sized(spark, rows, kilobytes):
    return spark.range(rows, numPartitions=1).select("id", F.repeat(F.lit("x"), kilobytes * 1024).alias("t"))


def test_generate_holds_one_call_of_bounded_size(spark):
    """Long texts: a call, all that a task has as objects, is bounded by bytes and not by rows alone."""

    def make():
        return lambda texts: [str(sum(map(len, texts))) for _ in texts]

    df = _sized(spark, 150, 100)
    listed = df.groupBy((F.col("id") % 50).alias("id")).agg(F.collect_list("t").alias("t")).coalesce(1)
    several = inference.generate_candidates(df, "t", lambda: lambda texts: [[x] for x in make()(texts)])
    for sizes in (
        [r.generated for r in inference.generate(df, "t", make).select("generated").collect()],
        [x for r in inference.generate_lists(listed, "t", make).select("generated").collect() for x in r.generated],
        [r.prediction for r in several.select("prediction").collect()],
    ):
        assert len(sizes) == 150 and 100 * 1024 < max(map(int, sizes)) <= inference.CALL_BYTES


def test_calls_count_values_and_bytes():
    values = pa.array([None, "a", None, "b", "c", None, "d"])
    assert [x.to_pylist() for x in inference._calls(values, 2)] == [[None, "a", None, "b"], ["c", None, "d"]]
    assert [len(x) for x in inference._calls(pa.nulls(5, pa.string()), 2)] == [5]
    large = pa.array(["x" * (inference.CALL_BYTES + 1), "y", "z"])
    assert [len(x) for x in inference._calls(large, 3)] == [1, 2]
    assert list(inference._calls(values.slice(0, 0), 2)) == []


def test_ids_and_texts_hold_one_call_of_bounded_size(spark):
    words = _sized(spark, 150, 100)
    ids = inference.with_ids(words, "t", lambda: lambda texts: [[sum(map(len, texts))] for _ in texts])
    sizes = [r.input_ids[0] for r in ids.select("input_ids").collect()]
    assert len(sizes) == 150 and max(sizes) <= inference.CALL_BYTES
    lists = spark.range(150, numPartitions=1).select("id", F.sequence(F.lit(1), F.lit(25_000)).alias("ids"))
    texts = inference.with_text(lists, "ids", lambda: lambda lists: [str(sum(map(len, lists))) for _ in lists])
    sizes = [int(r.text) for r in texts.select("text").collect()]
    assert len(sizes) == 150 and 25_000 < max(sizes) <= inference.CALL_BYTES // 4


def test_embeddings_hold_one_call_of_bounded_size(spark):
    vectors = inference.with_embedding(_sized(spark, 150, 100), "t", lambda: lambda texts: [[sum(map(len, texts))] for _ in texts])
    sizes = [r.embedding[0] for r in vectors.select("embedding").collect()]
    assert len(sizes) == 150 and max(sizes) <= inference.CALL_BYTES
