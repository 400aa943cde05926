from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import candidates as cand
from factweave.operators import skew
from factweave.operators.inference import generate_candidates
from factweave.plans import evaluation


@pytest.fixture
def scored(spark):
    """One example with most of the rows, many equal scores, and some small examples."""
    draw = random.Random(2)
    rows = [(0, i, draw.choice([0.0, 0.0, 0.5, draw.random()])) for i in range(3_000)]
    rows += [(e, i, draw.choice([0.0, 1.0, draw.random()])) for e in range(1, 20) for i in range(5)]
    rows += [(e, i, x) for e in (0, 30) for i, x in ((5_000, None), (5_001, float("nan")), (5_002, 1.0), (9_000, None), (70_000, float("nan")))]
    return rows, spark.createDataFrame(rows, "example_id long, cand_idx int, score double").repartition(5)


def _plain_ranks(rows):
    want, by = {}, {}
    for e, i, s in rows:
        none = s is None or s != s
        by.setdefault(e, []).append(((none, 0 if none else -s), i))
    for e, group in by.items():
        want.update({(e, i): r + 1 for r, (_, i) in enumerate(sorted(group))})
    return want


@pytest.mark.parametrize("hot_rows", [10, 1_000_000, None])
def test_full_ranking(scored, monkeypatch, hot_rows):
    monkeypatch.setattr(cand, "PART_BITS", 6)
    rows, df = scored
    got = {(r.example_id, r.cand_idx): r.rank for r in cand.rank_candidates(df, "score", hot_rows=hot_rows).collect()}
    assert got == _plain_ranks(rows)


def test_top_ranks_are_limited_before_the_shuffle(scored):
    rows, df = scored
    top = cand.rank_candidates(df, "score", top=2)
    want = {k: r for k, r in _plain_ranks(rows).items() if r <= 2}
    assert {(r.example_id, r.cand_idx): r.rank for r in top.collect()} == want
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("min_rows", [2, 1_000])
def test_salted_join_equals_plain_join(spark, how, min_rows):
    many = spark.createDataFrame([("h" if i % 3 else str(i), i) for i in range(60)] + [("none", 99)], "k string, n int")
    one = spark.createDataFrame([("h", "hot")] + [(str(i), f"v{i}") for i in range(60)], "k string, v string")
    got = skew.join_to_unique(many, one, "k", how, "n", min_rows)
    want = many.join(one, "k", how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_hot_keys_are_few_by_arithmetic_and_salted_by_their_rows(spark):
    parts = 4 * skew.partitions(spark.range(1))
    df = spark.range(1_000).select(F.when(F.col("id") < 500, 0).when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"))
    got = {r.k: r.salts for r in skew.hot_keys(df, "k", 5).collect()}
    assert got == {0: -(-500 * parts // 1_000), 1: -(-200 * parts // 1_000)}
    even = spark.range(1_000).select((F.col("id") % (2 * parts)).alias("k"))
    assert skew.hot_keys(even, "k", 1).count() == 0
    assert skew.hot_keys(df, "k", 501).count() == 0
    assert skew.hot_keys(df.where("false"), "k", 1).count() == 0


@pytest.mark.parametrize("choose", ["best", "rank", "match"])
def test_each_text_goes_to_the_model_once(spark, choose):
    calls = spark.sparkContext.accumulator(0)

    def model():
        def predict(texts):
            calls.add(len(texts))
            return [[f"{t} a", f"{t} b"] for t in texts]

        return predict

    def back():
        def predict(texts):
            calls.add(len(texts))
            return texts

        return predict

    def embedder():
        return lambda texts: [[1.0, float(len(t))] for t in texts]

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        questions = spark.range(100).selectExpr("id AS example_id", "CAST(id AS STRING) AS question")
        truths = questions.selectExpr("example_id", "question AS answer")
        if choose == "match":
            candidates = questions.selectExpr("example_id", "0 AS cand_idx", "question AS prediction")
            row = evaluation.evaluate_semantic_match(candidates, questions, truths, back, embedder).first()
            assert row.n == 100
        else:
            candidates = generate_candidates(questions, "question", model).drop("question")
            if choose == "best":
                assert cand.best_of_n(candidates, truths).count() == 100
            else:
                scored = candidates.withColumn("score", F.length("prediction"))
                assert cand.rank_candidates(scored, "score").count() == 200
        assert calls.value == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_best_of_n(spark, hot_rows):
    candidates = spark.createDataFrame(
        [(1, 0, "x q"), (1, 1, "x y"), (1, 2, "y x"), (2, 0, "n"), (2, 1, "m"), (3, 0, "no truth")],
        "example_id long, cand_idx int, prediction string",
    )
    truths = spark.createDataFrame([(1, "x y"), (2, "z")], "example_id long, answer string")
    got = {r.example_id: r for r in cand.best_of_n(candidates, truths, hot_rows=hot_rows).collect()}
    assert set(got) == {1, 2}
    assert (got[1].cand_idx, got[1].prediction, got[1].em, got[1].f1, got[1].bleu2) == (1, "x y", 1, 1.0, 1.0)
    assert (got[2].cand_idx, got[2].f1, got[2].n_candidates) == (0, 0.0, 2)


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_semantic_rerank(spark, hot_rows):
    candidates = spark.createDataFrame(
        [(1, 1, "far", [0.0, 1.0]), (1, 2, "near", [2.0, 0.1]), (1, 3, "same as near", [4.0, 0.2]), (2, 1, "only", [0.0, 0.0])],
        "example_id long, cand_idx int, prediction string, embedding array<float>",
    )
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "example_id long, question_embedding array<float>")
    got = {r.example_id: r for r in cand.semantic_rerank(candidates, questions, hot_rows=hot_rows).collect()}
    assert got[1].prediction in ("near", "same as near") and got[1].similarity == pytest.approx(0.998752, abs=1e-5)
    assert (got[2].prediction, got[2].similarity) == ("only", 0.0)


def test_evaluations(spark):
    candidates = spark.createDataFrame(
        [(1, 0, "<pad> x  y</s>", [0.0, 1.0]), (1, 1, "z</s>", [1.0, 0.0])],
        "example_id long, cand_idx int, prediction string, embedding array<float>",
    )
    truths = spark.createDataFrame([(1, "x y</s><pad>")], "example_id long, answer string")
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "example_id long, question_embedding array<float>")
    best = evaluation.result_row(evaluation.evaluate_best(candidates, truths))
    assert best == {"f1": 1.0, "em": 1.0, "bleu1": 1.0, "bleu2": 1.0, "bleu3": 0.0, "bleu4": 0.0}
    reranked = evaluation.result_row(evaluation.evaluate_reranked(candidates, questions, truths))
    assert reranked["em"] == 0.0
    plain = evaluation.evaluate_plain(candidates.join(truths, "example_id")).first()
    assert (plain.n, plain.em) == (2, 0.5)
    ids = spark.createDataFrame([([4, 5, -100],)], "label_ids array<int>")
    assert evaluation.truth_ids(ids).first().label_ids == [4, 5]


def test_ranks_of_sparse_candidate_numbers(spark):
    """Numbers so far apart that each is a sub-part of its own, in one hot example, with equal and absent scores."""
    rows = spark.range(600).selectExpr("1 AS example_id", "id * 1000003 AS cand_idx", "CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 3 AS DOUBLE) END AS score")
    plain = cand.rank_candidates(rows, "score", hot_rows=None)
    parts = cand.rank_candidates(rows, "score", hot_rows=10)
    key = ["example_id", "cand_idx", "rank"]
    assert sorted(map(tuple, parts.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))
