"""Plans which a change must not spoil: what reaches the scan, what is shuffled, what is split."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from factweave.operators import joins, order, runlog, scoring
from factweave.operators.inference import complete
from factweave.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["normalize_text", "fact_join", "completion_validate", "line_parse", "bleu", "generate_stub"]
)
def test_row_operators_shuffle_nothing_of_their_own(spark, name):
    lines = [x for x in plan_of(QUERIES[name](spark, FOLDER)).splitlines() if " Exchange" in x]
    assert not lines


@pytest.mark.parametrize("name, wanted", [("pending_anti", "doc_id"), ("eval_points", "value"), ("shard_scan", "o_custkey")])
def test_scans_read_only_what_is_used(spark, name, wanted):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert wanted in plan
    assert "text:string" not in plan and "props:string" not in plan and "o_totalprice" not in plan


def test_shard_filter_is_pushed(spark):
    plan = plan_of(QUERIES["shard_scan"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderkey,500)" in plan and "LessThan(o_orderkey,12000)" in plan


def test_no_query_holds_a_cross_join_or_an_unkeyed_window_over_rows(spark):
    for name, build in QUERIES.items():
        plan = plan_of(build(spark, FOLDER))
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name
        for line in plan.splitlines():
            if "row_number()" in line and "Window [" in line:
                assert re.search(r"\], \[[^\[\]]+\], \[[^\[\]]+\]$", line), (name, line)


def test_no_window_holds_more_than_a_group_of_the_level_below(spark):
    """Sparse places make as many blocks as rows: only the top level, of at most 2^24 groups, has no key."""
    rows = spark.range(1_000).select((F.xxhash64("id")).alias("ord"))
    plan = plan_of(order.dense_index(rows))
    windows = [x for x in plan.splitlines() if "Window [" in x]
    unkeyed = [x for x in windows if not re.search(r"\], \[[^\[\]]+\], \[[^\[\]]+\]$", x)]
    assert len(windows) >= 3 and unkeyed and all("_g48" in x for x in unkeyed), unkeyed
    got = sorted((r.ord, r.idx) for r in order.dense_index(rows).collect())
    assert [i for _, i in got] == list(range(1_000))


def test_a_hot_run_is_spread_when_versions_expire(spark):
    names = spark.range(4_000).selectExpr("IF(id % 3 = 0, id, -1) AS run", "concat('checkpoint-', id) AS name")
    df = runlog.expired(names, 2, hot_rows=100)
    assert "_salt" in plan_of(df)
    assert sorted(r.step for r in df.collect()) == sorted(i for i in range(4_000) if i % 3)[:-2]


def test_means_are_combined_before_the_shuffle(spark):
    df = spark.range(10).selectExpr("'x' AS prediction", "'x y' AS answer")
    assert "partial_avg" in plan_of(scoring.evaluate(df))


def test_running_best_reads_one_shuffle(spark):
    log = spark.range(0, 1000).selectExpr("id % 3 AS run", "id AS step", "rand(1) AS value")
    rows = runlog.improvements(log)
    rows.collect()
    assert "ReusedExchange" in plan_of(rows)


def test_padding_uses_one_shuffle_by_batch(spark):
    df = spark.range(100).selectExpr("CAST(id / 7 AS BIGINT) AS batch_id", "array(1) AS input_ids", "array(2) AS label_ids")
    assert plan_of(order.pad_batches(df)).count("Exchange hashpartitioning(batch_id") == 1


def test_hot_prompt_is_split_when_answers_are_joined_back(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        items = spark.range(0, 40_000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("prompt"),
            F.sha2(F.col("id").cast("string"), 256).alias("text"),
        )
        answered = complete(items, "prompt", lambda prompt: prompt.upper(), wait=0)
        assert answered.where("completion = upper(prompt)").count() == 40_000
        answered.collect()
        assert "skew=true" in plan_of(answered)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_remaining_work_is_found_with_one_shuffle_of_the_questions(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.range(100).selectExpr("CAST(id % 7 AS STRING) AS item_id", "'s' AS sentence")
        done = spark.range(3).selectExpr("CAST(id AS STRING) AS item_id")
        todo = joins.pending(asked.dropDuplicates(["item_id"]), done, hot_rows=None)
        assert plan_of(todo).count("Exchange hashpartitioning(item_id") == 2
        assert todo.count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
