from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import runlog


@pytest.fixture
def log(spark):
    draw = random.Random(3)
    rows = [("big", s, draw.choice([draw.random(), 0.9, 0.99])) for s in range(0, 4_000, 5)]
    rows += [(f"run{r}", s * draw.randint(1, 3) * 7, draw.random()) for r in range(5) for s in range(1)]
    rows += [("falling", s, 100.0 - s) for s in range(30)]
    rows += [("below", s, -5.0) for s in range(12)]
    rows += [("rising", s, float(s)) for s in range(40)]
    return rows, spark.createDataFrame(rows, "run string, step long, value double").repartition(4)


def plain(rows, reset=None):
    """Best before, improvement and failures, walked through in order."""
    out = {}
    for run in {r for r, _, _ in rows}:
        best, failures, stretch = -1.0, 0, None
        for _, step, value in sorted(x for x in rows if x[0] == run):
            if reset and step // reset != stretch:
                best, failures, stretch = -1.0, 0, step // reset
            improved = value > best
            failures = 0 if improved else failures + 1
            out[run, step] = (best, int(improved), failures)
            best = max(best, value)
    return out


@pytest.mark.parametrize("bits", [2, 5, 16])
@pytest.mark.parametrize("reset", [None, 100])
def test_improvements(log, bits, reset):
    rows, df = log
    got = {
        (r.run, r.step): (r.best_before, r.improved, r.failures)
        for r in runlog.improvements(df, reset, bits=bits).collect()
    }
    assert got == plain(rows, reset)


@pytest.mark.parametrize("bits", [2, 16])
def test_nan_and_null_are_never_better(spark, bits):
    nan = float("nan")
    values = [0.1, nan, 0.2, None, 0.15, 0.3, nan, nan, 0.31]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(values)], "run string, step long, value double")
    got = runlog.improvements(df, bits=bits).orderBy("step").collect()
    assert [r.improved for r in got] == [1, 0, 1, 0, 0, 1, 0, 0, 1]
    assert [r.failures for r in got] == [0, 1, 0, 1, 2, 0, 1, 2, 0]
    assert [r.best_before for r in got] == [-1.0, 0.1, 0.1, 0.2, 0.2, 0.2, 0.3, 0.3, 0.3]


@pytest.mark.parametrize("row", [("r", None, 0.5), (None, 1, 0.5)])
def test_rows_without_run_or_step_are_an_error(spark, row):
    df = spark.createDataFrame([("r", 0, 0.1), row], "run string, step long, value double")
    with pytest.raises(Exception, match="row without"):
        runlog.improvements(df).collect()


@pytest.mark.parametrize("bits", [3, 16])
def test_early_stop(log, bits):
    rows, df = log
    want = {}
    for (run, step), (_, _, failures) in sorted(plain(rows).items()):
        if failures == 10:
            want.setdefault(run, step)
    got = {r.run: r.stop_step for r in runlog.early_stop(df, bits=bits).collect()}
    assert got == want
    assert got["falling"] == 10 and got["below"] == 9 and "rising" not in got


def test_reset_comes_before_the_comparison(spark):
    df = spark.createDataFrame([("r", 4_500, 0.8), ("r", 5_000, 0.2), ("r", 5_500, 0.1)], "run string, step long, value double")
    assert [r.improved for r in runlog.improvements(df, 5_000).orderBy("step").collect()] == [1, 1, 0]


def test_eval_points(spark):
    df = spark.range(0, 40_001, 250).selectExpr("id AS step")
    steps = [r.step for r in runlog.eval_points(df, 500, 30_000, 100).orderBy("step").collect()]
    assert steps == list(range(30_000, 40_001, 500))


def test_interval_mean(spark):
    df = spark.range(1, 251).selectExpr("'r' AS run", "id AS step", "CAST(id AS DOUBLE) AS value")
    got = [tuple(r) for r in runlog.interval_mean(df).orderBy("step").collect()]
    assert got == [("r", 100, 50.5, 100), ("r", 200, 150.5, 100), ("r", 300, 225.5, 50)]


def test_expired_versions(spark):
    names = ["checkpoint-9", "checkpoint-10", "out/checkpoint-100", "checkpoint-20", "best", "checkpoint-x"]
    df = spark.createDataFrame([("a", n) for n in names] + [("b", "checkpoint-1")], "run string, name string")
    got = sorted((r.run, r.name, r.step) for r in runlog.expired(df, 2).collect())
    assert got == [("a", "checkpoint-10", 10), ("a", "checkpoint-9", 9)]
    for k in (None, 0, -1, 9):
        assert runlog.expired(df, k).count() == 0


def test_expired_versions_are_found_without_a_full_sort_of_a_run(spark):
    df = spark.range(100).selectExpr("id % 2 AS run", "concat('checkpoint-', id) AS name")
    plan = runlog.expired(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert runlog.expired(df, 3).count() == 94


def test_metric_rows_and_keys(spark):
    wide = spark.createDataFrame([("r", 500, 0.5, 1)], "run string, step long, f1 double, em int")
    rows = runlog.metric_rows(wide, ["run", "step"], ["f1", "em"], "eval_")
    assert sorted(tuple(r) for r in rows.collect()) == [("r", 500, "eval_em", 1.0), ("r", 500, "eval_f1", 0.5)]
    assert sorted(r.metric for r in runlog.metric_keys(rows).collect()) == ["eval_em_500", "eval_f1_500"]
    pivoted = runlog.pivot_metrics(rows, ["run", "tag"], "step", [500, 1000])
    assert sorted(map(tuple, pivoted.collect())) == [("r", "eval_em", 1.0, None), ("r", "eval_f1", 0.5, None)]


def test_sparse_steps_on_levels(spark):
    rng = random.Random(3)
    rows = [("r", i * 1_000_003, rng.choice([0.1, 0.5, 0.9, rng.random(), None, float("nan")])) for i in range(300)]
    rows += [("s", -5_000_000 + i * 77, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "run string, step long, value double")
    one_level = runlog.improvements(df, bits=40)
    on_levels = runlog.improvements(df, bits=4, level_bits=11)

    def as_rows(found):
        return sorted(map(str, found.select("run", "step", "best_before", "improved", "failures").collect()))

    assert as_rows(on_levels) == as_rows(one_level)


def test_no_window_holds_more_than_a_level(spark):
    """One run at sparse steps: every window is over a block or a group of blocks, not over the run."""
    df = spark.range(20_000).selectExpr("'r' AS run", "id * 100000 AS step", "CAST(id % 97 AS DOUBLE) AS value")
    for found in (runlog.improvements(df, level_bits=10), runlog.improvements(df, 5_000_000, level_bits=10)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window [")]
        # All but those of the last level, where a run has a row per 2^40 numbers, name a block or group.
        assert len(windows) >= 6
        last = [w for w in windows if "_block#" not in w.split("], [")[1] and "_g" not in w.split("], [")[1]]
        assert len(last) <= 2
    rows = df.withColumn("_block", F.shiftright("step", 16)).groupBy("run", F.shiftright("_block", 10).alias("g")).count()
    assert rows.agg(F.max("count")).first()[0] <= 1024


def test_expired_by_time_of_change(spark):
    rows = [("a", "checkpoint-9", 5), ("a", "checkpoint-10", 3), ("a", "checkpoint-best", 4), ("a", "other", 1), ("a", "checkpoint-x", None)]
    df = spark.createDataFrame(rows, "run string, name string, changed long")
    assert sorted(r.name for r in runlog.expired(df, 1, order="changed").collect()) == ["checkpoint-10", "checkpoint-best"]
    assert [r.name for r in runlog.expired(df, 1).collect()] == ["checkpoint-9"]
