"""Queries over metric logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import runlog
from factweave.plans import standins as v
from factweave.plans.registry import query

RESET = 5_000
EVERY = 1_000
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query("eval_points", f"WITH {v.RUN_LOG_SQL} SELECT run, step, tag, value FROM runlog WHERE step % 2 = 0 AND step >= 10")
def eval_points(spark, folder):
    return runlog.eval_points(v.run_log(spark, folder), 2, 10)


def _improvements_sql(stretch: str, value: str = "value") -> str:
    over = f"OVER (PARTITION BY run{stretch} ORDER BY step"
    return f"""{v.RUN_LOG_SQL.replace("event_type AS tag, value", f"event_type AS tag, {value} AS value")},
    marked AS (
      SELECT run, step, value, row_number() {over}) AS i,
        greatest(-1.0, coalesce(max(value) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0)) AS best_before
      FROM runlog),
    improved AS (
      SELECT run, step, value, i, best_before, CAST(coalesce(value > best_before, false) AS INTEGER) AS improved FROM marked),
    failing AS (
      SELECT run, step, value, best_before, improved,
        CAST(i - coalesce(max(CASE WHEN improved = 1 THEN i END) {over}), 0) AS BIGINT) AS failures FROM improved)"""


@query(
    "running_best",
    f"WITH {_improvements_sql('', 'CASE WHEN event_id % 7 > 1 THEN value END')} "
    "SELECT run, step, round(best_before, 6) AS best_before, improved, failures FROM failing",
)
def running_best(spark, folder):
    """A seventh of the values each is NULL and NaN, which never improve."""
    turn = F.col("step") % 7
    gaps = F.when(turn == 0, F.lit(None)).when(turn == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = runlog.improvements(v.run_log(spark, folder).withColumn("value", gaps))
    return rows.select("run", "step", F.round("best_before", 6).alias("best_before"), "improved", "failures")


@query(
    "running_best_reset",
    f"WITH {_improvements_sql(f', step // {RESET}')} "
    "SELECT run, step, value, round(best_before, 6) AS best_before, improved FROM failing",
)
def running_best_reset(spark, folder):
    rows = runlog.improvements(v.run_log(spark, folder), RESET)
    return rows.select("run", "step", "value", F.round("best_before", 6).alias("best_before"), "improved")


@query(
    "early_stop",
    f"WITH {_improvements_sql('')} SELECT run, min(step) AS stop_step FROM failing WHERE failures >= 10 GROUP BY run",
)
def early_stop(spark, folder):
    return runlog.early_stop(v.run_log(spark, folder))


@query(
    "interval_mean",
    f"""WITH {v.RUN_LOG_SQL}
        SELECT run, ((step - 1) // {EVERY} + 1) * {EVERY} AS step, round(avg(value), 6) AS mean_value, count(*) AS n
        FROM (SELECT run, step + 1 AS step, value FROM runlog) GROUP BY ALL""",
)
def interval_mean(spark, folder):
    log = v.run_log(spark, folder).withColumn("step", F.col("step") + 1)
    return runlog.interval_mean(log, EVERY).select(
        "run", "step", F.round("mean_value", 6).alias("mean_value"), "n"
    )


@query(
    "retention",
    f"""WITH {v.RUN_LOG_SQL},
        ranked AS (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS r FROM runlog)
        SELECT run, 'checkpoint-' || step AS name, step FROM ranked WHERE r > 3""",
)
def retention(spark, folder):
    names = v.run_log(spark, folder).select(
        "run", F.concat(F.lit("checkpoint-"), F.col("step").cast("string")).alias("name")
    )
    return runlog.expired(names, 3).select("run", "name", "step")


@query(
    "metric_suffix",
    f"""WITH {v.RUN_LOG_SQL} SELECT run, tag || '_' || step AS metric, value FROM runlog""",
)
def metric_suffix(spark, folder):
    return runlog.metric_keys(v.run_log(spark, folder)).select("run", "metric", "value")


@query(
    "metric_pivot",
    f"""WITH {v.RUN_LOG_SQL}
        SELECT run, {', '.join(f"round(avg(value) FILTER (tag = '{t}'), 6) AS {t}" for t in EVENT_TYPES)}
        FROM runlog GROUP BY run""",
)
def metric_pivot(spark, folder):
    wide = runlog.pivot_metrics(v.run_log(spark, folder), ["run"], "tag", EVENT_TYPES)
    return wide.select("run", *[F.round(t, 6).alias(t) for t in EVENT_TYPES])
