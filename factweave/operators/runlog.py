"""Metric logs: rows (run, step, tag, value) and what is read off them.

Running values are computed over blocks of steps: inside a block by a window, across blocks
from one row per block, on levels (see ``order.prefix_scan``). A run with a third of all rows is thus
spread over many tasks, be its steps dense or sparse.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators.order import LEVEL_BITS, NUMBER_BITS, Marks, prefix_scan
from factweave.operators.skew import HOT_ROWS, join_to_unique

STEP_BITS = 16  # 65,536 consecutive steps per block
START = -1.0  # fixed value: best score before the first evaluation
PATIENCE = 10
EVALUATE_EVERY = 500
PARSER_START = 30_000
RESET_EVERY = 5_000
LOG_EVERY = 100


def metric_rows(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], prefix: str = "") -> DataFrame:
    """Wide metric rows to (ids, tag, value)."""
    return df.select(*ids, *[F.col(m).cast("double").alias(prefix + m) for m in metrics]).unpivot(
        list(ids), [prefix + m for m in metrics], "tag", "value"
    )


def eval_points(
    log: DataFrame, every: int = EVALUATE_EVERY, start: int = 0, logging_steps: int = 1
) -> DataFrame:
    """Rows at steps where an evaluation runs."""
    step = F.col("step")
    return log.where((step % logging_steps == 0) & (step % every == 0) & (step >= start))


def improvements(
    log: DataFrame,
    reset_every: int | None = None,
    start: float = START,
    run: str = "run",
    bits: int = STEP_BITS,
    level_bits: int = LEVEL_BITS,
) -> DataFrame:
    """Best value before each row, whether the row beats it, and failures in a row so far.

    ``(run, step)`` is unique and given; a value may be NULL or NaN, which never improves. With ``reset_every`` the best value starts again at each step
    which it divides, before the comparison; the failures then count within that stretch.
    """
    keys = [run]
    # The key itself fails the job: a filter beside it might be moved below and hide such rows.
    for c in (run, "step"):
        log = log.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"row without {c}"))).otherwise(F.col(c)))
    if reset_every:
        log = log.withColumn("stretch", F.expr(f"step div {int(reset_every)}"))
        keys.append("stretch")
    blocked = [*keys, "_block"]
    inside = Window.partitionBy(*blocked).orderBy("step")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    previous = inside.rowsBetween(Window.unboundedPreceding, -1)

    # A row's mark is its value and its place, earlier places greater: the greatest mark up to
    # a row tells the best value and where it was first reached. A row without run or step fails
    # the job. NaN and NULL are no value: they are never better, and no later value is compared
    # with them; Spark orders NaN above all numbers.
    known = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    rows = (
        log.withColumn("_block", F.shiftright("step", bits))
        .where(reduce(and_, [F.col(c).isNotNull() for c in blocked]))  # so that both paths read one shuffle
        .withColumn("_n", F.row_number().over(inside))
        .withColumn("_known", known)
        .withColumn("_mark", F.when(F.col("_known").isNotNull(), F.struct(F.col("_known").alias("v"), (-F.col("_n")).alias("at"))))
        .withColumn("_now", F.max("_mark").over(so_far))
        .withColumn("_before", F.max("_known").over(previous))
    )
    blocks = rows.groupBy(*blocked).agg(F.max("_mark").alias("_top"), F.max("_n").alias("_rows"))
    # Sparse steps make a block per row: carried on levels, so that a run's blocks do not meet in one task.
    scan = Marks("_rows", "_top", "_offset", "_carry")
    blocks = prefix_scan(blocks, "_block", keys, NUMBER_BITS - bits, scan, level_bits).drop("_top", "_rows")

    top = F.greatest(F.col("_carry"), Marks.shift(F.col("_now"), F.col("_offset")))
    last = F.when(top["v"] > start, -top["at"]).otherwise(F.lit(0))
    return (
        rows.join(blocks, blocked)
        .withColumn("best_before", F.greatest(F.lit(start), F.col("_carry.v"), F.col("_before")))
        .withColumn("improved", F.coalesce(F.col("_known") > F.col("best_before"), F.lit(False)).cast("int"))
        .withColumn("failures", F.col("_offset") + F.col("_n") - last)
        .drop("_block", "_known", "_n", "_mark", "_offset", "_carry", "_before", "_now")
    )


def early_stop(
    log: DataFrame, patience: int = PATIENCE, start: float = START, run: str = "run", bits: int = STEP_BITS
) -> DataFrame:
    """First step of each run with ``patience`` evaluations in a row without improvement."""
    failed = improvements(log, None, start, run, bits).where(F.col("failures") >= patience)
    return failed.groupBy(run).agg(F.min("step").alias("stop_step"))


def interval_mean(log: DataFrame, every: int = LOG_EVERY, run: str = "run") -> DataFrame:
    """Mean value of each stretch of ``every`` steps; the stretch ends at ``step``."""
    return (
        log.withColumn("_interval", F.expr(f"(step - 1) div {int(every)}"))
        .groupBy(run, "_interval")
        .agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
        .select(run, ((F.col("_interval") + 1) * every).alias("step"), "mean_value", "n")
    )


def version_step(name: Column | str, prefix: str = "checkpoint") -> Column:
    """Step in a name like ``checkpoint-1500``; NULL for other names."""
    return F.regexp_extract(name, f".*{prefix}-([0-9]+)", 1).try_cast("long")


def expired(
    versions: DataFrame,
    k: int | None,
    name: str = "name",
    run: str = "run",
    prefix: str = "checkpoint",
    hot_rows: int | None = HOT_ROWS,
    order: str | None = None,
) -> DataFrame:
    """All versions but the newest k of each run; none when k is absent or not positive.

    Newest is the greatest step in the name, or with ``order``, say a time of change, the greatest value of that
    column; then names need no step. Versions without a step, or without a value, are never listed.

    The newest k are found by a limited window, which drops rows in each task before the
    shuffle; the rest is a join with one row per run, in which the rows of a hot run are spread
    over sub-keys (see ``skew``).
    """
    rows = versions.withColumn("step", version_step(name, prefix))
    by = order or "step"
    rows = rows.where(F.col(by).isNotNull() & F.col(name).contains(f"{prefix}-"))
    if not k or k <= 0:
        return rows.limit(0)
    newest = Window.partitionBy(run).orderBy(F.desc(by), F.desc(name))
    kept = (
        rows.select(run, by, name)
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == k)
        .select(run, F.struct(by, name).alias("_oldest_kept"))
    )
    older = F.struct(by, name) < F.col("_oldest_kept")
    joined = join_to_unique(rows, kept, run, "inner", name, hot_rows)
    return joined.where(older).drop("_oldest_kept")


def metric_keys(log: DataFrame, tag: str = "tag", step: str = "step") -> DataFrame:
    """Metric names with their step, as one merged result has them."""
    return log.withColumn("metric", F.concat_ws("_", F.col(tag), F.col(step).cast("string")))


def pivot_metrics(log: DataFrame, ids: Sequence[str], column: str, values: Sequence) -> DataFrame:
    """One column per listed value, holding the mean."""
    return log.groupBy(*ids).pivot(column, list(values)).agg(F.avg("value"))
