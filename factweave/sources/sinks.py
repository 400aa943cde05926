"""Tables and reports which a run leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE = "=" * 20  # fixed values: first line of a report block and its labels
REPORT = (
    ("synthetic :", "synthesis_question"),
    ("natural   :", "nature_question"),
    ("question  :", "question"),
    ("prediction:", "prediction"),
    ("gold      :", "answer"),
)


def eval_records(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, "question", "prediction", "answer")


def write_records(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Question, prediction and answer of each evaluated row."""
    eval_records(df).write.mode(mode).format(fmt).save(path)


def report_lines(records: DataFrame, items: DataFrame, key: str = "ord") -> DataFrame:
    """One text block of seven lines per record, with both questions of its source item."""
    joined = records.join(items.select(key, "synthesis_question", "nature_question"), key)
    equal = F.when(F.col("prediction") == F.col("answer"), "True").otherwise("False")
    lines = [F.concat(F.lit(label), F.coalesce(F.col(c), F.lit("None"))) for label, c in REPORT]
    return joined.select(key, F.concat_ws("\n", F.lit(RULE), *lines, equal).alias("value"))


def write_report(lines: DataFrame, path: str, key: str = "ord") -> None:
    """Text files whose names and lines follow the key."""
    lines.orderBy(key).select("value").write.text(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append (run, step, tag, value) rows to a log table."""
    rows.select("run", "step", "tag", "value").write.mode("append").parquet(path)
