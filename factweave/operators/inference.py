"""Calls of a user's text function, model, tokenizer or embedder on Arrow batches."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from factweave.functions.text import single_spaced, words
from factweave.operators.skew import HOT_ROWS, join_to_unique
from factweave.schemas import STOP
from factweave.sources.table import ResultTable

RETRIES = 1  # fixed values: one more call, after a minute
WAIT_SECONDS = 60.0
CALL_BYTES = 4 << 20  # of values which a task holds as Python objects at a time


def _with_retry(call: Callable[[str], str], text: str, retries: int, wait: float) -> str:
    for left in range(retries, -1, -1):
        try:
            return call(text)
        except Exception:
            if left == 0:
                raise
            time.sleep(wait)


def _called(call: Callable[[list], list], values: list, batch_size: int) -> list:
    """Outputs of a batch function in batches; None goes past it and stays None."""
    given = [v for v in values if v is not None]
    out: list = []
    for i in range(0, len(given), batch_size):
        part = given[i : i + batch_size]
        answers = list(call(part))
        if len(answers) != len(part):
            raise ValueError(f"{len(answers)} outputs for {len(part)} inputs")
        out.extend(answers)
    answers = iter(out)
    return [None if v is None else next(answers) for v in values]


def _calls(values: pa.Array, batch_size: int) -> Iterator[pa.Array]:
    """Slices of an Arrow batch for one call each: at most ``batch_size`` values, absent ones not counted, and
    ``CALL_BYTES`` of them, or one value which is larger."""
    given, at = np.cumsum(np.asarray(values.is_valid())), 0
    while at < len(values):
        done = given[at - 1] if at else 0
        part = values.slice(at, int(np.searchsorted(given, done + batch_size, "right")) - at)
        while len(part) > 1 and part.nbytes > CALL_BYTES:
            part = part.slice(0, (len(part) + 1) // 2)
        yield part
        at += len(part)


def _answered(call: Callable[[list], list], batches: Iterator[pa.Array], kind: pa.DataType, batch_size: int) -> Iterator[pa.Array]:
    """Outputs, sent back call by call: a task holds an Arrow batch and the objects of one call, however many rows it has."""
    for batch in batches:
        for part in _calls(batch, batch_size):
            yield pa.array(_called(call, part.to_pylist(), batch_size), kind, from_pandas=True)


@dataclass(frozen=True)
class Request:
    """What a completion is asked with, beside its prompt."""

    model: str = "stub"
    temperature: float = 0.0
    max_tokens: int = 300
    top_p: float = 1.0
    frequency_penalty: float = 0.0
    presence_penalty: float = 0.0
    stop: tuple[str, ...] = (STOP,)

    def text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


#: A log of answers: the key is the hash of the request, of what goes around the prompt, and of the prompt.
ANSWERS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("request", T.StringType()),
        T.StructField("completion", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("asked_at", T.TimestampType()),
    ]
)


def answer_log(spark: SparkSession, path: str, **options) -> ResultTable:
    """The table of all answers and failures, for audits and for ``complete``."""
    return ResultTable(spark, path, ANSWERS, "key", **options)


def _asker(completer: Callable[..., str], request: Request | None, around: tuple[str, str], retries: int, wait: float):
    def ask(prompt: str) -> str:
        text = around[0] + prompt + around[1]
        return _with_retry(completer if request is None else lambda t: completer(t, request), text, retries, wait)

    return ask


def _answer_all(asked: DataFrame, log: ResultTable, ask: Callable[[str], str], request: Request | None, tasks: int | None) -> DataFrame:
    """(_key, completion) of all asked prompts; what the log does not have is asked, and written before it is read.

    Prompts are dealt by the bucket of their key and the tasks which ask them write the log, so that no later
    stage runs a call again. A call which fails on every try is logged as an error and ends the calls of its
    task; its answers so far are kept. Then the job fails, and a new run asks only what has no answer.
    """
    known = log.read().where(F.col("completion").isNotNull()).select(F.col("key").alias("_key"), "completion")
    todo = asked.join(known, "_key", "left_anti").select(F.col("_key").alias("key"), F.col("_prompt").alias("prompt"))
    names, model = ANSWERS.names, request.model if request else None
    described = request.text() if request else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = False
        for batch in batches:
            rows: list[tuple] = []
            for key, prompt, bucket in zip(batch["key"], batch["prompt"], batch["bucket"], strict=True):
                if failed:
                    break
                answer = error = None
                try:
                    answer = ask(prompt)
                except Exception as problem:  # logged; the job fails once all answers are written
                    failed, error = True, f"{type(problem).__name__}: {problem}"
                rows.append((key, prompt, model, described, answer, error, pd.Timestamp.now(tz="UTC"), bucket))
            yield pd.DataFrame(rows, columns=[*names, "bucket"])

    schema = T.StructType([*ANSWERS, T.StructField("bucket", T.IntegerType())])
    log.append(log.dealt(todo, tasks).mapInPandas(run, schema), dealt=True)
    answers = log.read()
    lacking = asked.join(answers.where(F.col("completion").isNotNull()).select(F.col("key").alias("_key")), "_key", "left_anti")
    if lacking.limit(1).count():
        last = answers.where(F.col("error").isNotNull()).orderBy(F.desc("asked_at")).select("error").first()
        raise RuntimeError(f"prompts without an answer; last error: {last.error if last else 'none logged'}")
    found = answers.where(F.col("completion").isNotNull())
    return found.groupBy(F.col("key").alias("_key")).agg(F.min("completion").alias("completion"))


def complete(
    df: DataFrame,
    prompt: str,
    completer: Callable[..., str],
    retries: int = RETRIES,
    wait: float = WAIT_SECONDS,
    name: str = "completion",
    prefix: str = "",
    suffix: str = "",
    parallel_calls: int | None = None,
    request: Request | None = None,
    log: str | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add the completion of each row's prompt.

    Equal prompts are asked once: they collapse before the shuffle, and the answers are joined
    back. Rows without a prompt get keys of their own and are spread over all tasks; rows of a prompt with
    ``hot_rows`` rows or more are spread over sub-keys, which takes a count of the keys: with ``log`` it is made by default,
    without it only if asked for, and the adaptive split of skewed partitions is relied on, as both sides come fresh from
    a shuffle. Prompts meet by their SHA-256, so that the joins compare hashes. ``prefix`` and ``suffix`` go around the text on the worker, so the few-shot
    blocks are neither shuffled nor compared. ``parallel_calls`` bounds the calls at a time. With ``request`` the
    completer is called with it as a second argument.

    With ``log``, the path of an ``answer_log``, answers are asked for and written now, before the join, and the
    plan returned only reads them: a retried stage, a lost executor or a new run asks nothing twice that was
    answered for the same request, prefix and suffix. Without it the calls are part of the plan: a call
    which fails on every try fails its task, which Spark then runs again.
    """
    scope = hashlib.sha256(json.dumps([request and request.text(), prefix, suffix]).encode()).hexdigest()
    key = F.sha2(F.concat(F.lit(scope), F.col(prompt)), 256)
    asked = df.where(F.col(prompt).isNotNull()).select(key.alias("_key"), F.col(prompt).alias("_prompt")).distinct()
    ask = _asker(completer, request, (prefix, suffix), retries, wait)
    if log is not None:
        answers = _answer_all(asked, answer_log(df.sparkSession, log), ask, request, parallel_calls)
        answers, hot_rows = answers.withColumnRenamed("completion", name), hot_rows or HOT_ROWS
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"_key": batch["_key"], name: [ask(text) for text in batch["_prompt"]]})

        dealt = asked.repartition(parallel_calls, "_key") if parallel_calls else asked
        answers = dealt.mapInPandas(run, T.StructType([T.StructField("_key", T.StringType()), T.StructField(name, T.StringType())]))
    # A key without a prompt is no hash, so it meets no answer.
    keyed = df.withColumn("_key", F.coalesce(key, F.concat(F.lit("none "), F.xxhash64(*df.columns).cast("string"))))
    return join_to_unique(keyed, answers, "_key", "left", min_rows=hot_rows).select(*df.columns, name)


def generate(
    df: DataFrame,
    text: str,
    make_predict: Callable[[], Callable[[list[str]], list[str]]],
    batch_size: int = 64,
    name: str = "generated",
) -> DataFrame:
    """Add a model's output text. ``make_predict`` runs once per Python worker task and
    returns the function for a batch of texts, so a model is loaded once and not per batch."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _answered(make_predict(), batches, pa.string(), batch_size)

    return df.withColumn(name, run(F.col(text)))


def generate_lists(
    df: DataFrame,
    texts: str,
    make_predict: Callable[[], Callable[[list[str]], list[str]]],
    batch_size: int = 64,
    name: str = "generated",
) -> DataFrame:
    """The same for a list column: list in, list of outputs out, no explode and no shuffle."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = make_predict()
        for batch in batches:
            for part in _calls(batch, len(batch)):
                lists = part.to_pylist()
                flat = [text for x in lists if x for text in x]
                answers = iter(_called(predict, flat, batch_size))
                yield pa.array([None if x is None else [next(answers) for _ in x] for x in lists], pa.list_(pa.string()))

    return df.withColumn(name, run(F.col(texts)))


def generate_candidates(
    df: DataFrame,
    text: str,
    make_predict: Callable[[], Callable[[list[str]], list[list[str]]]],
    batch_size: int = 64,
) -> DataFrame:
    """One row per candidate: a model which returns n texts for each input text adds
    ``cand_idx`` 0 .. n-1 and ``prediction``."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _answered(make_predict(), batches, pa.list_(pa.string()), batch_size)

    return df.select("*", F.posexplode(run(F.col(text))).alias("cand_idx", "prediction"))


def _mapped(
    df: DataFrame, column: str, make: Callable[[], Callable[[list], list]], kind: str, name: str, batch_size: int
) -> DataFrame:
    arrow = to_arrow_type(T.DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        call = make()

        def listed(values: list) -> list:
            return [v if v is None or isinstance(v, str) else list(v) for v in call(values)]

        return _answered(listed, batches, arrow, batch_size)

    return df.withColumn(name, run(F.col(column)))


def with_ids(
    df: DataFrame,
    text: str,
    make_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]],
    name: str = "input_ids",
    batch_size: int = 1_024,
) -> DataFrame:
    """Add token ids from a user's tokenizer, made once per task; no ids for no text."""
    return _mapped(df, text, make_tokenizer, "array<int>", name, batch_size)


def with_text(
    df: DataFrame,
    ids: str,
    make_decoder: Callable[[], Callable[[list[list[int]]], list[str]]],
    name: str = "text",
    batch_size: int = 1_024,
) -> DataFrame:
    """Add the texts of token ids from a user's decoder, made once per task: predictions and labels
    come as ids. Label ids go through ``strip_pad`` first, texts through ``clean_decoded`` after."""
    return _mapped(df, ids, make_decoder, "string", name, batch_size)


def with_embedding(
    df: DataFrame,
    text: str,
    make_embedder: Callable[[], Callable[[list[str]], list[list[float]]]],
    name: str = "embedding",
    batch_size: int = 1_024,
) -> DataFrame:
    """Add vectors from a user's embedder, made once per task; no vector for no text."""
    return _mapped(df, text, make_embedder, "array<float>", name, batch_size)


def word_tokens(c: Column | str) -> Column:
    """Stand-in for a tokenizer, without Python: the words between white space."""
    return words(single_spaced(c))
