"""Question corpora: reading, placing, registering."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions.text import split_facts, strip
from factweave.operators.examples import parser_examples
from factweave.schemas import QUESTIONS
from factweave.session import work_dir


# Sub-sentences in JSON are a list or one text: as STRING Spark gives the list's JSON text.
_LISTS = ("synthesis_question_sub_sentences", "nature_question_sub_sentences")
_ENTRIES = "synthesis_question_paraphrases_sub_sentences"
_JSON_TYPES = {
    **{c: T.StringType() for c in _LISTS},
    _ENTRIES: T.ArrayType(
        T.StructType(
            [T.StructField("paraphrase", T.StringType()), T.StructField("sub_sentences", T.StringType())]
        )
    ),
}
JSON_QUESTIONS = T.StructType(
    [T.StructField(f.name, _JSON_TYPES.get(f.name, f.dataType)) for f in QUESTIONS.fields]
)


def _as_list(c: Column) -> Column:
    """The entry as a list; NULL if it is a text, which may well start with a bracket."""
    return F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(c, "array<string>", {"mode": "PERMISSIVE"}))


def _lines(c: Column) -> Column:
    """A list, or one text split at the separators."""
    return F.coalesce(_as_list(c), split_facts(strip(c)))


def _one_form(raw: DataFrame) -> DataFrame:
    """Sub-sentences as lists. A natural question's text stays a text, in its own column,
    since a ready text keeps its backslashes and a joined list does not."""
    natural = F.col("nature_question_sub_sentences")
    text = F.when(_as_list(natural).isNull(), natural)

    def entry(e: Column) -> Column:
        lines = _lines(e["sub_sentences"]).alias("sub_sentences")
        return F.when(e.isNotNull(), F.struct(e["paraphrase"].alias("paraphrase"), lines))

    return raw.withColumns(
        {
            "synthesis_question_sub_sentences": _lines(F.col("synthesis_question_sub_sentences")),
            "nature_question_sub_sentences": _as_list(natural),
            "nature_question_sub_sentences_text": F.coalesce("nature_question_sub_sentences_text", text),
            _ENTRIES: F.transform(_ENTRIES, entry),
        }
    )


def read_questions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Question records from JSON Lines, Parquet or ORC with an explicit schema; a record's
    missing entry is NULL, a broken JSON line fails the job."""
    if fmt == "json":
        return _one_form(_json(spark, path))
    if fmt not in ("parquet", "orc"):
        raise ValueError(f"unknown format {fmt!r}")
    return spark.read.schema(QUESTIONS).format(fmt).load(path)


def _json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JSON_QUESTIONS).option("mode", "FAILFAST").json(path)


SCAN_TASKS = "spark.factweave.scanTasks"


def spread(df: DataFrame, *key: str) -> DataFrame:
    """A scan dealt out by a unique key over the number of tasks in the setting ``SCAN_TASKS``.

    For corpora of few coarse files, which Spark reads in fewer tasks than there are cores. Unset, as
    it should be on a corpus of many files, nothing is shuffled.
    """
    tasks = df.sparkSession.conf.get(SCAN_TASKS, None)
    return df.repartition(int(tasks), *key) if tasks else df


PIECES_BYTES = 256 << 20  # of a broadcast table of pieces, some millions of them
_PIECE = ("_file", "_from")


def _pieces(placed: DataFrame) -> DataFrame:
    """Of each piece of a file which a task reads: its rows, those with a place of their own, and the least read number."""
    counts = (F.count("*").alias("_rows"), F.count("ord").alias("_given"), F.min("_read").alias("_first"))
    return placed.groupBy(*_PIECE).agg(*counts)


def _in_file_order(placed: DataFrame, pieces: DataFrame, size: int) -> DataFrame:
    """Number rows 0, 1, ... by file name, then by place in the file.

    Spark reads large files first and in any order, and a task may read several pieces, one after the other. So a row's
    place inside its piece is its read number less the piece's first one, and the place of the piece comes from a
    window over pieces, one row each. Rows stay where they are read: the table of pieces is broadcast up to
    ``PIECES_BYTES``; a longer one is left to Spark's join. A row outside of its piece, which another way of
    reading the same files would give, fails the job.
    """
    before = Window.orderBy(*_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_given")
    numbered = placed.join(F.broadcast(starts) if size <= PIECES_BYTES else starts, list(_PIECE))
    inside = F.col("_read") - F.col("_first")
    fits = (inside >= 0) & (inside < F.col("_rows"))
    place = F.when(fits, F.col("_start") + inside).otherwise(F.raise_error(F.lit("files were read in other pieces")))
    return numbered.withColumn("ord", place.cast("long")).drop(*_PIECE, "_read", "_rows", "_first", "_start")


def ingest_questions(spark: SparkSession, path: str, out: str, fmt: str = "json") -> DataFrame:
    """Store a corpus once as Parquet by dataset and split, with a place for each record.

    Either every record brings its ``ord``, and no two the same, or none does and they are numbered in
    file order; anything else is an error. The number is written with the rows.
    """
    raw = _json(spark, path) if fmt == "json" else read_questions(spark, path, fmt)
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from")]
    placed = raw.select("*", *where, F.monotonically_increasing_id().alias("_read"))
    folder = f"{work_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    try:
        found = _pieces(placed)
        found.write.parquet(folder)
        pieces = spark.read.schema(found.schema).parquet(folder)
        size = F.sum(F.octet_length("_file") + 40).alias("size")
        seen = pieces.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("all"), F.coalesce(F.sum("_given"), F.lit(0)).alias("given"), size).first()
        if seen.given and seen.given < seen["all"]:
            raise ValueError(f"{seen.given} of {seen['all']} records have a place of their own; all or none may")
        rows = read_questions(spark, path, fmt)
        if seen.given:
            twice = rows.groupBy("ord").count().where("count > 1").first()
            if twice:
                raise ValueError(f"place {twice.ord} is given {twice['count']} times")
        else:
            rows = _in_file_order(_one_form(placed) if fmt == "json" else placed, pieces, seen["size"] or 0).select(*QUESTIONS.names)
        return _stored(spark, rows, out)
    finally:
        path_ = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path_.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path_, True)


def _stored(spark: SparkSession, rows: DataFrame, out: str) -> DataFrame:
    rows = rows.withColumn("item_id", F.coalesce("item_id", F.col("ord").cast("string")))
    rows.write.mode("errorifexists").partitionBy("dataset", "split").parquet(out)
    return spark.read.schema(QUESTIONS).parquet(out)


@dataclass
class Registry:
    """Where the splits of each dataset are and, if the caller limits one, how many examples are used.

    ``root`` is a folder as ``ingest_questions`` writes it; a filter on dataset and split
    then reads their folder only. Single splits may lie elsewhere.
    """

    root: str | None = None
    entries: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)
    limits: dict[tuple[str, str], int] = field(default_factory=dict)

    def register(self, name: str, mode: str, path: str, fmt: str = "parquet", limit: int = 0) -> None:
        self.entries[name, mode] = (path, fmt)
        if limit:
            self.limits[name, mode] = limit

    def dataset(self, spark: SparkSession, name: str, mode: str) -> DataFrame:
        """All records of one split."""
        if mode not in ("train", "dev", "test"):
            raise ValueError(f"unknown mode {mode!r}")
        if (name, mode) in self.entries:
            path, fmt = self.entries[name, mode]
            return read_questions(spark, path, fmt)
        if self.root is None:
            raise KeyError((name, mode))
        rows = read_questions(spark, self.root, "parquet")
        return rows.where((F.col("dataset") == name) & (F.col("split") == mode))

    def parser_examples(
        self, spark: SparkSession, name: str, mode: str, form: str = "plain"
    ) -> DataFrame:
        """Examples of one split, cut to the number which is set for it."""
        limit = self.limits.get((name, mode), 0)
        return parser_examples(self.dataset(spark, name, mode), mode, form, num_examples=limit)
