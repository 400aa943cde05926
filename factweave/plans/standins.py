"""Question records, predictions, candidates and logs read from the given tables.

The given tables hold no question corpus, so each record of the corpus is built from one row
of a table (or one short block of rows). Every view has its text in standard SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.text import join_facts
from factweave.sources.corpus import spread


def table(spark: SparkSession, folder: str, name: str, *key: str) -> DataFrame:
    """A given table; with a key its rows are spread over all cores if the scan is coarse."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows, *key) if key else rows


def _cat(*parts: str) -> F.Column:
    """Concatenate columns (names in braces) and literal texts."""
    return F.concat(
        *[F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts]
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question record per order; decompositions absent, rejected, as lines or as text."""
    rows = table(spark, folder, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("ord"),
        F.col("o_orderkey").cast("string").alias("item_id"),
        F.col("o_orderstatus").alias("dataset"),
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        (3 + F.col("o_custkey") % 9).alias("e"),
        (1 + F.floor("o_totalprice") % 7).cast("int").alias("n_facts"),
    )
    facts = F.array(
        _cat("FACT1: ENTITY1 is order ", "{ord}", "."),
        _cat("FACT2: ENTITY2 is customer ", "{o_custkey}", "."),
        F.lit("FACT3: ENTITY2 placed ENTITY1."),
        _cat("FACT4: ENTITY1\\'s status is ", "{o_orderstatus}", "."),
        _cat("FACT5: ENTITY", "{e}", " is the priority ", "{o_orderpriority}", "."),
        _cat("FACT6: ENTITY1 has ENTITY", "{e}", "."),
        F.lit("FACT7: FACT4 or FACT6."),
    )
    asked = F.when(F.col("n_facts") >= 3, "Question: Which clerk took the order of FACT3?").otherwise(
        "Question: How many ENTITY1?"
    )
    rows = rows.withColumn("lines", F.concat(F.slice(facts, F.lit(1), F.col("n_facts")), F.array(asked)))
    priority = F.substring("o_orderpriority", 1, 1)
    none = F.array().cast("array<string>")
    lines = F.when(priority == "2", none).when(priority.isin("1", "5"), F.col("lines"))
    return rows.select(
        "ord",
        "item_id",
        "dataset",
        F.when(priority == "1", "dev").when(priority == "5", "test").otherwise("train").alias("split"),
        _cat("  how many orders of customer ", "{o_custkey}", " have status ", "{o_orderstatus}", "\t").alias(
            "synthesis_question"
        ),
        _cat(" Which order did the customer ", "{o_custkey}", " place first? \n").alias("nature_question"),
        _cat(" Find(order ", "{ord}", ") Filter(priority, ", "{o_orderpriority}", ") Count() ").alias("program"),
        F.when(priority != "3", F.col("lines")).alias("synthesis_question_sub_sentences"),
        lines.alias("nature_question_sub_sentences"),
        F.when(priority == "3", F.concat(F.lit(" "), join_facts("lines"), F.lit(" "))).alias(
            "nature_question_sub_sentences_text"
        ),
        "n_facts",
        "lines",
    )


QUESTIONS_SQL = r"""questions AS (
  SELECT *,
    CASE p WHEN '1' THEN 'dev' WHEN '5' THEN 'test' ELSE 'train' END AS split,
    '  how many orders of customer ' || o_custkey || ' have status ' || o_orderstatus || chr(9) AS synthesis_question,
    ' Which order did the customer ' || o_custkey || ' place first? ' || chr(10) AS nature_question,
    ' Find(order ' || ord || ') Filter(priority, ' || o_orderpriority || ') Count() ' AS program,
    CASE WHEN p <> '3' THEN lines END AS synthesis_question_sub_sentences,
    CASE WHEN p = '2' THEN [] WHEN p IN ('1', '5') THEN lines END AS nature_question_sub_sentences,
    CASE WHEN p = '3' THEN ' ' || replace(array_to_string(lines, ' <FACT-SEP> '), '\', '') || ' ' END
      AS nature_question_sub_sentences_text
  FROM (
    SELECT *, list_concat(
      list_slice([
        'FACT1: ENTITY1 is order ' || ord || '.',
        'FACT2: ENTITY2 is customer ' || o_custkey || '.',
        'FACT3: ENTITY2 placed ENTITY1.',
        'FACT4: ENTITY1\''s status is ' || o_orderstatus || '.',
        'FACT5: ENTITY' || e || ' is the priority ' || o_orderpriority || '.',
        'FACT6: ENTITY1 has ENTITY' || e || '.',
        'FACT7: FACT4 or FACT6.'], 1, n_facts),
      [CASE WHEN n_facts >= 3 THEN 'Question: Which clerk took the order of FACT3?'
            ELSE 'Question: How many ENTITY1?' END]) AS lines
    FROM (
      SELECT o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS item_id, o_orderstatus AS dataset,
        o_custkey, o_orderstatus, o_orderpriority, 3 + o_custkey % 9 AS e,
        substr(o_orderpriority, 1, 1) AS p,
        CAST(1 + CAST(floor(o_totalprice) AS BIGINT) % 7 AS INTEGER) AS n_facts
      FROM orders)))"""


def completions(spark: SparkSession, folder: str) -> DataFrame:
    """Raw completions: all documents, and the decompositions with blank lines between."""
    docs = table(spark, folder, "documents", "doc_id").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("item_id"),
        F.concat("text", F.lit("\nsentence:\nnext one")).alias("completion"),
    )
    made = questions(spark, folder).select(
        F.concat(F.lit("o"), "item_id").alias("item_id"),
        F.concat(F.lit("\n "), F.array_join("lines", " \n\n\t"), F.lit("\n\nsentence:\nnext one")).alias(
            "completion"
        ),
    )
    return docs.unionByName(made)


COMPLETIONS_SQL = (
    QUESTIONS_SQL
    + r""",
completions AS (
  SELECT 'd' || doc_id AS item_id, text || chr(10) || 'sentence:' || chr(10) || 'next one' AS completion
  FROM documents
  UNION ALL
  SELECT 'o' || item_id, chr(10) || ' ' || array_to_string(lines, ' ' || chr(10) || chr(10) || chr(9))
    || chr(10) || chr(10) || 'sentence:' || chr(10) || 'next one' FROM questions)"""
)

TURNS = 10  # paraphrases of one item


def paraphrase_items(spark: SparkSession, folder: str) -> DataFrame:
    """One item per ten turns of a conversation, the turns as its paraphrases.

    One aggregate per place keeps the state of a group fixed however long a conversation is.
    """
    turns = table(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.expr(f"turn div {TURNS}").cast("string")).alias(
            "item_id"
        ),
        (F.col("turn") % TURNS).alias("place"),
        "text",
    )
    places = [F.max(F.when(F.col("place") == i, F.col("text"))).alias(f"_{i}") for i in range(TURNS)]
    return turns.groupBy("item_id").agg(*places).select(
        "item_id",
        F.array_compact(F.array(*[f"_{i}" for i in range(TURNS)])).alias("paraphrases"),
    )


PARAPHRASES_SQL = f"""paraphrase_items AS (
  SELECT conv_id || '-' || (turn // {TURNS}) AS item_id, list(text ORDER BY turn) AS paraphrases
  FROM conversations GROUP BY 1)"""


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn as the truth, the turn after it as the prediction."""
    turns = table(spark, folder, "conversations")
    spread_turns = table(spark, folder, "conversations", "conv_id", "turn")
    asked = spread_turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("answer")
    )
    following = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction")
    )
    return asked.join(following, ["conv_id", "turn"])


PAIRS_SQL = """pairs AS (
  SELECT a.conv_id, a.turn, b.text AS prediction, a.text AS answer
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user')"""


def score_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of turns, and every turn with a near copy of itself."""
    near = table(spark, folder, "conversations", "conv_id", "turn").select(
        F.lit("copy").alias("kind"),
        "conv_id",
        "turn",
        F.regexp_replace(F.col("text"), ", ", " the ").alias("prediction"),
        F.col("text").alias("answer"),
    )
    return turn_pairs(spark, folder).select(
        F.lit("next").alias("kind"), "conv_id", "turn", "prediction", "answer"
    ).unionByName(near)


SCORE_PAIRS_SQL = (
    PAIRS_SQL
    + """,
score_pairs AS (
  SELECT 'next' AS kind, conv_id, turn, prediction, answer FROM pairs
  UNION ALL
  SELECT 'copy', conv_id, turn, replace(text, ', ', ' the '), text FROM conversations)"""
)


def document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents: each with a changed copy of itself, and with the next document."""
    docs = table(spark, folder, "documents", "doc_id").select("doc_id", "text")
    changed = F.replace(F.replace("text", F.lit(" de "), F.lit(" des ")), F.lit(". "), F.lit(" . "))
    near = docs.select(
        F.lit("copy").alias("kind"), "doc_id", F.col("text").alias("prediction"), changed.alias("answer")
    )
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("answer"))
    pairs = docs.withColumnRenamed("text", "prediction").join(following, "doc_id")
    return near.unionByName(pairs.select(F.lit("next").alias("kind"), "doc_id", "prediction", "answer"))


DOCUMENT_PAIRS_SQL = """document_pairs AS (
  SELECT 'copy' AS kind, doc_id, text AS prediction,
    replace(replace(text, ' de ', ' des '), '. ', ' . ') AS answer FROM documents
  UNION ALL
  SELECT 'next', a.doc_id, a.text, b.text FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""


def turn_candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """First turn of a conversation as the truth, all other turns as candidates."""
    turns = table(spark, folder, "conversations", "conv_id", "turn")
    truths = turns.where(F.col("turn") == 0).select(
        F.col("conv_id").alias("example_id"), F.col("text").alias("answer")
    )
    candidates = turns.where(F.col("turn") > 0).select(
        F.col("conv_id").alias("example_id"),
        F.col("turn").cast("int").alias("cand_idx"),
        F.col("text").alias("prediction"),
    )
    return candidates, truths


CANDIDATES_SQL = """cands AS (
  SELECT c.conv_id AS example_id, CAST(c.turn AS INTEGER) AS cand_idx, c.text AS prediction, t.text AS answer
  FROM conversations c JOIN conversations t ON t.conv_id = c.conv_id AND t.turn = 0 AND c.turn > 0)"""

GROUP = 6  # a question vector and its candidates


def vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Of six vectors in a row the first is the question's, the others the candidates'."""
    rows = table(spark, folder, "embeddings").select(
        F.expr(f"vec_id div {GROUP}").alias("example_id"),
        (F.col("vec_id") % GROUP).cast("int").alias("cand_idx"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("prediction"),
        "embedding",
    )
    asked = rows.where(F.col("cand_idx") == 0).select(
        "example_id", F.col("embedding").alias("question_embedding")
    )
    return rows.where(F.col("cand_idx") > 0), asked


VECTORS_SQL = f"""vecs AS (
  SELECT c.vec_id // {GROUP} AS example_id, CAST(c.vec_id % {GROUP} AS INTEGER) AS cand_idx,
    'vector ' || c.vec_id AS prediction,
    list_transform(c.embedding, lambda x: CAST(x AS DOUBLE)) AS v,
    list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)) AS q
  FROM embeddings c JOIN embeddings q ON q.vec_id = c.vec_id - c.vec_id % {GROUP}
  WHERE c.vec_id % {GROUP} > 0)"""


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a metric log: a user is a run, the event's number its step."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("tag"),
        "value",
    )


RUN_LOG_SQL = """runlog AS (
  SELECT user_id AS run, event_id AS step, event_type AS tag, value FROM events)"""
