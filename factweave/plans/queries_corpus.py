"""Queries over records: joins, order, examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.text import decomposition_text, first_paraphrase, question_column
from factweave.operators import examples as ex
from factweave.operators import joins, order
from factweave.operators.inference import word_tokens
from factweave.plans import sqltext as q
from factweave.plans import standins as v
from factweave.plans.registry import query


def _documents(spark, folder):
    return v.table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text")


def _done(spark, folder):
    return v.table(spark, folder, "labels")


@query("pending_anti", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti(spark, folder):
    items = _documents(spark, folder).select("doc_id", "n_chars")
    return joins.pending(items, _done(spark, folder), "doc_id", hot_rows=None)  # ids are unique


@query("completed_semi", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def completed_semi(spark, folder):
    items = _documents(spark, folder).select("doc_id", "n_chars")
    return joins.completed(items, _done(spark, folder), "doc_id", hot_rows=None)


@query(
    "attach_left",
    "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def attach_left(spark, folder):
    items = _documents(spark, folder).select("doc_id", "n_chars")
    return joins.attach(items, _done(spark, folder), "doc_id", hot_rows=None)


@query(
    "shard_scan",
    "SELECT o_orderkey AS ord, o_custkey FROM orders WHERE o_orderkey >= 500 AND o_orderkey < 12000",
)
def shard_scan(spark, folder):
    rows = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("ord"), "o_custkey")
    return order.shard(rows, 500, 12_000)


@query("head_limit", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 300")
def head_limit(spark, folder):
    return order.head_n(_documents(spark, folder).select("doc_id", "text"), 300, "doc_id")


@query(
    "positional_split",
    """SELECT ord, mode FROM (
         SELECT ord, CASE WHEN i <= 5000 THEN 'train' WHEN i <= 5300 THEN 'dev' END AS mode
         FROM (SELECT o_orderkey AS ord, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders))
       WHERE mode IS NOT NULL""",
)
def positional_split(spark, folder):
    rows = v.table(spark, folder, "orders").select(F.col("o_orderkey").alias("ord"))
    train = ex.decomposer_split(rows, 0, 5_000).withColumn("mode", F.lit("train"))
    dev = ex.decomposer_split(rows, 5_000, 5_300).withColumn("mode", F.lit("dev"))
    return train.unionByName(dev)


_SPARSE = (2_654_435_761, (1 << 61) - 1)  # places all over the range of a long, no two the same


@query(
    "stride_sample",
    f"""SELECT doc_id, n_chars FROM (
         SELECT doc_id, n_chars, row_number() OVER (ORDER BY (doc_id * {_SPARSE[0]}) % {_SPARSE[1]}) - 1 AS i FROM documents)
       WHERE i % 20 = 0""",
)
def stride_sample(spark, folder):
    place = (F.col("doc_id") * _SPARSE[0] % _SPARSE[1]).alias("place")
    return order.stride(_documents(spark, folder).select("doc_id", "n_chars", place), 20, "place").drop("place")


@query(
    "running_cap",
    "SELECT doc_id, text FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 200",
)
def running_cap(spark, folder):
    rows = _documents(spark, folder)
    return order.cap_matching(rows, F.col("lang") == "en", 200, "doc_id").select("doc_id", "text")


@query(
    "seeded_shuffle",
    "SELECT item_id, text, md5('666:' || item_id) AS shuffle_key FROM benchmark",
)
def seeded_shuffle(spark, folder):
    return order.seeded_shuffle(v.table(spark, folder, "benchmark"), "item_id")


@query(
    "epoch_order",
    """SELECT doc_id, CAST(row_number() OVER (ORDER BY md5('666/1:' || doc_id)) - 1 AS BIGINT) AS place
       FROM documents""",
)
def epoch_order(spark, folder):
    rows = _documents(spark, folder).select("doc_id")
    return order.epoch_order(rows, "doc_id", 666, 1, name="place")


@query(
    "question_key",
    f"WITH {v.QUESTIONS_SQL} SELECT ord, split, "
    "CASE WHEN split = 'dev' THEN synthesis_question ELSE nature_question END AS question FROM questions",
)
def question_key(spark, folder):
    return v.questions(spark, folder).select("ord", "split", question_column("split").alias("question"))


@query("first_paraphrase", f"WITH {v.PARAPHRASES_SQL} SELECT item_id, paraphrases[1] AS sentence FROM paraphrase_items")
def first_of_paraphrases(spark, folder):
    return v.paraphrase_items(spark, folder).select("item_id", first_paraphrase("paraphrases").alias("sentence"))


@query(
    "paraphrase_explode",
    f"""WITH {v.PARAPHRASES_SQL}
        SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, paraphrases[i] AS paraphrase
        FROM (SELECT item_id, paraphrases, unnest(range(1, least(len(paraphrases), 5) + 1)) AS i FROM paraphrase_items)""",
)
def paraphrase_explode(spark, folder):
    return ex.explode_paraphrases(v.paraphrase_items(spark, folder), "paraphrases", 5)


@query(
    "paraphrase_regroup",
    f"""WITH {v.PARAPHRASES_SQL}
        SELECT item_id, len(paraphrases[1:5]) AS n_results,
          array_to_string(list_transform(paraphrases[1:5], lambda p: p || ' => ' || length(p)), chr(10)) AS results
        FROM paraphrase_items""",
)
def paraphrase_regroup(spark, folder):
    rows = ex.explode_paraphrases(v.paraphrase_items(spark, folder), "paraphrases", 5)
    answer = {
        "paraphrase": F.col("paraphrase"),
        "answer": F.length("paraphrase").cast("string"),
    }
    grouped = ex.regroup(rows, "item_id", 5, answer)
    shown = F.transform("results", lambda r: F.concat_ws(" => ", r["paraphrase"], r["answer"]))
    return grouped.select("item_id", "n_results", F.array_join(shown, "\n").alias("results"))


@query(
    "presence_filter",
    f"""WITH {v.QUESTIONS_SQL} SELECT ord, split FROM questions
        WHERE nature_question_sub_sentences IS NOT NULL OR nature_question_sub_sentences_text IS NOT NULL""",
)
def presence_filter(spark, folder):
    return ex.where_present(
        v.questions(spark, folder), "nature_question_sub_sentences", "nature_question_sub_sentences_text"
    ).select("ord", "split")


@query(
    "nonempty_filter",
    f"""WITH {v.QUESTIONS_SQL} SELECT ord, array_to_string(nature_question_sub_sentences, chr(10)) AS lines
        FROM questions WHERE len(nature_question_sub_sentences) > 0""",
)
def nonempty_filter(spark, folder):
    return ex.where_nonempty(v.questions(spark, folder), "nature_question_sub_sentences").select(
        "ord", F.array_join("nature_question_sub_sentences", "\n").alias("lines")
    )


@query(
    "length_filter",
    rf"""SELECT doc_id, len(i) AS n_input, len(o) AS n_output FROM (
           SELECT doc_id, {q.words(r"regexp_replace(text, '\s+', ' ', 'g')")} AS i,
             string_split(text, chr(10)) AS o FROM documents)
         WHERE len(i) < 300 AND len(o) < 6""",
)
def length_filter(spark, folder):
    rows = _documents(spark, folder).select(
        "doc_id",
        word_tokens("text").alias("input_ids"),
        F.split("text", "\n").alias("output_ids"),
    )
    return ex.length_filter(rows, 300, 6).select(
        "doc_id",
        F.size("input_ids").cast("long").alias("n_input"),
        F.size("output_ids").cast("long").alias("n_output"),
    )


@query(
    "decomposer_examples",
    f"""WITH {v.QUESTIONS_SQL}
        SELECT ord, {q.strip('synthesis_question')} AS input, {q.join_facts('synthesis_question_sub_sentences')} AS output
        FROM questions WHERE len(synthesis_question_sub_sentences) > 0""",
)
def decomposer_examples(spark, folder):
    return ex.decomposer_examples(
        v.questions(spark, folder), "synthesis_question", "synthesis_question_sub_sentences"
    )


_DECOMPOSITION = (
    f"CASE WHEN nature_question_sub_sentences IS NOT NULL THEN {q.join_facts('nature_question_sub_sentences')} "
    f"ELSE {q.strip('nature_question_sub_sentences_text')} END"
)
_PRESENT = "(nature_question_sub_sentences IS NOT NULL OR nature_question_sub_sentences_text IS NOT NULL)"


def _parser_sql(form: str) -> str:
    asked = _DECOMPOSITION if form == "decomposition" else q.strip("nature_question")
    dev = f"split = 'dev' AND {_PRESENT}" if form == "decomposition" else "split = 'dev'"
    return f"""WITH {v.QUESTIONS_SQL},
    chosen AS (
      SELECT * FROM questions WHERE split IN ('train', 'test') AND {_PRESENT}
      UNION ALL SELECT * FROM questions WHERE {dev})
    SELECT ord, split, {asked} AS question, {q.strip('program')} AS program FROM chosen"""


def _parser_examples(form):
    def build(spark, folder):
        rows = v.questions(spark, folder)
        parts = [
            ex.parser_examples(rows.where(F.col("split") == mode), mode, form, keep=("split",))
            for mode in ("train", "dev", "test")
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return build


query("parser_examples", _parser_sql("decomposition"))(_parser_examples("decomposition"))
query("parser_examples_plain", _parser_sql("plain"))(_parser_examples("plain"))


@query("union_normalise", f"WITH {v.QUESTIONS_SQL} SELECT ord, {_DECOMPOSITION} AS decomposition FROM questions")
def union_normalise(spark, folder):
    return v.questions(spark, folder).select(
        "ord",
        decomposition_text("nature_question_sub_sentences", "nature_question_sub_sentences_text").alias(
            "decomposition"
        ),
    )
