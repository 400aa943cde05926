"""Queries over batches and calls of user functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factweave.functions.text import join_facts
from factweave.operators import inference, order
from factweave.plans import sqltext as q
from factweave.plans import standins as v
from factweave.plans.evaluation import decoded, truth_ids
from factweave.plans.few_shot import decompose
from factweave.plans.queries_text import EXAMPLE_BLOCKS
from factweave.plans.registry import query
from factweave.plans.results import read_done
from factweave.plans.trained import decompose_exploded, decompose_questions
from factweave.session import work_dir
from factweave.streaming.incremental import decompose_stream

SIZE = 10

_BATCHED_SQL = f"""{v.QUESTIONS_SQL}, batched AS (
    SELECT ord, synthesis_question, lines, (row_number() OVER (ORDER BY ord) - 1) // {SIZE} AS batch_id
    FROM questions)"""


@query("batch_assign", f"WITH {_BATCHED_SQL} SELECT ord, batch_id FROM batched")
def batch_assign(spark, folder):
    return order.assign_batches(v.questions(spark, folder).select("ord"), SIZE).select("ord", "batch_id")


def _lengths(words):
    return F.transform(words, lambda w: F.length(w))


def _padded(ids: str, size: str, pad: int) -> str:
    filled = f"list_concat({ids}, list_transform(range({size} - len({ids})), lambda i: {pad}))"
    return f"array_to_string({filled}, ' ')"


@query(
    "batch_pad",
    f"""WITH {_BATCHED_SQL},
    ids AS (
      SELECT ord, batch_id,
        list_transform({q.words(q.strip('synthesis_question'))}, lambda w: CAST(length(w) AS INTEGER)) AS i,
        list_transform({q.words(q.join_facts('lines'))}, lambda w: CAST(length(w) AS INTEGER)) AS o FROM batched),
    sized AS (
      SELECT *, max(len(i)) OVER (PARTITION BY batch_id) AS ni, max(len(o)) OVER (PARTITION BY batch_id) AS no FROM ids)
    SELECT ord, batch_id, {_padded('i', 'ni', 0)} AS input_ids, {_padded('o', 'no', -100)} AS label_ids FROM sized""",
)
def batch_pad(spark, folder):
    rows = v.questions(spark, folder).select(
        "ord",
        _lengths(inference.word_tokens("synthesis_question")).alias("input_ids"),
        _lengths(inference.word_tokens(join_facts("lines"))).alias("label_ids"),
    )
    padded = order.pad_batches(order.assign_batches(rows, SIZE))
    return padded.select(
        "ord",
        "batch_id",
        *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "label_ids")],
    )


def stub_completer(prompt: str) -> str:
    """A pure function in the place of a hosted model."""
    return f"\nFACT1: ENTITY1 has {len(prompt)} letters.\n Question: How many ENTITY1?\n\nsentence:\nnext"


@query(
    "complete_stub",
    f"""SELECT CAST(doc_id AS VARCHAR) AS item_id,
          'FACT1: ENTITY1 has ' || ({len(EXAMPLE_BLOCKS)} + 10 + length(text) + 11) || ' letters.|Question: How many ENTITY1?' AS lines
        FROM documents""",
)
def complete_stub(spark, folder):
    items = v.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"), "text"
    )
    done = decompose(items, "text", stub_completer, EXAMPLE_BLOCKS, wait=0.0)
    return done.select("item_id", F.array_join("sub_sentences", "|").alias("lines"))


def stub_model():
    """Stands for loading a model; the returned function turns each text's words around."""
    return lambda texts: ["<pad> " + " <FACT-SEP> ".join(t.split(" ")[::-1]) + "</s>" for t in texts]


@query(
    "generate_stub",
    """SELECT doc_id, len(w) AS n_lines, array_to_string(w, '|') AS lines FROM (
         SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN list_reverse(string_split(text, ' ')) END AS w FROM documents)""",
)
def generate_stub(spark, folder):
    """A tenth of the texts is absent and does not go to the model."""
    absent = F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("text")
    rows = v.table(spark, folder, "documents", "doc_id").select("doc_id", absent)
    out = decompose_questions(rows, stub_model, "text")
    return out.select(
        "doc_id",
        F.size("text_sub_sentences").cast("long").alias("n_lines"),
        F.array_join("text_sub_sentences", "|").alias("lines"),
    )


@query(
    "generate_paraphrases_stub",
    f"""WITH {v.PARAPHRASES_SQL}
        SELECT item_id, array_to_string(list_transform(paraphrases[1:5], lambda p:
          p || '=' || array_to_string(list_reverse(string_split(p, ' ')), '|')), chr(10)) AS results
        FROM paraphrase_items""",
)
def generate_paraphrases_stub(spark, folder):
    items = v.paraphrase_items(spark, folder).withColumnRenamed(
        "paraphrases", "synthesis_question_paraphrases"
    )
    filled = decompose_exploded(items, stub_model, 5)
    shown = F.transform(
        "synthesis_question_paraphrases_sub_sentences",
        lambda r: F.concat(r["paraphrase"], F.lit("="), F.array_join(r["sub_sentences"], "|")),
    )
    return filled.select("item_id", F.array_join(shown, "\n").alias("results"))


def stub_tokenizer():
    return lambda texts: [[len(w) for w in t.split(" ")] for t in texts]


@query(
    "ids_stub",
    """SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)), ' ') AS ids
       FROM documents""",
)
def ids_stub(spark, folder):
    rows = v.table(spark, folder, "documents", "doc_id").select("doc_id", "text")
    out = inference.with_ids(rows, "text", stub_tokenizer, "ids")
    return out.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


def stub_decoder():
    """Ids back to a text with the marks which a decoder leaves."""
    return lambda lists: ["<pad> " + " ".join(chr(96 + i % 26 + 1) * (i % 3) for i in ids) + "</s>" for ids in lists]


@query(
    "decode_stub",
    """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ' '),
         lambda w: repeat(chr(CAST(97 + length(w) % 26 AS INTEGER)), length(w) % 3)), lambda s: s <> ''), ' ') AS decoded
       FROM documents""",
)
def decode_stub(spark, folder):
    """Padded label ids of each text to a cleaned text."""
    rows = v.table(spark, folder, "documents", "doc_id").select("doc_id", "text")
    ids = inference.with_ids(rows, "text", stub_tokenizer, "label_ids").drop("text")
    padded = ids.withColumn("label_ids", F.concat("label_ids", F.array_repeat(F.lit(-100), 3)))
    texts = inference.with_text(truth_ids(padded), "label_ids", stub_decoder)
    return decoded(texts, "text").select("doc_id", F.col("text").alias("decoded"))


def stub_embedder():
    """Share of each vowel in a text, as a vector."""
    return lambda texts: [[t.count(c) / max(len(t), 1) for c in "aeiou"] for t in texts]


_SHARES = ", ".join(
    f"round(CAST(CAST((length(text) - length(replace(text, '{c}', ''))) / greatest(length(text), 1) AS FLOAT) AS DOUBLE), 4) AS {c}"
    for c in "aeiou"
)


@query("embedding_stub", f"SELECT doc_id, {_SHARES} FROM documents")
def embedding_stub(spark, folder):
    rows = v.table(spark, folder, "documents", "doc_id").select("doc_id", "text")
    out = inference.with_embedding(rows, "text", stub_embedder)
    return out.select(
        "doc_id",
        *[F.round(F.get("embedding", F.lit(i)).cast("double"), 4).alias(c) for i, c in enumerate("aeiou")],
    )


@query(
    "stream_decompose",
    f"""SELECT DISTINCT sha256(text) AS item_id,
          'FACT1: ENTITY1 has ' || ({len(EXAMPLE_BLOCKS)} + 10 + length(text) + 11) || ' letters.|Question: How many ENTITY1?' AS lines
        FROM conversations WHERE text IS NOT NULL""",
)
def stream_decompose(spark, folder):
    """Turns as a stream; each different text is an item, which the stream's state lets through once."""
    work = f"{work_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = f"{folder}/conversations.parque[t]"  # a pattern, as the table is one file or a folder of files
    stream = decompose_stream(
        spark,
        source,
        f"{work}/results",
        stub_completer,
        f"{work}/checkpoint",
        EXAMPLE_BLOCKS,
        question="text",
        fmt="parquet",
        prepare=lambda rows: rows.select(F.sha2("text", 256).alias("item_id"), "text"),
        schema="conv_id long, turn long, role string, text string",
        buckets=16,
        wait=0.0,
    )
    stream.awaitTermination()
    return read_done(spark, f"{work}/results").select("item_id", F.array_join("sub_sentences", "|").alias("lines"))
