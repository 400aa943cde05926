"""Queries over predictions: scores, means, candidates, re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import arrays, metrics
from factweave.functions.text import clean_decoded, parse_completion, join_facts, strip
from factweave.operators import candidates as cand
from factweave.operators import scoring
from factweave.operators.inference import word_tokens
from factweave.operators.skew import hot_keys, join_to_unique
from factweave.plans import evaluation
from factweave.plans import sqltext as q
from factweave.plans import standins as v
from factweave.plans.queries_text import _CHECKED_SQL, _checked
from factweave.plans.registry import query
from factweave.schemas import METRICS
from factweave.sources import sinks

BLEUS = ("bleu1", "bleu2", "bleu3", "bleu4")
PAIR_KEYS = ["kind", "conv_id", "turn"]


def _round(*columns):
    return [F.round(c, 6).alias(c) for c in columns]


@query(
    "exact_match",
    f"""WITH {v.SCORE_PAIRS_SQL}
        SELECT kind, conv_id, turn, CAST({q.normalized('prediction')} = {q.normalized('answer')} AS INTEGER) AS em
        FROM score_pairs""",
)
def exact_match(spark, folder):
    return v.score_pairs(spark, folder).select(
        *PAIR_KEYS, metrics.exact_match("prediction", "answer").alias("em")
    )


@query(
    "token_f1",
    f"""WITH {v.SCORE_PAIRS_SQL}, {q.scored('score_pairs', 'kind, conv_id, turn')}
        SELECT kind, conv_id, turn, {q.rounded('f1')} FROM scores""",
)
def token_f1(spark, folder):
    scored = scoring.with_f1(v.score_pairs(spark, folder), em=False)
    return scored.select(*PAIR_KEYS, *_round("f1"))


@query(
    "bleu",
    f"""WITH {v.SCORE_PAIRS_SQL}, {q.bleu('score_pairs', PAIR_KEYS)}
        SELECT kind, conv_id, turn, {q.rounded(*BLEUS)} FROM bleus""",
)
def bleu(spark, folder):
    return scoring.with_bleu(v.score_pairs(spark, folder)).select(*PAIR_KEYS, *_round(*BLEUS))


@query(
    "bleu_documents",
    f"""WITH {v.DOCUMENT_PAIRS_SQL}, {q.bleu('document_pairs', ['kind', 'doc_id'])}
        SELECT kind, doc_id, {q.rounded(*BLEUS)} FROM bleus""",
)
def bleu_documents(spark, folder):
    return scoring.with_bleu(v.document_pairs(spark, folder)).select("kind", "doc_id", *_round(*BLEUS))


_MEANS_SQL = ", ".join(q.mean(m) for m in METRICS)
_SCORED_SQL = (
    f"{v.SCORE_PAIRS_SQL}, {q.scored('score_pairs', 'kind, conv_id, turn')}, {q.bleu('score_pairs', PAIR_KEYS)}, "
    "joined AS (SELECT * FROM scores JOIN bleus USING (kind, conv_id, turn) "
    "JOIN score_pairs USING (kind, conv_id, turn))"
)


@query("eval_summary", f"WITH {_SCORED_SQL} SELECT count(*) AS n, {_MEANS_SQL} FROM joined")
def eval_summary(spark, folder):
    return scoring.evaluate(v.score_pairs(spark, folder)).select("n", *_round(*METRICS))


_SLICE = (
    "CASE WHEN lines BETWEEN 0 AND 3 THEN '0-3' WHEN lines = 4 THEN '4' WHEN lines = 5 THEN '5' "
    "WHEN lines BETWEEN 6 AND 100 THEN '6-100' END"
)


def _by_length(spark, folder):
    rows = v.score_pairs(spark, folder)
    bucket = scoring.length_slice(F.size(parse_completion("answer")))
    return scoring.evaluate(rows.withColumn("bucket", bucket), by=["bucket"])


_BY_LENGTH_SQL = (
    f"{_SCORED_SQL}, sliced AS (SELECT *, len({q.parsed('answer')}) AS lines FROM joined), "
    f"by_length AS (SELECT {_SLICE} AS bucket, count(*) AS n, {_MEANS_SQL} FROM sliced GROUP BY 1)"
)


@query("eval_by_length", f"WITH {_BY_LENGTH_SQL} SELECT bucket, n, {', '.join(METRICS)} FROM by_length")
def eval_by_length(spark, folder):
    return _by_length(spark, folder).select("bucket", "n", *_round(*METRICS))


@query(
    "eval_rollup",
    f"""WITH {_SCORED_SQL}, sliced AS (SELECT *, len({q.parsed('answer')}) AS lines FROM joined),
        named AS (SELECT *, {_SLICE} AS bucket FROM sliced)
        SELECT kind, bucket, CAST(2 - grouping(kind) - grouping(bucket) AS INTEGER) AS level, count(*) AS n, {_MEANS_SQL}
        FROM named GROUP BY ROLLUP (kind, bucket)""",
)
def eval_rollup(spark, folder):
    """Means of every slice of each kind of pair, of each kind, and of all pairs, in one pass."""
    bucket = scoring.length_slice(F.size(parse_completion("answer")))
    rows = v.score_pairs(spark, folder).withColumn("bucket", bucket)
    return scoring.evaluate_rollup(rows, ["kind", "bucket"]).select("kind", "bucket", "level", "n", *_round(*METRICS))


@query(
    "metric_unpivot",
    f"""WITH {_BY_LENGTH_SQL}
        SELECT bucket, tag, value FROM by_length UNPIVOT (value FOR tag IN ({', '.join(METRICS)}))""",
)
def metric_unpivot(spark, folder):
    from factweave.operators.runlog import metric_rows

    rows = metric_rows(_by_length(spark, folder), ["bucket"], METRICS)
    return rows.select("bucket", "tag", *_round("value"))


@query(
    "acceptance",
    f"""WITH {_CHECKED_SQL}
        SELECT count(*) AS loaded, count(*) FILTER (len(lines) > 0) AS saved,
          round(count(*) FILTER (len(lines) > 0) / count(*), 6) AS rate FROM checked""",
)
def acceptance(spark, folder):
    return scoring.acceptance(_checked(spark, folder), "lines").select("loaded", "saved", *_round("rate"))


_LENGTHS_SQL = f"""{v.QUESTIONS_SQL}, sized AS (
    SELECT len({q.words(q.strip('synthesis_question'))}) AS i, len({q.words(q.join_facts('lines'))}) AS o,
      len({q.words(q.strip('program'))}) AS p FROM questions)"""


def _lengths(spark, folder):
    return v.questions(spark, folder).select(
        word_tokens("synthesis_question").alias("input"),
        word_tokens(join_facts("lines")).alias("output"),
        word_tokens("program").alias("program"),
    )


@query(
    "length_profile",
    f"WITH {_LENGTHS_SQL} SELECT count(*) AS n, max(i) AS max_input, max(o) AS max_output, max(p) AS max_program FROM sized",
)
def length_profile(spark, folder):
    profile = scoring.length_profile(_lengths(spark, folder), "input", "output", "program")
    return profile.select("n", *[F.col(c).cast("long").alias(c) for c in profile.columns[1:]])


@query("generation_budget", f"WITH {_LENGTHS_SQL} SELECT max(o) + 64 AS max_length FROM sized")
def generation_budget(spark, folder):
    budget = scoring.max_gen_length(_lengths(spark, folder), "output")
    return budget.select(F.col("max_length").cast("long").alias("max_length"))


@query(
    "best_of_n",
    f"""WITH {v.CANDIDATES_SQL}, {q.scored('cands', 'example_id, cand_idx')},
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY f1 DESC, cand_idx) AS r,
            count(*) OVER (PARTITION BY example_id) AS n_candidates FROM scores),
        best AS (
          SELECT r.example_id, r.cand_idx, n_candidates, f1, em, prediction, answer
          FROM ranked r JOIN cands c ON c.example_id = r.example_id AND c.cand_idx = r.cand_idx WHERE r = 1),
        {q.bleu('best', ['example_id'])}
        SELECT example_id, cand_idx, n_candidates, em, {q.rounded('f1', *BLEUS)}
        FROM best JOIN bleus USING (example_id)""",
)
def best_of_n(spark, folder):
    chosen = cand.best_of_n(*v.turn_candidates(spark, folder))
    return chosen.select("example_id", "cand_idx", "n_candidates", "em", *_round("f1", *BLEUS))


@query(
    "rank_candidates",
    f"""WITH {v.CANDIDATES_SQL}, {q.scored('cands', 'example_id, cand_idx')},
        gaps AS (SELECT example_id, cand_idx, CASE WHEN cand_idx % 4 NOT IN (2, 3) THEN f1 END AS score FROM scores)
        SELECT example_id, cand_idx,
          row_number() OVER (PARTITION BY example_id ORDER BY score DESC NULLS LAST, cand_idx) AS rank
        FROM gaps""",
)
def rank_candidates(spark, folder):
    """A fourth of the candidates each has NULL and NaN for a score, which come last."""
    candidates, truths = v.turn_candidates(spark, folder)
    hot = hot_keys(candidates, "example_id")
    paired = join_to_unique(candidates, truths, "example_id", spread_by="cand_idx", hot=hot)
    turn = F.col("cand_idx") % 4
    gaps = F.when(turn == 2, F.lit(None)).when(turn == 3, F.lit(float("nan"))).otherwise(F.col("f1"))
    scored = scoring.with_f1(paired, em=False).select("example_id", "cand_idx", gaps.alias("score"))
    return cand.rank_candidates(scored, "score", hot=hot).drop("score")


@query(
    "vector_normalise",
    """WITH sized AS (
         SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
       normed AS (
         SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x)) + 1e-15) AS size FROM sized)
       SELECT vec_id, CAST(unnest(range(len(e))) AS INTEGER) AS pos, round(unnest(e) / size, 6) AS x FROM normed""",
)
def vector_normalise(spark, folder):
    rows = v.table(spark, folder, "embeddings")
    parts = rows.select("vec_id", F.posexplode(arrays.l2_normalize("embedding")).alias("pos", "x"))
    return parts.select("vec_id", "pos", *_round("x"))


_SIMILAR_SQL = f"""{v.VECTORS_SQL},
    alike AS (
      SELECT example_id, cand_idx, prediction,
        list_inner_product(v, q) / (sqrt(list_inner_product(v, v) + 1e-15) * sqrt(list_inner_product(q, q) + 1e-15))
          AS similarity FROM vecs)"""


@query("cosine", f"WITH {_SIMILAR_SQL} SELECT example_id, cand_idx, {q.rounded('similarity')} FROM alike")
def cosine(spark, folder):
    near = cand.similarity(*v.vectors(spark, folder))
    return near.select("example_id", "cand_idx", *_round("similarity"))


@query(
    "semantic_rerank",
    f"""WITH {_SIMILAR_SQL},
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY similarity DESC, cand_idx) AS r,
            count(*) OVER (PARTITION BY example_id) AS n_candidates FROM alike)
        SELECT example_id, cand_idx, n_candidates, prediction, {q.rounded('similarity')} FROM ranked WHERE r = 1""",
)
def semantic_rerank(spark, folder):
    chosen = cand.semantic_rerank(*v.vectors(spark, folder))
    return chosen.select("example_id", "cand_idx", "n_candidates", "prediction", *_round("similarity"))


@query(
    "rerank_eval",
    f"""WITH {_SIMILAR_SQL},
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY similarity DESC, cand_idx) AS r FROM alike),
        chosen AS (
          SELECT example_id, prediction, 'vector ' || (example_id * {v.GROUP} + 1) AS answer FROM ranked WHERE r = 1),
        {q.scored('chosen', 'example_id')}, {q.bleu('chosen', ['example_id'])}
        SELECT count(*) AS n, {_MEANS_SQL} FROM scores JOIN bleus USING (example_id)""",
)
def rerank_eval(spark, folder):
    candidates, asked = v.vectors(spark, folder)
    first = (F.col("example_id") * v.GROUP + 1).cast("string")
    truths = asked.select("example_id", F.concat(F.lit("vector "), first).alias("answer"))
    result = evaluation.evaluate_reranked(candidates, asked, truths)
    return result.select("n", *_round(*METRICS))


@query(
    "strip_pad",
    f"""WITH {v.QUESTIONS_SQL}, ids AS (
          SELECT ord, list_transform({q.words(q.join_facts('lines'))}, lambda w: length(w)) AS ids FROM questions)
        SELECT ord, array_to_string(ids, ' ') AS ids FROM ids""",
)
def strip_pad(spark, folder):
    """Labels padded to a common length come back as they were."""
    tokens = F.transform(word_tokens(join_facts("lines")), lambda w: F.length(w))
    padded = v.questions(spark, folder).select("ord", tokens.alias("ids")).withColumn(
        "ids", F.concat("ids", F.array_repeat(F.lit(-100), 80 - F.size("ids")))
    )
    return padded.select(
        "ord", F.array_join(arrays.strip_pad("ids").cast("array<string>"), " ").alias("ids")
    )


@query(
    "report_lines",
    f"""WITH {v.QUESTIONS_SQL}
        SELECT ord, array_to_string(['====================', 'synthetic :' || synthesis_question,
          'natural   :' || nature_question, 'question  :' || {q.strip('nature_question')},
          'prediction:' || lines[1], 'gold      :' || lines[len(lines) - 1],
          CASE WHEN lines[1] = lines[len(lines) - 1] THEN 'True' ELSE 'False' END], chr(10)) AS value
        FROM questions""",
)
def report_lines(spark, folder):
    items = v.questions(spark, folder)
    records = items.select(
        "ord",
        strip("nature_question").alias("question"),
        F.get("lines", F.lit(0)).alias("prediction"),
        F.get("lines", F.size("lines") - 2).alias("answer"),
    )
    return sinks.report_lines(records, items)


@query(
    "record_rows",
    f"""WITH {v.PAIRS_SQL}
        SELECT conv_id, turn, {q.strip('answer')} AS question, array_to_string({q.words('prediction')}, ' ') AS prediction,
          array_to_string({q.words('answer')}, ' ') AS answer FROM pairs""",
)
def record_rows(spark, folder):
    pairs = v.turn_pairs(spark, folder)
    rows = pairs.select(
        "conv_id",
        "turn",
        strip("answer").alias("question"),
        clean_decoded("prediction").alias("prediction"),
        clean_decoded("answer").alias("answer"),
    )
    return sinks.eval_records(rows, ("conv_id", "turn"))
