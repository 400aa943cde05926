"""Queries over texts: prompts, completions, decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import labels, text
from factweave.plans import sqltext as q
from factweave.plans import standins as v
from factweave.plans.registry import query
from factweave.sources.fewshot import block

EXAMPLE_BLOCKS = block(
    "which river flows through the largest town",
    ["FACT1: ENTITY1 is a river.", "FACT2: ENTITY2 is the largest town.", "FACT3: ENTITY1 flows through ENTITY2.",
     "Question: Which is ENTITY1?"],
) + block(
    "how many bridges are longer than the old one",
    ["FACT1: ENTITY1 is a bridge.", "FACT2: ENTITY2 is the old bridge.", "FACT3: ENTITY1 is longer than ENTITY2.",
     "Question: How many ENTITY1?"],
)


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query(
    "prompt_render",
    f"SELECT doc_id, {_literal(EXAMPLE_BLOCKS)} || 'sentence:' || chr(10) || text || chr(10) || 'decompose:' AS prompt "
    "FROM documents",
)
def prompt_render(spark, folder):
    return v.table(spark, folder, "documents").select(
        "doc_id", text.render_prompt(EXAMPLE_BLOCKS, "text").alias("prompt")
    )


@query("stop_cut", f"WITH {v.COMPLETIONS_SQL} SELECT item_id, {q.cut('completion')} AS completion FROM completions")
def stop_cut(spark, folder):
    return v.completions(spark, folder).select("item_id", text.cut_at_stop("completion").alias("completion"))


@query(
    "completion_parse",
    f"""WITH {v.COMPLETIONS_SQL}, parsed AS (SELECT item_id, {q.parsed('completion')} AS lines FROM completions)
        SELECT item_id, len(lines) AS n_lines, array_to_string(lines, '|') AS lines FROM parsed""",
)
def completion_parse(spark, folder):
    parsed = v.completions(spark, folder).select("item_id", text.parse_completion("completion").alias("lines"))
    return parsed.select(
        "item_id", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "|").alias("lines")
    )


_CHECKED_SQL = f"""{v.COMPLETIONS_SQL},
    parsed AS (SELECT item_id, {q.parsed(q.cut('completion'))} AS lines FROM completions),
    checked AS (SELECT item_id, CASE WHEN {q.valid('lines')} THEN lines ELSE [] END AS lines FROM parsed)"""


def _checked(spark, folder):
    lines = text.parse_completion(text.cut_at_stop("completion"))
    parsed = v.completions(spark, folder).select("item_id", lines.alias("lines"))
    return parsed.select("item_id", text.validate_decomposition("lines").alias("lines"))


@query(
    "completion_validate",
    f"WITH {_CHECKED_SQL} SELECT item_id, len(lines) AS n_lines, array_to_string(lines, '|') AS lines FROM checked",
)
def completion_validate(spark, folder):
    return _checked(spark, folder).select(
        "item_id", F.size("lines").cast("long").alias("n_lines"), F.array_join("lines", "|").alias("lines")
    )


@query("fact_join", f"WITH {v.QUESTIONS_SQL} SELECT ord, {q.join_facts('lines')} AS decomposition FROM questions")
def fact_join(spark, folder):
    return v.questions(spark, folder).select("ord", text.join_facts("lines").alias("decomposition"))


@query(
    "fact_split",
    f"""WITH {v.QUESTIONS_SQL},
        split_up AS (SELECT ord, string_split({q.join_facts('lines')}, ' <FACT-SEP> ') AS facts FROM questions)
        SELECT ord, CAST(unnest(range(len(facts))) AS INTEGER) AS pos, unnest(facts) AS fact FROM split_up""",
)
def fact_split(spark, folder):
    facts = text.split_facts(text.join_facts("lines"))
    return v.questions(spark, folder).select("ord", F.posexplode(facts).alias("pos", "fact"))


@query(
    "decode_clean",
    """SELECT doc_id, array_to_string(list_filter(string_split(
         replace(replace('<pad> ' || text || '</s><pad>  <pad>', '</s>', ' '), '<pad>', ' '), ' '),
         lambda w: w <> ''), ' ') AS decoded FROM documents""",
)
def decode_clean(spark, folder):
    raw = F.concat(F.lit("<pad> "), F.col("text"), F.lit("</s><pad>  <pad>"))
    return v.table(spark, folder, "documents", "doc_id").select("doc_id", text.clean_decoded(raw).alias("decoded"))


@query(
    "trim_text",
    f"""WITH {v.QUESTIONS_SQL} SELECT ord, {q.strip('synthesis_question')} AS synthesis_question,
        {q.strip('nature_question')} AS nature_question, {q.strip('program')} AS program FROM questions""",
)
def trim_text(spark, folder):
    names = ("synthesis_question", "nature_question", "program")
    return v.questions(spark, folder).select("ord", *[text.strip(c).alias(c) for c in names])


@query(
    "line_parse",
    rf"""WITH {v.QUESTIONS_SQL},
        rows AS (SELECT ord, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM questions),
        parts AS (
          SELECT ord, CAST(pos AS INTEGER) AS pos, regexp_extract(line, '^(FACT|Question)[0-9]*:', 1) AS kind,
            TRY_CAST(regexp_extract(line, '^FACT([0-9]+):', 1) AS INTEGER) AS id,
            regexp_extract(line, '^(FACT[0-9]+|Question):\s*(.*)$', 2) AS body FROM rows)
        SELECT ord, pos, kind, id, body,
          array_to_string(regexp_extract_all(body, 'ENTITY([0-9]+)', 1), ',') AS entity_refs,
          array_to_string(regexp_extract_all(body, 'FACT([0-9]+)', 1), ',') AS fact_refs FROM parts""",
)
def line_parse(spark, folder):
    lines = v.questions(spark, folder).select("ord", F.posexplode(text.parse_lines("lines")).alias("pos", "line"))
    return lines.select(
        "ord",
        "pos",
        "line.kind",
        "line.id",
        "line.body",
        F.array_join(F.col("line.entity_refs").cast("array<string>"), ",").alias("entity_refs"),
        F.array_join(F.col("line.fact_refs").cast("array<string>"), ",").alias("fact_refs"),
    )


@query("normalize_text", f"SELECT doc_id, {q.normalized('text')} AS normalized FROM documents")
def normalize_text(spark, folder):
    return v.table(spark, folder, "documents", "doc_id").select("doc_id", text.normalize_text("text").alias("normalized"))


def _renumber(label: str, last: int) -> str:
    """Nested replacement from the greatest number down, by way of a name no text has."""
    x = "txt"
    for i in range(last, 0, -1):
        x = f"replace({x}, '{label}{i}', coalesce('@@' || perm[{i}], '{label}{i}'))"
    return f"replace({x}, '@@', '{label}')"


def _drawn(size: str, source: str) -> str:
    return f"""numbers AS (SELECT ord, unnest(range(1, {size} + 1)) AS i FROM {source}),
    drawn AS (
      SELECT ord, i, row_number() OVER (PARTITION BY ord ORDER BY md5('666:' || ord || ':' || i)) AS new FROM numbers),
    perms AS (SELECT ord, list(new ORDER BY i) AS perm, list(i ORDER BY new) AS olds FROM drawn GROUP BY ord)"""


@query(
    "relabel_entities",
    f"""WITH {v.QUESTIONS_SQL},
    texts AS (
      SELECT ord, CASE WHEN ord % 3 = 0 THEN replace(txt, 'ENTITY1', 'ENTITY4') ELSE txt END AS txt
      FROM (SELECT ord, {q.join_facts('lines')} AS txt FROM questions)),
    numbers AS (SELECT DISTINCT ord, CAST(unnest(regexp_extract_all(txt, 'ENTITY([0-9]+)', 1)) AS INTEGER) AS i FROM texts),
    drawn AS (
      SELECT ord, i, row_number() OVER (PARTITION BY ord ORDER BY md5('666:' || ord || ':' || i)) AS r,
        row_number() OVER (PARTITION BY ord ORDER BY i) AS place FROM numbers),
    renamed AS (SELECT a.ord, a.i, b.i AS new FROM drawn a JOIN drawn b ON b.ord = a.ord AND b.place = a.r),
    perms AS (
      SELECT t.ord, list(new ORDER BY n) AS perm
      FROM (SELECT ord, unnest(range(1, 42)) AS n FROM texts) t LEFT JOIN renamed r ON r.ord = t.ord AND r.i = n GROUP BY t.ord),
    least_label AS (
      SELECT ord, list_min(list_filter(range(1, 31), lambda i: contains(txt, 'ENTITY' || i))) AS m FROM texts),
    upto AS (SELECT ord, m, unnest(range(1, m + 1)) AS i FROM least_label),
    compat AS (
      SELECT ord, m, r FROM (
        SELECT *, row_number() OVER (PARTITION BY ord ORDER BY md5('666:' || ord || ':' || i)) AS r FROM upto) WHERE i = m)
    SELECT t.ord, {_renumber('ENTITY', 41)} AS decomposition,
      CASE WHEN m > 1 THEN replace(txt, 'ENTITY' || m, 'ENTITY' || r) ELSE txt END AS compatible
    FROM texts t JOIN perms p ON p.ord = t.ord LEFT JOIN compat c ON c.ord = t.ord""",
)
def relabel_entities(spark, folder):
    """A third of the texts do not name ENTITY1, so that the compatible mode changes them."""
    txt = text.join_facts("lines")
    other = F.when(F.col("ord") % 3 == 0, F.replace(txt, F.lit("ENTITY1"), F.lit("ENTITY4"))).otherwise(txt)
    rows = v.questions(spark, folder).select("ord", other.alias("txt"))
    return rows.select(
        "ord",
        labels.relabel_entities("txt", "ord").alias("decomposition"),
        labels.relabel_entities("txt", "ord", compat=True).alias("compatible"),
    )


@query(
    "shuffle_facts",
    f"""WITH {v.QUESTIONS_SQL},
    split_up AS (SELECT ord, string_split({q.join_facts('lines')}, ' <FACT-SEP> ') AS parts FROM questions),
    {_drawn('len(parts) - 1', 'split_up')},
    moved AS (
      SELECT s.ord, perm, array_to_string(
        list_concat(list_transform(olds, lambda i: parts[i]), [parts[len(parts)]]), ' <FACT-SEP> ') AS txt
      FROM split_up s JOIN perms p ON p.ord = s.ord)
    SELECT ord, {_renumber('FACT', 7)} AS decomposition FROM moved""",
)
def shuffle_facts(spark, folder):
    rows = v.questions(spark, folder).select("ord", text.join_facts("lines").alias("txt"))
    return rows.select("ord", labels.shuffle_facts("txt", "ord").alias("decomposition"))
