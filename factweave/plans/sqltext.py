"""SQL texts used by several of the comparison queries."""

from __future__ import annotations


def strip(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def join_facts(lines: str) -> str:
    return strip(f"replace(array_to_string({lines}, ' <FACT-SEP> '), '\\', '')")


def normalized(x: str) -> str:
    bare = rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')"
    # Twice, since two articles in a row share the space between them.
    for _ in range(2):
        bare = rf"regexp_replace({bare}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)($|[^\p{{L}}\p{{N}}_])', '\1 \3', 'g')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def parsed(x: str) -> str:
    """Stripped, non-empty lines."""
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda s: {strip('s')}), lambda s: s <> '')"


def valid(lines: str) -> str:
    labelled = "starts_with(s, 'FACT') OR starts_with(s, 'Question')"
    return f"len(list_filter({lines}, lambda s: NOT ({labelled}))) = 0"


def cut(x: str) -> str:
    return f"string_split({x}, 'sentence:')[1]"


def scored(source: str, keys: str) -> str:
    """Further common tables: ``scores(keys, f1, em)`` of a source with prediction and answer."""
    return f"""normed AS (
  SELECT {keys}, {normalized('prediction')} AS p, {normalized('answer')} AS t FROM {source}),
worded AS (SELECT {keys}, p, t, {words('p')} AS pw, {words('t')} AS tw FROM normed),
counted AS (
  SELECT {keys}, p, t, len(pw) AS np, len(tw) AS nt, len(list_intersect(pw, tw)) AS c FROM worded),
scores AS (
  SELECT {keys}, CAST(p = t AS INTEGER) AS em,
    CASE WHEN np = 0 OR nt = 0 THEN CAST(np = nt AS DOUBLE) WHEN c = 0 THEN 0.0
      ELSE 2 * ((c / np) * (c / nt)) / ((c / np) + (c / nt)) END AS f1
  FROM counted)"""


def bleu(source: str, keys: list[str]) -> str:
    """Further common tables: ``bleus(keys, bleu1 .. bleu4)`` by unnested and counted grams."""
    k = ", ".join(keys)
    on = " AND ".join(f"x.{c} = y.{c}" for c in [*keys, "n", "gram"])
    same = " AND ".join(f"s.{c} = o.{c}" for c in keys)

    def grams(side: str, text: str) -> str:
        window = f"OVER (PARTITION BY {k} ORDER BY i)"
        parts = [f"""
  SELECT {k}, {n} AS n, tok{''.join(f" || ' ' || lead(tok, {j}) {window}" for j in range(1, n))} AS gram
  FROM {side}_tokens""" for n in (1, 2, 3, 4)]
        return f"""{side}_tokens AS (
  SELECT {k}, unnest(string_split({text}, ' ')) AS tok,
    unnest(range(1, len(string_split({text}, ' ')) + 1)) AS i FROM {source}),
{side}_grams AS ({' UNION ALL '.join(parts)}),
{side}_counts AS (
  SELECT {k}, n, gram, count(*) AS cnt FROM {side}_grams WHERE gram IS NOT NULL GROUP BY ALL)"""

    scores = ",\n    ".join(
        f"""CASE WHEN coalesce(c1, 0) = 0 OR coalesce(c{n}, 0) = 0 THEN 0.0
      ELSE (CASE WHEN np > nt THEN 1.0 ELSE exp(1 - nt / np) END) * (c{n} / greatest(np - {n - 1}, 1)) END AS bleu{n}"""
        for n in (1, 2, 3, 4)
    )
    sums = ", ".join(f"sum(c) FILTER (n = {n}) AS c{n}" for n in (1, 2, 3, 4))
    return f"""{grams('p', 'prediction')},
{grams('t', 'answer')},
shared AS (
  SELECT {', '.join('x.' + c for c in keys)}, x.n, CAST(sum(least(x.cnt, y.cnt)) AS BIGINT) AS c
  FROM p_counts x JOIN t_counts y ON {on} GROUP BY ALL),
wide AS (SELECT {k}, {sums} FROM shared GROUP BY ALL),
sizes AS (
  SELECT {k}, len(string_split(prediction, ' ')) AS np, len(string_split(answer, ' ')) AS nt FROM {source}),
bleus AS (
  SELECT {', '.join('s.' + c for c in keys)}, {scores}
  FROM sizes s LEFT JOIN wide o ON {same})"""


def mean(column: str) -> str:
    return f"round(avg({column}), 6) AS {column}"


def rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)
