"""Text expressions: prompts, completions, decompositions, normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.schemas import (
    ARTICLES,
    DECODER_MARKS,
    DECOMPOSE_HEAD,
    FACT_SEP,
    LABELS,
    PUNCTUATION,
    SENTENCE_HEAD,
    STOP,
    WHITESPACE,
)

# An article between characters which are neither letters, digits nor underscores. Spelled
# out because the meaning of \b for accented letters depends on flags and on the Java version.
_ARTICLE = r"(?<![\p{L}\p{N}_])(?:" + "|".join(ARTICLES) + r")(?![\p{L}\p{N}_])"
# The characters of WHITESPACE; as a list of single characters the class is five times slower.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body names it many times
    or inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends (plain ``trim`` removes spaces only)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def single_spaced(c: Column | str) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(_col(c), _SPACES, " "))


def normalize_text(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; in this order."""
    bare = F.translate(F.lower(_col(c)), PUNCTUATION, "")
    return single_spaced(F.regexp_replace(bare, _ARTICLE, " "))


def words(c: Column | str) -> Column:
    """Words of a normalised text; none for the empty text."""
    return F.array_remove(F.split(_col(c), " "), "")


def render_prompt(prefix: str, question: Column | str) -> Column:
    """Few-shot blocks, then the question in the open block."""
    return F.concat(F.lit(prefix + SENTENCE_HEAD), _col(question), F.lit(DECOMPOSE_HEAD))


def cut_at_stop(c: Column | str, stop: str = STOP) -> Column:
    """The text before the first stop sequence."""
    return F.substring_index(_col(c), stop, 1)


def parse_completion(c: Column | str) -> Column:
    """Stripped, non-empty lines of a completion."""
    return F.array_remove(F.transform(F.split(_col(c), "\n"), strip), "")


def is_decomposition(lines: Column | str) -> Column:
    """Every line starts with one of the two labels; true for no lines."""
    return F.forall(
        _col(lines), lambda line: F.startswith(line, F.lit(LABELS[0])) | F.startswith(line, F.lit(LABELS[1]))
    )


def validate_decomposition(lines: Column | str) -> Column:
    """The lines, or none of them if any line has no label."""
    none = F.array().cast("array<string>")
    return let(
        _col(lines),
        lambda x: F.when(is_decomposition(x), x).when(x.isNotNull(), none),
    )


def join_facts(lines: Column | str) -> Column:
    """One text of all lines, without backslashes."""
    return strip(F.translate(F.array_join(_col(lines), FACT_SEP), "\\", ""))


def split_facts(c: Column | str) -> Column:
    return F.split(_col(c), FACT_SEP)


def decomposition_text(lines: Column | str, text: Column | str) -> Column:
    """One form for sub-sentences kept as lines or, failing that, as a ready text."""
    lines, text = _col(lines), _col(text)
    return F.when(lines.isNotNull(), join_facts(lines)).otherwise(strip(text))


def clean_decoded(c: Column | str) -> Column:
    """Decoder marks out, runs of spaces to one space, no spaces at the ends."""
    c = _col(c)
    for mark in DECODER_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(" "))
    return F.btrim(F.regexp_replace(c, " {2,}", " "), F.lit(" "))


def parse_lines(lines: Column | str) -> Column:
    """Labelled lines as structs with label, number, body and the references in the body."""

    def refs(body: Column, label: str) -> Column:
        return F.regexp_extract_all(body, F.lit(label + "([0-9]+)"), F.lit(1)).cast("array<int>")

    def parse(line: Column) -> Column:
        body = F.regexp_extract(line, r"^(?:FACT[0-9]+|Question):\s*((?s:.*))$", 1)
        return F.struct(
            F.regexp_extract(line, r"^(FACT|Question)[0-9]*:", 1).alias("kind"),
            F.regexp_extract(line, r"^FACT([0-9]+):", 1).try_cast("int").alias("id"),
            body.alias("body"),
            refs(body, "ENTITY").alias("entity_refs"),
            refs(body, "FACT").alias("fact_refs"),
        )

    return F.transform(_col(lines), parse)


def first_paraphrase(c: Column | str) -> Column:
    return F.get(_col(c), F.lit(0))


def question_column(split: Column | str) -> Column:
    """Which question is decomposed: the synthetic one for dev, else the natural one."""
    return F.when(_col(split) == "dev", F.col("synthesis_question")).otherwise(
        F.col("nature_question")
    )
