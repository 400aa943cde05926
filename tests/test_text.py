from __future__ import annotations

import pytest

from factweave.functions import text as T
from factweave.schemas import PUNCTUATION, WHITESPACE
from factweave.sources.fewshot import block


@pytest.mark.parametrize(
    "raw, want",
    [
        ("The  cat, a dog!", "cat dog"),
        ("", ""),
        ("the the a an THE end", "end"),
        ("a-b", "ab"),
        ("An é a été à l’a bas", "é été à l’ bas"),
        ("bath\tanother\x1ctheory", "bath another theory"),
        (PUNCTUATION, ""),
        ("áa aá a²", "áa aá a²"),
        ("…a…", "… …"),
        (" x　y ", "x y"),
    ],
)
def test_normalize_text(one, raw, want):
    assert one(T.normalize_text("s"), "s string", raw) == want


def test_strip_removes_any_white_space(one):
    assert one(T.strip("s"), "s string", WHITESPACE + "x y" + WHITESPACE) == "x y"
    assert one(T.strip("s"), "s string", WHITESPACE) == ""


def test_words(one):
    assert one(T.words("s"), "s string", "") == []
    assert one(T.words("s"), "s string", "a  b") == ["a", "b"]


def test_prompt_ends_with_the_open_block(one):
    prefix = block("who is it", ["FACT1: ENTITY1 is it.", "Question: Who is ENTITY1?"])
    got = one(T.render_prompt(prefix, "q"), "q string", "where is it")
    assert got == (
        "sentence:\nwho is it\ndecompose:\nFACT1: ENTITY1 is it.\nQuestion: Who is ENTITY1?\n\n"
        "sentence:\nwhere is it\ndecompose:"
    )


@pytest.mark.parametrize(
    "raw, want",
    [
        ("\n FACT1: x. \n\n\tQuestion: y?\n", ["FACT1: x.", "Question: y?"]),
        ("", []),
        ("  \n \n", []),
        ("one", ["one"]),
    ],
)
def test_parse_completion(one, raw, want):
    assert one(T.parse_completion("s"), "s string", raw) == want


@pytest.mark.parametrize(
    "lines, want",
    [
        (["FACT1: x", "Question: y"], ["FACT1: x", "Question: y"]),
        (["FACT1: x", "oops"], []),
        (["question: low"], []),
        ([], []),
        (None, None),
    ],
)
def test_validate(one, lines, want):
    assert one(T.validate_decomposition("s"), "s array<string>", lines) == want


def test_cut_at_stop(one):
    assert one(T.cut_at_stop("s"), "s string", "a\nsentence:\nb sentence: c") == "a\n"
    assert one(T.cut_at_stop("s"), "s string", "no stop") == "no stop"


def test_join_and_split_facts(one):
    lines = ["FACT1: ENTITY1\\'s x.", "Question: y? "]
    joined = one(T.join_facts("s"), "s array<string>", lines)
    assert joined == "FACT1: ENTITY1's x. <FACT-SEP> Question: y?"
    assert one(T.split_facts("s"), "s string", joined) == ["FACT1: ENTITY1's x.", "Question: y?"]
    assert one(T.join_facts("s"), "s array<string>", []) == ""


def test_decomposition_text_takes_lines_or_text(one):
    both = T.decomposition_text("l", "t")
    schema = "l array<string>, t string"
    assert one(both, schema, ["a", "b\\"], None) == "a <FACT-SEP> b"
    assert one(both, schema, None, " c\\ \n") == "c\\"
    assert one(both, schema, None, None) is None


def test_clean_decoded(one):
    assert one(T.clean_decoded("s"), "s string", "<pad> a  b</s><pad>c </s>") == "a b c"
    assert one(T.clean_decoded("s"), "s string", " a\n b\t") == "a\n b\t"


def test_parse_lines(one):
    lines = ["FACT12: ENTITY10 has ENTITY1 and FACT2.", "Question: How many ENTITY1?", "other"]
    got = [tuple(x) for x in one(T.parse_lines("s"), "s array<string>", lines)]
    assert got == [
        ("FACT", 12, "ENTITY10 has ENTITY1 and FACT2.", [10, 1], [2]),
        ("Question", None, "How many ENTITY1?", [1], []),
        ("", None, "", [], []),
    ]


def test_question_column(spark):
    rows = [("dev", "s", "n"), ("test", "s", "n"), ("train", "s", "n")]
    df = spark.createDataFrame(rows, "split string, synthesis_question string, nature_question string")
    assert [r[0] for r in df.select(T.question_column("split")).collect()] == ["s", "n", "n"]


def test_first_paraphrase(one):
    assert one(T.first_paraphrase("s"), "s array<string>", ["a", "b"]) == "a"
    assert one(T.first_paraphrase("s"), "s array<string>", []) is None


def test_let_computes_its_value_once(one):
    from pyspark.sql import functions as F

    doubled = T.let(F.col("s") + 1, lambda x: x * x)
    assert one(doubled, "s int", 4) == 25
