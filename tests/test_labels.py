from __future__ import annotations

import re

from pyspark.sql import functions as F

from factweave.functions import labels

TEXT = (
    "FACT1: ENTITY1 is x. <FACT-SEP> FACT2: ENTITY10 has ENTITY1. <FACT-SEP> "
    "FACT3: FACT1 or FACT2. <FACT-SEP> Question: How many 2 ENTITY10 of FACT12?"
)


def _rows(spark, expression, text=TEXT, n=40):
    return [r.x for r in spark.range(n).select(F.lit(text).alias("t"), "id").select(expression.alias("x")).collect()]


def test_relabelled_entities_are_a_permutation(spark):
    seen = set()
    for out in _rows(spark, labels.relabel_entities("t", "id")):
        assert re.sub(r"ENTITY\d+", "ENTITY#", out) == re.sub(r"ENTITY\d+", "ENTITY#", TEXT)
        old, new = re.findall(r"ENTITY(\d+)", TEXT), re.findall(r"ENTITY(\d+)", out)
        pairs = set(zip(old, new))
        assert len(pairs) == len({o for o, _ in pairs}) == len({n for _, n in pairs})
        assert set(new) == set(old)
        seen.add(out)
    assert len(seen) == 2


def test_a_great_number_in_a_text_costs_nothing(spark):
    text = "ENTITY1 ENTITY999999999 ENTITY3 ENTITY12345678901234567890"
    seen = set(_rows(spark, labels.relabel_entities("t", "id"), text, 60))
    assert len(seen) == 6 and all(x.endswith(" ENTITY12345678901234567890") for x in seen)
    assert all(set(x.split()) == set(text.split()) for x in seen)


def test_relabelling_is_the_same_in_every_run(spark):
    assert _rows(spark, labels.relabel_entities("t", "id", 3)) == _rows(spark, labels.relabel_entities("t", "id", 3))
    assert _rows(spark, labels.relabel_entities("t", "id", 3)) != _rows(spark, labels.relabel_entities("t", "id", 4))


def test_compatible_mode_keeps_texts_with_entity_1(spark):
    assert set(_rows(spark, labels.relabel_entities("t", "id", compat=True))) == {TEXT}
    assert set(_rows(spark, labels.relabel_entities("t", "id", compat=True), "ENTITY12 only")) == {"ENTITY12 only"}
    assert set(_rows(spark, labels.relabel_entities("t", "id", compat=True), "no label")) == {"no label"}


def test_compatible_mode_replaces_the_smallest_label_as_a_substring(spark):
    got = set(_rows(spark, labels.relabel_entities("t", "id", compat=True), "ENTITY3 ENTITY30 ENTITY4"))
    assert got == {f"ENTITY{i} ENTITY{i}0 ENTITY4" for i in (1, 2, 3)}


def test_texts_without_labels_stay(spark):
    assert set(_rows(spark, labels.relabel_entities("t", "id"), "7 <FACT-SEP> 2")) == {"7 <FACT-SEP> 2"}
    assert set(_rows(spark, labels.shuffle_facts("t", "id"), "Question: 1?")) == {"Question: 1?"}
    assert set(_rows(spark, labels.shuffle_facts("t", "id"), "")) == {""}


def test_shuffled_facts_keep_bodies_and_references(spark):
    parts = TEXT.split(" <FACT-SEP> ")
    bodies = {p.split(": ")[0]: p.split(": ", 1)[1] for p in parts}
    orders = set()
    for out in _rows(spark, labels.shuffle_facts("t", "id")):
        new = out.split(" <FACT-SEP> ")
        assert [p.split(":")[0] for p in new] == ["FACT1", "FACT2", "FACT3", "Question"]
        assert new[-1] == parts[-1]
        facts = [p.split(": ", 1)[1] for p in new[:-1]]
        place = {b: i + 1 for i, b in enumerate(facts)}
        first, second = place[bodies["FACT1"]], place[bodies["FACT2"]]
        assert f"FACT{first} or FACT{second}." in facts
        orders.add((first, second))
    assert len(orders) == 6


def test_null_stays_null(one):
    assert one(labels.relabel_entities("t", "k"), "t string, k int", None, 1) is None
    assert one(labels.shuffle_facts("t", "k"), "t string, k int", None, 1) is None
