from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from factweave.functions import arrays
from factweave.functions.metrics import exact_match, token_f1
from factweave.operators import scoring
from factweave.schemas import PUNCTUATION


def plain_f1(p, t):
    def tokens(s):
        kept = "".join(c for c in s.lower() if c not in PUNCTUATION)
        return [w for w in re.split(r"\s+", re.sub(r"(?<!\w)(a|an|the)(?!\w)", " ", kept)) if w]

    p, t = tokens(p), tokens(t)
    if not p or not t:
        return float(p == t)
    both = len({*p}.intersection(t))
    return 2 * both / (len(p) + len(t)) if both else 0.0


def plain_bleu(p, t, n):
    p, t = p.split(" "), t.split(" ")
    grams = [Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, t)]
    hits = sum((grams[0] & grams[1]).values())
    penalty = 1.0 if len(p) > len(t) else math.exp(1 - len(t) / len(p))
    return penalty * hits / max(sum(grams[0].values()), 1)


@pytest.mark.parametrize(
    "p, t, em, f1",
    [
        ("The cat.", "cat", 1, 1.0),
        ("b b c", "b b c", 1, 2 / 3),
        ("", "", 1, 1.0),
        ("", "x", 0, 0.0),
        ("the", "a", 1, 1.0),
        ("x y", "z", 0, 0.0),
        ("x y z", "z y w v", 0, 4 / 7),
    ],
)
def test_exact_match_and_f1(one, p, t, em, f1):
    schema = "p string, t string"
    assert one(exact_match("p", "t"), schema, p, t) == em
    assert one(token_f1("p", "t"), schema, p, t) == pytest.approx(f1)
    assert plain_f1(p, t) == pytest.approx(f1)


def _bleu(spark, pairs):
    df = spark.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "i int, prediction string, answer string")
    return [tuple(r)[-4:] for r in scoring.with_bleu(df).orderBy("i").collect()]


def test_bleu_by_hand(spark):
    got = _bleu(spark, [("b b c", "b c d"), ("", ""), ("", "a b"), ("a", "a b"), ("a b c d e", "a b c d e")])
    assert got[0] == pytest.approx((2 / 3, 1 / 2, 0.0, 0.0))
    assert got[1] == pytest.approx((1.0, 0.0, 0.0, 0.0))
    assert got[2] == (0.0, 0.0, 0.0, 0.0)
    assert got[3] == pytest.approx((math.exp(-1), 0.0, 0.0, 0.0))
    assert got[4] == pytest.approx((1.0, 1.0, 1.0, 1.0))


def test_bleu_and_f1_equal_plain_counts_on_random_texts(spark):
    draw = random.Random(1)
    words = ["a", "the", "b", "B.", "c\n", "", "é", "x 0", "x", "0", "1", "zz,"]
    pairs = []
    for _ in range(400):
        few = draw.sample(words, draw.randint(1, len(words)))
        pairs.append(tuple(" ".join(draw.choices(few, k=draw.randint(0, 25))) for _ in "pt"))
    pairs += [(p, p) for p, _ in pairs[:50]]
    df = spark.createDataFrame([(i, *pair) for i, pair in enumerate(pairs)], "i int, prediction string, answer string")
    for row, (p, t) in zip(scoring.with_scores(df).orderBy("i").collect(), pairs):
        assert row.f1 == pytest.approx(plain_f1(p, t)), (p, t)
        got = (row.bleu1, row.bleu2, row.bleu3, row.bleu4)
        assert got == pytest.approx([plain_bleu(p, t, n) for n in (1, 2, 3, 4)]), (p, t)


def test_long_repeated_text_is_counted_whole(spark):
    p, t = "x y " * 20_000 + "end", "y x " * 15_000 + "end"
    assert _bleu(spark, [(p, t)])[0] == pytest.approx([plain_bleu(p, t, n) for n in (1, 2, 3, 4)])


def test_means_and_slices(spark):
    rows = [("x", "x", 3), ("x y", "x z", 4), ("q", "r", 4), ("a", "b", 101)]
    df = spark.createDataFrame(rows, "prediction string, answer string, n int")
    total = scoring.evaluate(df).first()
    assert (total.n, total.em, total.f1) == (4, 0.25, pytest.approx((1 + 0.5 + 0 + 0) / 4))
    sliced = df.withColumn("slice", scoring.length_slice(df.n))
    by = {r.slice: (r.n, r.f1) for r in scoring.evaluate(sliced, by=["slice"]).collect()}
    assert by == {"0-3": (1, 1.0), "4": (2, 0.25), None: (1, 0.0)}
    two = scoring.length_slice(df.n, ((0, 4), (5, 1_000)))
    assert [r[0] for r in df.select(two).collect()] == ["0-4", "0-4", "0-4", "5-1000"]


def test_counters(spark):
    df = spark.createDataFrame([(["a"], [1, 2]), ([], [1]), (None, [])], "l array<string>, ids array<int>")
    assert tuple(scoring.acceptance(df, "l").first()) == (3, 1, pytest.approx(1 / 3))
    assert tuple(scoring.length_profile(df, "l", "ids").first()) == (3, 1, 2)
    assert scoring.max_gen_length(df, "ids").first().max_length == 66


def test_vectors(one):
    unit = one(arrays.l2_normalize("v"), "v array<float>", [3.0, 4.0])
    assert unit == pytest.approx([0.6, 0.8])
    assert one(arrays.l2_normalize("v"), "v array<float>", [0.0, 0.0]) == [0.0, 0.0]
    assert one(arrays.cosine("v", "w"), "v array<float>, w array<float>", [1.0, 0.0], [1.0, 1.0]) == pytest.approx(
        math.sqrt(0.5)
    )


@pytest.mark.parametrize("ids, want", [([5, 6, -100, -100], [5, 6]), ([-100], []), ([5], [5]), ([], []), ([5, -100, 6], [5])])
def test_strip_pad(one, ids, want):
    assert one(arrays.strip_pad("v"), "v array<int>", ids) == want


def test_overlaps_equal_counts_of_grams(spark, monkeypatch):
    from collections import Counter

    from factweave.functions import overlap

    monkeypatch.setattr(overlap, "SLICE_WORDS", 100)
    rng = random.Random(1)

    def text():
        return " ".join(rng.choice(["a", "b", "cé", "", "d"]) for _ in range(rng.randrange(0, 30)))

    rows = [(i, text() if i % 17 else None, text() if i % 13 else None) for i in range(300)] + [(300, "x " * 500 + "y", "x " * 400)]
    df = spark.createDataFrame(rows, "i int, p string, t string").repartition(2)
    for r in df.withColumn("c", overlap.overlap_counts("p", "t")).collect():
        if r.p is None or r.t is None:
            assert r.c is None
            continue
        p, t = r.p.split(" "), r.t.split(" ")

        def grams(words, n):
            return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))

        assert (r.c.n_p, r.c.n_t) == (len(p), len(t))
        assert r.c.overlaps == [sum((grams(p, n) & grams(t, n)).values()) for n in (1, 2, 3, 4)]
    assert df.where("false").select(overlap.overlap_counts("p", "t")).count() == 0


def test_rollup_is_one_pass_over_all_groups(spark):
    from factweave.operators.scoring import evaluate, evaluate_rollup

    rows = [("a", "x", "p q", "p q"), ("a", "y", "p", "q"), ("b", "x", "r s", "r t"), ("b", None, "u", "u")]
    df = spark.createDataFrame(rows, "kind string, bucket string, prediction string, answer string")
    got = {(r.level, r.kind, r.bucket): (r.n, round(r.f1, 9)) for r in evaluate_rollup(df, ["kind", "bucket"]).collect()}
    want = {}
    for level, by in enumerate(([], ["kind"], ["kind", "bucket"])):
        for r in evaluate(df, by=by).collect():
            want[level, r["kind"] if level else None, r["bucket"] if level == 2 else None] = (r.n, round(r.f1, 9))
    assert got == want and len(want) == 7
    with pytest.raises(ValueError):
        evaluate_rollup(df, [])
