from __future__ import annotations

import math

import numpy as np
import pytest
from check_oracles import compare, database
from factweave.llm import hard_negatives as hn
from factweave.llm.threshold_join import Index
from pyspark.sql import functions as F



def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hn.hard_negatives(df, F.col("id") % 100 == 0, label)


def plain_negatives(rows, k=5, m=10):
    """Plain program: all scores of every anchor. Rows are (id, label, vector)."""
    kept = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        row = (str(label), [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, row), row)
    out = []
    for a, (label, x) in kept.items():
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), i, other) for i, (other, y) in kept.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:k]:
            inside = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(inside[:m])]
    return sorted(out)


def found_in(df):
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 20))
    rows = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 20)) * 0.7
    rows[300:600] = rows[300]  # a third are copies, of several labels
    rows /= np.sqrt((rows * rows).sum(axis=1))[:, None]
    labels = rng.integers(0, 9, 900)
    labels[200:203] = 9  # a rare label
    return [(i, int(n), [float(x) for x in np.float32(v)]) for i, (n, v) in enumerate(zip(labels, rows, strict=True))]


SCHEMA = "vec_id long, label int, embedding array<float>"


def test_negatives_equal_plain_program_over_tiles(spark, clustered, monkeypatch):
    monkeypatch.setattr(hn, "PART_ROWS", 130)
    monkeypatch.setattr(hn, "BLOCK_ANCHORS", 4)
    df = spark.createDataFrame(clustered, SCHEMA)
    got = found_in(mined(df))
    assert got == plain_negatives(clustered) and len({r[0] for r in got}) == 9


def test_negatives_of_odd_rows(spark, clustered):
    rows = clustered[:260]
    zero = [0.0] * 20
    rows += [rows[0], rows[100], (200, 3, zero), (None, 1, zero), (1000, None, zero), (1001, 1, None), (1002, 1, [None] * 20), (1003, 1, [float("nan")] * 20)]
    rows += [(1004, 1, [float("inf")] * 20), (1100, 4, []), (1200, 5, [0.5, -0.25]), (1201, 5, zero), (1202, 6, zero), (1203, 7, [0.0, 0.0])]
    rows += [(1300, 8, [-1.0] * 20), (1301, 8, [1.0] * 20)]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", rank int, x string, threshold double")
    assert found_in(mined(df)) == plain_negatives(rows)


def test_negatives_of_large_and_few_vectors(spark):
    rows = [(100, 0, [3.0e5] * 4), (1, 0, [2.0e5] * 4), (2, 1, [1.0e5] * 4), (3, 1, [1.0e5, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert found_in(mined(df)) == plain_negatives(rows)
    assert mined(df.where("vec_id = 100")).count() == 0
    assert mined(df.where("false")).count() == 0


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.01"
    ok, note = compare("op12_hard_negatives", spark, database(folder), folder)
    assert ok, note


def test_index_finds_all_at_the_threshold_and_leaves_the_rest_out():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(400, 21)) * rng.random((400, 1))).astype(np.int64)
    rows[50:60] = rows[40]
    rows[60] = 0
    queries = np.floor(256 * rng.normal(size=(10, 21))).astype(np.int64)
    queries[9] = rows[40]
    norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    for share in (0.9, 0.5, 0.2):
        threshold = norms * share * 256 * 4
        index = Index(rows, (threshold / norms).min())
        assert index.posted[0] < index.posted[-1] < len(rows)
        for q, t in zip(queries, threshold, strict=True):
            places, scores = index.at_least(q, t)
            want = rows @ q
            assert sorted(places.tolist()) == np.flatnonzero(want >= t).tolist() and (scores == want[places]).all()
    whole = Index(rows, 0.0)
    for t in (0.0, -5000.0, float("-inf")):
        assert sorted(whole.at_least(queries[0], t)[0].tolist()) == np.flatnonzero(rows @ queries[0] >= t).tolist()


def test_exact_products_of_long_vectors():
    rows = np.array([[2**31, 2**31 - 1], [2**31 + 1, 5], [-(2**31), 3]], np.int64)
    index = Index(rows, 0.0)
    places, scores = index.at_least(rows[1], float("-inf"))
    want = [sum(int(a) * int(b) for a, b in zip(r, rows[1], strict=True)) for r in rows]
    assert [int(s) for _, s in sorted(zip(places, scores, strict=True))] == want
