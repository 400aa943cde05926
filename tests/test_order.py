from __future__ import annotations

import hashlib

from collections import Counter

import pytest
from pyspark.sql import functions as F

from factweave.operators import order

NUMBERS = [0, 1, 2, 7, 8, 9, 10, 64, 65, 1 << 33, (1 << 33) + 1, (2 << 33) + 5]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(n, f"t{n}") for n in NUMBERS], "ord long, text string").repartition(3)


def _ords(df):
    return sorted(r.ord for r in df.collect())


@pytest.mark.parametrize("bits", [0, 1, 3, 16])
def test_dense_index(rows, bits):
    got = {r.ord: r.idx for r in order.dense_index(rows, bits=bits).collect()}
    assert got == {n: i for i, n in enumerate(NUMBERS)}


def test_dense_index_per_key(spark):
    df = spark.createDataFrame([(k, n) for k in "xy" for n in NUMBERS[: 5 if k == "x" else 9]], "k string, ord long")
    got = {(r.k, r.ord): r.idx for r in order.dense_index(df, keys=["k"], bits=2).collect()}
    assert got == {(k, n): i for k in "xy" for i, n in enumerate(NUMBERS[: 5 if k == "x" else 9])}


@pytest.mark.parametrize("lo, hi", [(0, 3), (2, 9), (9, 50), (50, 60), (4, 4), (0, 2_000_000)])
@pytest.mark.parametrize("bits", [1, 16])
def test_positional_split(rows, lo, hi, bits):
    got = order.positional_split(rows, lo, hi, bits=bits)
    assert _ords(got) == NUMBERS[lo:hi]
    assert {r.ord: r.idx for r in got.collect()} == {n: i for i, n in enumerate(NUMBERS) if lo <= i < hi}


def test_head_and_cap(rows):
    assert _ords(order.head_n(rows, 4)) == NUMBERS[:4]
    assert order.head_n(rows, 4).columns == ["ord", "text"]
    assert _ords(order.head_n(rows, 0)) == NUMBERS
    assert _ords(order.head_n(rows, -1)) == NUMBERS
    odd = [n for n in NUMBERS if n % 2]
    assert _ords(order.cap_matching(rows, F.col("ord") % 2 == 1, 3, bits=1)) == odd[:3]


def test_stride_and_shard(rows):
    assert _ords(order.stride(rows, 5, bits=1)) == NUMBERS[::5]
    assert _ords(order.shard(rows, 2, 64)) == [2, 7, 8, 9, 10]


def test_shuffles_compute_their_input_once_and_order_over_partitions(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    rows = spark.range(500).withColumnRenamed("id", "ord").mapInPandas(count, "ord long")
    found = order.seeded_shuffle(rows, seed=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    parts = found.withColumn("part", F.spark_partition_id()).collect()
    assert reads.value == 500
    hashes = [r.shuffle_key for r in parts]
    assert hashes == sorted(hashes) and [r.part for r in parts] == sorted(r.part for r in parts)
    sizes = Counter(r.part for r in parts)
    assert len(sizes) == 4 and max(sizes.values()) < 170


def test_seeded_shuffle_is_the_order_of_hashes(rows):
    got = [r.ord for r in order.seeded_shuffle(rows, seed=5).collect()]
    assert got == sorted(NUMBERS, key=lambda n: hashlib.md5(f"5:{n}".encode()).hexdigest())
    assert got != [r.ord for r in order.seeded_shuffle(rows, seed=6).collect()]


def test_epoch_order(rows):
    def places(**options):
        return {r.ord: r.idx for r in order.epoch_order(rows, **options).collect()}

    first, second = places(seed=1, epoch=0), places(seed=1, epoch=1)
    assert sorted(first.values()) == sorted(second.values()) == list(range(len(NUMBERS)))
    assert first != second and first == places(seed=1, epoch=0, bits=58)
    assert places() == {n: i for i, n in enumerate(NUMBERS)}


def test_batches_are_padded_to_their_longest(spark):
    rows = [(i, [1] * (i % 4), [2] * (i % 3)) for i in range(11)]
    df = spark.createDataFrame(rows, "ord long, input_ids array<int>, label_ids array<int>")
    batched = order.assign_batches(df, 4, bits=2)
    assert {r.ord: r.batch_id for r in batched.collect()} == {i: i // 4 for i in range(11)}
    for r in order.pad_batches(batched).collect():
        members = [x for x in rows if x[0] // 4 == r.batch_id]
        n_in, n_out = max(len(x[1]) for x in members), max(len(x[2]) for x in members)
        _, ids, labels = rows[r.ord]
        assert r.input_ids == ids + [0] * (n_in - len(ids))
        assert r.label_ids == labels + [-100] * (n_out - len(labels))


def test_slice_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "sorted")
    spark.range(0, 1 << 18).withColumnRenamed("id", "ord").withColumn("text", F.lit("x")).repartitionByRange(
        8, "ord"
    ).write.parquet(path)
    df = order.head_n(spark.read.parquet(path), 100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    wide_scan = [line for line in plan.splitlines() if "FileScan" in line and "text" in line]
    assert wide_scan and all("ord" in line and "Subquery" in line for line in wide_scan)
    assert _ords(df) == list(range(100))


def test_rows_without_a_place_are_not_dropped_in_silence(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y")], "ord long, text string")
    with pytest.raises(Exception, match="row without ord"):
        order.head_n(df, 1).collect()
