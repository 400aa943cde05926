from __future__ import annotations

import os

import pytest
from factweave.plans import results as results_of
from factweave.plans.queries_batches import stub_completer
from factweave.sources import table as tables
from factweave.sources.table import ResultTable
from factweave.streaming.incremental import decompose_stream
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("n", T.LongType())])


def rows(spark, *ids):
    return spark.createDataFrame([(str(i), i) for i in ids], SCHEMA).coalesce(1)


def found(table, **options):
    return sorted(r.n for r in table.read(**options).collect())


def files_below(path):
    return [f for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_a_new_table_is_empty(spark, tmp_path):
    table = ResultTable(spark, str(tmp_path / "t"), SCHEMA, "item_id")
    assert table.read().count() == 0 and table.read().columns == ["item_id", "n"] and table.versions() == []
    table.append(rows(spark, 1).where("false"))
    assert table.read().count() == 0 and table.versions() == [1]


def test_many_appends_leave_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    table = ResultTable(spark, path, SCHEMA, "item_id", buckets=2, fanout=3)
    for i in range(22):
        table.append(rows(spark, i, 1000 + i))
    assert found(table) == sorted([*range(22), *range(1000, 1022)])
    live = table.manifest().parts
    # 22 is 211 in base 3, and a level has as many parts as its digit says.
    assert sorted(live.values()) == [0, 1, 2, 2]
    assert len(table.versions()) <= tables.KEPT
    assert len(os.listdir(f"{path}/parts")) <= len(live) + 3 * tables.KEPT
    assert len(files_below(path)) <= 2 * (len(live) + 3 * tables.KEPT)
    assert [r.n for r in table.read(buckets=[0]).collect()] != [] and table.read(buckets=[0]).count() + table.read(buckets=[1]).count() == 44


def test_the_number_of_buckets_belongs_to_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    ResultTable(spark, path, SCHEMA, "item_id", buckets=3).append(rows(spark, *range(30)))
    again = ResultTable(spark, path, SCHEMA, "item_id", buckets=7)
    again.append(rows(spark, *range(30, 60)))
    buckets = {d for part in os.listdir(f"{path}/parts") for d in os.listdir(f"{path}/parts/{part}") if d.startswith("bucket")}
    assert buckets == {"bucket=0", "bucket=1", "bucket=2"} and found(again) == list(range(60))


def test_a_crash_before_the_manifest_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = ResultTable(spark, path, SCHEMA, "item_id", buckets=2)
    table.append(rows(spark, 1))
    with monkeypatch.context() as m:
        m.setattr(ResultTable, "_commit", lambda self, new: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.append(rows(spark, 2))
    assert found(table) == [1] and len(os.listdir(f"{path}/parts")) == 2
    table.append(rows(spark, 3))
    assert found(table) == [1, 3] and len(os.listdir(f"{path}/parts")) == 2


def test_a_crash_while_merging_leaves_all_rows(spark, tmp_path, monkeypatch):
    table = ResultTable(spark, str(tmp_path / "t"), SCHEMA, "item_id", buckets=2, fanout=2)
    table.append(rows(spark, 1))
    commit = ResultTable._commit

    def only_appends(self, new):
        if 1 in new.parts.values():
            raise OSError("lost")
        commit(self, new)

    with monkeypatch.context() as m:
        m.setattr(ResultTable, "_commit", only_appends)
        with pytest.raises(OSError):
            table.append(rows(spark, 2))
    assert found(table) == [1, 2]
    table.append(rows(spark, 3))
    assert found(table) == [1, 2, 3] and sorted(table.manifest().parts.values()) == [1]


def test_versions_batches_and_second_writers(spark, tmp_path):
    table = ResultTable(spark, str(tmp_path / "t"), SCHEMA, "item_id", buckets=2)
    assert table.append(rows(spark, 1), ("s", 0)) and table.append(rows(spark, 2), ("s", 1))
    assert not table.append(rows(spark, 2), ("s", 1)) and not table.append(rows(spark, 9), ("s", 0))
    assert table.append(rows(spark, 3), ("other", 0))
    assert found(table) == [1, 2, 3] and found(table, version=1) == [1] and found(table, version=2) == [1, 2]
    stale = table.manifest(2)
    with pytest.raises(RuntimeError, match="another writer"):
        table._commit(tables.replace(stale, version=3))
    assert found(table) == [1, 2, 3]
    for bad in ({"buckets": 0}, {"fanout": 1}):
        with pytest.raises(ValueError):
            ResultTable(spark, "x", SCHEMA, "item_id", **bad)


def test_chunks_are_dealt_over_the_cluster(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def finish(part):
        def count(batches):
            seen.add(1)
            yield from batches

        rows = part.mapInPandas(count, part.schema)
        return rows.withColumn("sub_sentences", F.array("sentence"))

    questions = spark.createDataFrame([(str(i), f"q{i}") for i in range(400)], "item_id string, sentence string")
    done = results_of.finish_in_chunks(questions, str(tmp_path / "o"), str(tmp_path / "w"), finish, tasks=13)
    assert done.count() == 400 and seen.value == 13


def _stream(spark, tmp_path, checkpoint="check", **options):
    query = decompose_stream(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), options.pop("ask"), str(tmp_path / checkpoint), "P", wait=0, buckets=2, **options
    )
    assert query.awaitTermination(120) and query.exception() is None


def test_a_replayed_batch_adds_and_asks_nothing(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def ask(prompt):
        calls.add(1)
        return stub_completer(prompt)

    def drop(*pairs):
        spark.createDataFrame(pairs, "item_id string, nature_question string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    drop(("a", "x"), ("a", "x"), ("b", "y"), (None, "z"), ("c", None))
    _stream(spark, tmp_path, ask=ask)
    drop(("a", "other"), ("d", "w"))
    _stream(spark, tmp_path, ask=ask)
    table = results_of.table_of(spark, str(tmp_path / "out"))
    assert sorted(r.item_id for r in table.read().collect()) == ["a", "b", "d"] and calls.value == 3
    # The batch is run again, as after a crash between the results and Spark's own mark.
    last = max(int(n) for n in os.listdir(tmp_path / "check" / "commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    before = table.versions()
    _stream(spark, tmp_path, ask=ask)
    assert calls.value == 3 and table.versions() == before and table.read().count() == 3


def test_stream_state_bounded_by_time(spark, tmp_path):
    rows = [("a", "x", "2026-01-01 00:00:00"), ("a", "x", "2026-01-01 01:00:00"), ("b", "y", "2026-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "item_id string, nature_question string, at string").coalesce(1)
    df.withColumn("at", F.to_timestamp("at")).write.json(str(tmp_path / "in"))
    _stream(spark, tmp_path, ask=stub_completer, event_time="at", delay="1 day")
    assert sorted(r.item_id for r in results_of.read_done(spark, str(tmp_path / "out")).collect()) == ["a", "b"]
