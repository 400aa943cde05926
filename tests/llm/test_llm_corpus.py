from __future__ import annotations

import hashlib
import math
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__  # noqa: E402
import corpus_pipeline  # noqa: E402
from check_oracles import compare, database  # noqa: E402
from factweave.llm import mixing, toxicity  # noqa: E402
from factweave.llm.queries_corpus import OTHER, WEIGHTS  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_llm_dedup import plain_simhash, removed  # noqa: E402
from test_llm_text import shares  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain_copies(doc_id, mean, seed=mixing.SEED):
    parts = max(math.ceil(mean / mixing.MAX_MEAN), 1)
    total = 0
    for part in range(1, parts + 1):
        name = "" if doc_id is None else doc_id
        u = int(hashlib.md5(f"{seed}:{name}:{part}".encode()).hexdigest()[:13], 16) / 2**52
        p = sum_ = math.exp(-mean / parts)
        k = 0
        while sum_ <= u:
            k += 1
            p = p * (mean / parts) / k
            sum_ += p
        total += k
    return total


def plain_means(sources, weights, other, rows_out=None):
    mixed = [s if s in weights else None for s in sources]
    kinds = set(mixed)
    total = sum(weights.get(s, other) for s in kinds)
    wanted = len(mixed) if rows_out is None else rows_out
    return {s: wanted * weights.get(s, other) / total / mixed.count(s) for s in kinds}


def test_copies_equal_a_plain_program(odd_docs, no_docs):
    weights = {"src0": 1.0, "src1": 3.0, "src2": 0.0, "absent": 5.0}
    rows = odd_docs.select("doc_id", "source").collect()
    means = plain_means([r.source for r in rows], weights, 0.5)
    want = {}
    for r in rows:
        n = plain_copies(r.doc_id, means[r.source if r.source in weights else None])
        for c in range(1, n + 1):
            want[r.doc_id, c] = want.get((r.doc_id, c), 0) + 1
    got = mixing.poisson_mix(odd_docs, weights, 0.5).select("doc.doc_id", "copy", "place", "doc.place").collect()
    counts = {}
    for r in got:
        counts[r.doc_id, r["copy"]] = counts.get((r.doc_id, r["copy"]), 0) + 1
    assert counts == want
    assert [r[2] for r in got] == sorted(r[2] for r in got) and {r[3] for r in got} == {"p"}
    assert mixing.poisson_mix(no_docs, weights).count() == 0
    with pytest.raises(ValueError):
        mixing.poisson_mix(odd_docs, {"src0": -1.0})


def test_large_rates_and_shares(spark):
    rows = [(i, "a") for i in range(4)] + [(i, "b") for i in range(4, 1004)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.poisson_mix(docs, {"a": 3.0, "b": 1.0}, rows_out=8000).groupBy("doc.source").count().collect()
    counts = {r.source: r["count"] for r in got}
    assert counts["a"] == sum(plain_copies(i, 1500) for i in range(4))
    assert abs(counts["a"] - 6000) < 300 and abs(counts["b"] - 2000) < 200


@tables
def test_mixing_equals_its_sql(spark):
    ok, note = compare("op5_poisson_mixing", spark, database(FOLDER), FOLDER)
    assert ok, note


def test_mixing_equals_sql_with_absent_and_unnamed_sources(spark, tmp_path):
    import duckdb

    rows = [(i, f"t{i}", "en", [None, "other", "src1", "src7"][i % 4], 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ok, note = compare("op5_poisson_mixing", spark, db, str(tmp_path))
    assert ok and not note.startswith("0 rows"), note


def test_each_operator_has_one_query():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


@tables
def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, states, df = docs.columns, [rows_of(docs)], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(stage(spark, df, FOLDER).collect(), docs.schema)
        assert df.columns == columns, name
        states.append(rows_of(df))
    start, clean, single, cut, safe = states

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = toxicity.toxicity(docs, labels, F.lit(False)).select("doc.doc_id", "predicted").collect()
    assert set(clean) == {r.doc_id for r in scores if not r.predicted} and len(clean) < len(start)
    assert all(clean[i] == start[i] for i in clean)

    prints = {i: plain_simhash(r.text) for i, r in clean.items()}
    least = {i: i for i in prints}
    near = {i: [j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3] for i in prints}
    while (new := {i: min(least[j] for j in near[i]) for i in prints}) != least:
        least = new
    assert set(single) == {i for i in prints if least[i] == i} and len(single) < len(clean)

    marks = removed({i: r.text.encode().split() for i, r in single.items()}, 13)
    for i, r in single.items():
        # Removed words go with the white space after them, and nothing else does.
        lead, words = re.match(rb"\s*", r.text.encode()).group(), re.findall(rb"\S+\s*", r.text.encode())
        words = [w for w, m in zip(words, marks[i], strict=True) if not m]
        if not any(marks[i]):
            assert cut[i] == r
        elif words:
            left = (lead + b"".join(words)).decode()
            assert (cut[i].text, cut[i].n_chars) == (left, len(left))
        else:
            assert i not in cut
    assert any(any(m) for m in marks.values())

    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    held = {i for (i, _), s in shares({i: r.text for i, r in cut.items()}, items).items() if s >= 0.8}
    assert set(safe) == set(cut) - held and held

    means = plain_means([r.source for r in safe.values()], WEIGHTS, OTHER)
    mixed = corpus_pipeline.STAGES[-1][1](spark, df, FOLDER).collect()
    counts = {}
    for r in mixed:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    want = {i: plain_copies(i, means[r.source]) for i, r in safe.items()}
    assert counts == {i: n for i, n in want.items() if n}
    whole = sorted((r.doc_id, r["copy"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert whole == sorted((r.doc_id, r["copy"]) for r in mixed)


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(0, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "no such words as these in it"), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        df = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, folder)
            assert df.columns == docs.columns
            df = spark.createDataFrame(df.collect(), docs.schema)
        assert df.where("doc_id is null").count() == docs.where("doc_id is null").count()
        last = corpus_pipeline.STAGES[-1][1](spark, df, folder)
        assert last.columns == docs.columns and (last.count() > 0) == (df.count() > 0)
