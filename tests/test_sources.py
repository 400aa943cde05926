from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from factweave.functions.text import is_decomposition, join_facts, render_prompt, split_facts
from factweave.plans import few_shot, trained
from factweave.plans import results as results_of
from factweave.schemas import QUESTIONS
from factweave.sources import corpus, fewshot, sinks
from factweave.streaming.incremental import decompose_stream

PROMPT = """sentence:
which lake is deepest in the north
decompose:
FACT1: ENTITY1 is a lake.
FACT2: ENTITY1 is in the north.
Question: Which ENTITY1 is deepest?

sentence:
is the tower older than the bridge
decompose:
FACT1: ENTITY1 is the tower.
FACT2: ENTITY2 is the bridge.
Question: Is ENTITY1 older than ENTITY2?

sentence:
[Input Sentence]
decompose:
"""


@pytest.fixture
def records(tmp_path):
    rows = [
        {"dataset": d, "split": s, "nature_question": f"n{i}", "synthesis_question": f"s{i}", "program": "p",
         "synthesis_question_paraphrases": [f"s{i} one", f"s{i} two"]}
        for i, (d, s) in enumerate([("A", "train"), ("A", "dev"), ("B", "train"), ("A", "train")])
    ]
    rows[0]["nature_question_sub_sentences"] = ["Question: n0?"]
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_read_and_ingest(spark, records, tmp_path):
    df = corpus.read_questions(spark, records)
    assert df.schema == QUESTIONS
    assert df.where(F.col("nature_question_sub_sentences").isNull()).count() == 3
    stored = corpus.ingest_questions(spark, records, str(tmp_path / "corpus"))
    rows = stored.orderBy("ord").collect()
    assert [r.nature_question for r in rows] == ["n0", "n1", "n2", "n3"]
    assert len({r.ord for r in rows}) == 4 and all(r.item_id for r in rows)
    with pytest.raises(ValueError):
        corpus.read_questions(spark, records, "pickle")


def test_sub_sentences_as_list_or_text(spark, tmp_path):
    rows = [
        {"ord": 1, "nature_question_sub_sentences": ['FACT1: "x".', "Question: y?"],
         "synthesis_question_sub_sentences": "FACT1: x. <FACT-SEP> Question: y? ",
         "synthesis_question_paraphrases_sub_sentences": [
             {"paraphrase": "p", "sub_sentences": "FACT1: x. <FACT-SEP> Question: y?"}, {"paraphrase": "q", "sub_sentences": []}]},
        {"ord": 2, "nature_question_sub_sentences": "FACT1: x\\. <FACT-SEP> Question: y?", "synthesis_question_sub_sentences": []},
    ]
    path = tmp_path / "mixed.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    df = corpus.read_questions(spark, str(path))
    assert df.schema == QUESTIONS
    first, second = df.orderBy("ord").collect()
    assert first.nature_question_sub_sentences == rows[0]["nature_question_sub_sentences"]
    assert first.nature_question_sub_sentences_text is None
    assert first.synthesis_question_sub_sentences == ["FACT1: x.", "Question: y?"]
    assert [tuple(e) for e in first.synthesis_question_paraphrases_sub_sentences] == [("p", ["FACT1: x.", "Question: y?"]), ("q", [])]
    assert second.nature_question_sub_sentences is None
    assert second.nature_question_sub_sentences_text == rows[1]["nature_question_sub_sentences"]
    assert second.synthesis_question_sub_sentences == [] and second.synthesis_question_paraphrases_sub_sentences is None


def test_registry_reads_one_folder(spark, records, tmp_path):
    root = str(tmp_path / "corpus")
    corpus.ingest_questions(spark, records, root)
    registry = corpus.Registry(root)
    train = registry.dataset(spark, "A", "train")
    assert sorted(r.nature_question for r in train.collect()) == ["n0", "n3"]
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    assert [r.question for r in registry.parser_examples(spark, "A", "train").collect()] == ["n0"]
    registry.register("B", "dev", root, "parquet", limit=2)
    assert registry.parser_examples(spark, "B", "dev").count() == 2
    registry.register("B", "test", records, "json")
    assert registry.dataset(spark, "B", "test").count() == 4
    with pytest.raises(ValueError):
        registry.dataset(spark, "A", "other")
    with pytest.raises(KeyError):
        corpus.Registry().dataset(spark, "A", "dev")


def test_no_limits_unless_registered():
    assert corpus.Registry().limits == {}


def _lines(path, rows):
    with open(path, "w") as f:
        f.write("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_a_text_may_start_with_a_bracket(spark, tmp_path):
    text = "[ENTITY1] is x <FACT-SEP> Question: y?"
    _lines(tmp_path / "a.json", [{"nature_question_sub_sentences": text, "synthesis_question_sub_sentences": text}, {"nature_question_sub_sentences": ["[a]"]}])
    first, second = corpus.read_questions(spark, str(tmp_path / "a.json")).collect()
    assert (first.nature_question_sub_sentences, first.nature_question_sub_sentences_text) == (None, text)
    assert first.synthesis_question_sub_sentences == ["[ENTITY1] is x", "Question: y?"]
    assert (second.nature_question_sub_sentences, second.nature_question_sub_sentences_text) == (["[a]"], None)


def test_a_broken_line_is_an_error(spark, tmp_path):
    _lines(tmp_path / "a.json", [{"program": "p"}, '{"program": "q"'])
    with pytest.raises(Exception):
        corpus.read_questions(spark, str(tmp_path / "a.json")).collect()


def test_places_follow_file_names_and_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for name, n in (("a", 3), ("b", 50), ("c", 10)):
        rows = [{"program": f"{name}{i}", "dataset": "d", "split": "train"} for i in range(n)]
        _lines(folder / f"{name}.jsonl", rows)
        want += [r["program"] for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    try:
        rows = corpus.ingest_questions(spark, str(folder), str(tmp_path / "out")).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.program for r in rows] == want
    assert [(r.ord, r.item_id) for r in rows] == [(i, str(i)) for i in range(63)]


@pytest.mark.parametrize("given, message", [([1, None, None], "all or none"), ([1, 2, 1], "given 2 times")])
def test_mixed_and_repeated_places_are_an_error(spark, tmp_path, given, message):
    _lines(tmp_path / "a.json", [{"program": "p"} | ({} if o is None else {"ord": o}) for o in given])
    with pytest.raises(ValueError, match=message):
        corpus.ingest_questions(spark, str(tmp_path / "a.json"), str(tmp_path / "out"))


def test_numbering_moves_no_rows(spark, records, tmp_path):
    """Rows get their place where they are read: no exchange but those of the table of pieces."""
    raw = spark.read.schema(corpus.JSON_QUESTIONS).json(records)
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from")]
    placed = raw.select("*", *where, F.monotonically_increasing_id().alias("_read"))
    corpus._pieces(placed).write.parquet(str(tmp_path / "pieces"))
    pieces = spark.read.parquet(str(tmp_path / "pieces"))
    plan = corpus._in_file_order(placed, pieces, 100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert all("SinglePartition" in line for line in exchanges)  # the window over pieces
    with pytest.raises(Exception, match="read in other pieces"):
        wrong = pieces.withColumn("_first", F.col("_first") + 1)
        corpus._in_file_order(placed, wrong, 100).collect()
    spread_out = corpus._in_file_order(placed, pieces, corpus.PIECES_BYTES + 1)
    assert sorted(r.ord for r in spread_out.collect()) == [0, 1, 2, 3]


def test_few_shot_file(spark, tmp_path):
    path = tmp_path / "prompt"
    path.write_text(PROMPT)
    examples = fewshot.read_examples(spark, str(path))
    rows = examples.orderBy("example_no").collect()
    assert [(r.example_no, r.sentence, len(r.sub_sentences)) for r in rows] == [
        (0, "which lake is deepest in the north", 3), (1, "is the tower older than the bridge", 3)]
    assert examples.where(is_decomposition("sub_sentences")).count() == 2
    back = examples.select("sub_sentences", split_facts(join_facts("sub_sentences")).alias("b"))
    assert back.where("b = sub_sentences").count() == 2
    prefix = fewshot.prompt_prefix(examples)
    prompt = spark.range(1).select(render_prompt(prefix, F.lit("[Input Sentence]")).alias("p")).first().p
    assert prompt + "\n" == PROMPT


def test_a_table_is_no_prompt(spark):
    many = spark.range(1_001).selectExpr("CAST(id AS INT) AS example_no", "'s' AS sentence", "array('Question: x?') AS sub_sentences")
    with pytest.raises(ValueError):
        fewshot.prompt_prefix(many)


def test_spread_only_where_it_is_set(spark):
    rows = spark.range(100)
    assert corpus.spread(rows, "id") is rows
    spark.conf.set(corpus.SCAN_TASKS, "3")
    try:
        assert corpus.spread(rows, "id").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(corpus.SCAN_TASKS)


def test_records_report_and_metrics(spark, tmp_path):
    records = spark.createDataFrame([(2, "q2", "x", "y"), (1, "q1", "x", "x")], "ord long, question string, prediction string, answer string")
    items = spark.createDataFrame([(1, "s1", "n1"), (2, None, "n2")], "ord long, synthesis_question string, nature_question string")
    lines = sinks.report_lines(records, items)
    sinks.write_report(lines, str(tmp_path / "report"))
    text = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    block = ["=" * 20, "synthetic :s1", "natural   :n1", "question  :q1", "prediction:x", "gold      :x", "True"]
    assert sorted(text) == sorted(block + ["=" * 20, "synthetic :None", "natural   :n2", "question  :q2", "prediction:x", "gold      :y", "False"])
    sinks.write_records(records, str(tmp_path / "records"), "json")
    assert sorted(spark.read.json(str(tmp_path / "records")).columns) == ["answer", "prediction", "question"]
    row = spark.createDataFrame([("r", 1, "f1", 0.5)], "run string, step long, tag string, value double")
    for _ in range(2):
        sinks.append_metrics(row, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def _completer(calls, reject=()):
    def ask(prompt):
        calls.add(1)
        assert prompt.startswith(PREFIX) and prompt.endswith("\ndecompose:")
        sentence = prompt[len(PREFIX + "sentence:\n") : -len("\ndecompose:")]
        return "no label" if sentence in reject else f"\nFACT1: {sentence}\n\n Question: what?\nsentence:\nmore"

    return ask


PREFIX = fewshot.block("s", ["Question: s?"])


def test_resumed_run_asks_nothing_twice(spark, records, tmp_path):
    out, work = str(tmp_path / "out"), str(tmp_path / "work")
    items = corpus.ingest_questions(spark, records, str(tmp_path / "corpus"))
    questions = few_shot.training_questions(items)
    calls = spark.sparkContext.accumulator(0)
    ask = _completer(calls, reject=("s2 one",))
    half = questions.where(F.col("sentence").isin("s0 one", "s2 one"))
    few_shot.decompose_corpus(half, out, work, ask, PREFIX, chunk_rows=1, wait=0)
    assert calls.value == 2
    done = few_shot.decompose_corpus(questions, out, work, ask, PREFIX, chunk_rows=2, wait=0)
    assert calls.value == 4
    got = {r.sentence: r.sub_sentences for r in done.collect()}
    assert got == {f"s{i} one": [f"FACT1: s{i} one", "Question: what?"] if i != 2 else [] for i in range(4)}
    few_shot.decompose_corpus(questions, out, work, ask, PREFIX, wait=0)
    assert calls.value == 4 and not any(files for _, _, files in os.walk(work))
    attached = {r.nature_question: r for r in results_of.attach_training(items, done).collect()}
    entry = attached["n1"].synthesis_question_paraphrases_sub_sentences
    assert [tuple(e) for e in entry] == [("s1 one", ["FACT1: s1 one", "Question: what?"])]
    again = few_shot.decompose_corpus(questions, out, work, _completer(calls), PREFIX, retry_rejected=True, wait=0)
    assert calls.value == 5
    assert again.where(F.size("sub_sentences") > 0).count() == 4


def test_validation_questions(spark, records):
    items = corpus.read_questions(spark, records).withColumn("item_id", F.col("nature_question"))
    asked = few_shot.validation_questions(items)
    got = {r.item_id: r.sentence for r in asked.collect()}
    assert got == {"n0": "n0", "n1": "s1", "n2": "n2", "n3": "n3"}
    results = asked.withColumn("sub_sentences", F.array("sentence"))
    rows = {r.item_id: r for r in results_of.attach_validation(items, results).collect()}
    assert rows["n1"].synthesis_question_sub_sentences == ["s1"] and rows["n1"].nature_question_sub_sentences is None
    assert rows["n2"].nature_question_sub_sentences == ["n2"] and rows["n2"].synthesis_question_sub_sentences is None
    assert rows["n0"].nature_question_sub_sentences == ["Question: n0?"]


def test_resumed_model_run(spark, tmp_path):
    out = str(tmp_path / "out")
    calls = spark.sparkContext.accumulator(0)

    def model():
        def predict(texts):
            calls.add(len(texts))
            return [f"<pad> FACT1: {t}. <FACT-SEP> Question: {t}?</s>" for t in texts]

        return predict

    questions = spark.createDataFrame([(str(i), f"q{i}") for i in range(6)], "item_id string, sentence string")
    work = str(tmp_path / "work")
    trained.decompose_corpus(questions.where("item_id < '2'"), out, work, model)
    done = trained.decompose_corpus(questions, out, work, model, chunk_rows=2)
    assert calls.value == 6
    assert {r.item_id: r.sub_sentences for r in done.collect()} == {
        str(i): [f"FACT1: q{i}.", f"Question: q{i}?"] for i in range(6)
    }


def test_resumed_paraphrase_run(spark, tmp_path):
    out, work = str(tmp_path / "out"), str(tmp_path / "work")
    calls = spark.sparkContext.accumulator(0)

    def model():
        def predict(texts):
            calls.add(len(texts))
            return [f"<pad> FACT1: {t}. <FACT-SEP> Question: {t}?</s>" for t in texts]

        return predict

    result = "synthesis_question_paraphrases_sub_sentences"
    schema = f"item_id string, synthesis_question_paraphrases array<string>, {result} array<struct<paraphrase: string, sub_sentences: array<string>>>"
    rows = [(str(i), [f"{i}{c}" for c in "abcd"], None) for i in range(5)] + [("5", ["x"], [("x", ["old"])]), ("6", None, None), ("7", [], None)]
    items = spark.createDataFrame(rows, schema)
    trained.decompose_paraphrase_corpus(items.where("item_id < '2'"), out, work, model, 3)
    assert calls.value == 6
    got = {r.item_id: r[result] for r in trained.decompose_paraphrase_corpus(items, out, work, model, 3, chunk_rows=2).collect()}
    assert calls.value == 15
    for i in range(5):
        assert [tuple(e) for e in got[str(i)]] == [(f"{i}{c}", [f"FACT1: {i}{c}.", f"Question: {i}{c}?"]) for c in "abc"]
    assert got["5"] == [("x", ["old"])] and got["6"] is None and got["7"] == []


def test_stream_decomposes_new_files_only(spark, tmp_path):
    incoming, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "check"))
    calls = spark.sparkContext.accumulator(0)

    def drop(name, ids):
        rows = [{"item_id": str(i), "nature_question": f"n{i}", "other": 1} for i in ids]
        df = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1))
        df.write.mode("append").json(incoming)

    def run():
        query = decompose_stream(spark, incoming, out, _completer(calls), checkpoint, PREFIX, wait=0)
        assert query.awaitTermination(120)
        assert query.exception() is None

    drop("first", [1, 2])
    run()
    assert calls.value == 2
    drop("second", [2, 3])
    run()
    run()
    assert calls.value == 3
    rows = results_of.read_done(spark, out).orderBy("item_id").collect()
    assert [(r.item_id, r.sub_sentences[0]) for r in rows] == [(str(i), f"FACT1: n{i}") for i in (1, 2, 3)]
