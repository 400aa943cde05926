from __future__ import annotations

import hashlib
import random
import re

import pytest
from check_oracles import compare, database
from factweave.llm import secret_scan, trigrams
from factweave.llm.queries_text import op11
from factweave.llm.secret_scan import RULES, Rule, Scanner, redacted, scan_secrets
from pyspark.sql import functions as F

PIECES = (
    "password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "\n", "AKIA", "AKIA2345ABCD", "QWERTYUIOPASDFGH",
    "abcdefghijkl", "0123456789abcdef", "0123456789abcde", "é", "日本", "ſecret=", "toKen=abcdefghijklm", "ghp_" + "a1B2" * 9, "github_pat_" + "x" * 40,
    "xoxb-1234567890", "AIza" + "Z" * 35, "sk_live_" + "9" * 16, "pk_test_", "://user:pass@", "://a", "eyJabcdefgh.ABCDEFGH.-_-_-_-_", "eyJ.", "\U0001f511",
    "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PGP PRIVATE KEY BLOCK-----", "-----BEGIN ",
)


def plain_spans(text, rules=RULES):
    """Plain program: every rule over the whole text."""
    found = []
    for n, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", r.flags):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), n, m.end(), m[r.group]))
    return sorted(found)


def plain_row(text):
    """Plain program of the contract, with its own expressions."""
    text, spans = text or "", []
    for kind, pattern, group, least in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    ):
        found = [m for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
        spans += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in found]
    counts = [sum(s[1] == k for s in spans) for k in range(3)]
    return (*counts, hashlib.sha256(",".join(s[2] for s in sorted(spans)).encode()).hexdigest())


@pytest.fixture(scope="module")
def secret_texts():
    rng = random.Random(12)
    out = {i: "".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for i in range(700)}
    out |= {800: None, 801: "", 802: "ab", 803: "x" * 300_000 + " token = " + "y" * 20, 804: "deadbeef" * 50_000, 805: "token=" * 20_000}
    return out


def test_index_finds_what_plain_scans_find(secret_texts):
    texts = [(t or "").encode() for t in secret_texts.values()]
    scanner = Scanner(RULES, *secret_scan.asked_by(RULES))
    found = scanner.scan(texts)
    assert found == [plain_spans(t) for t in secret_texts.values()]
    kinds = {k for spans in found for _, k, _, _ in spans}
    assert kinds == set(range(len(RULES)))
    # The index spares most verifications of rare rules, and none is spared for runs of digits.
    size = {r.kind: len(scanner.index.candidates(q)) for r, q in zip(RULES, scanner.queries, strict=True)}
    assert size["hex"] == len(texts) and all(n < len(texts) for k, n in size.items() if k != "hex")


def test_query_and_plain_program_agree(spark, secret_texts, tmp_path):
    rows = [(i, t) for i, t in secret_texts.items()] + [(None, "token=abcdefghijklmnop"), (0, secret_texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), *r[1:5]) for r in got) == sorted((str(i), *plain_row(t)) for i, t in rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        assert r.spans == ",".join(f"{RULES[k].kind}:{s}:{e}" for s, k, e, _ in plain_spans(text))


def test_sql_agrees_on_pieces(spark, secret_texts, tmp_path):
    rows = [(i, t) for i, t in secret_texts.items() if len(t or "") < 1000] + [(None, "passwd: 'abcdefghijklmnop")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    ok, note = compare("op11_secret_scan", spark, db, folder)
    assert ok, note


def test_sql_agrees_on_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    ok, note = compare("op11_secret_scan", spark, database(folder), folder)
    assert ok, note


PATTERNS = (
    "abc", "ab", "a(bc|de)f", "(abc|x)", "(abcd|xyz)+", "(ab){2}", "(ab){2,}c", "x?abc", "x*abc", "[ab]cd", "[a-z]cde", "[^a]bcd", "abc.def", "^abc$", "(?i:aBc)d",
    "(?:abc){0,1}def", "a{3}", "a{3,}", "(?=abc)abcd", "(abc)\\1", "ab|cd", "abc|abcd", "é[éè]x", "[abcdefgh][abcdefgh][abcdefgh]xyz", "abc(de)*?fgh", "(?>abc)d", "a++bcd",
)


def test_queries_are_necessary_for_every_match():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefxyzABCéè.") for _ in range(rng.randrange(0, 12))) for _ in range(4000)]
    texts += ["abcdef", "ababc", "xyzabcdxyz", "aaaa", "abcabc", "ABCD", "aBcd", "éèx", "hhhxyz", "abcdedefgh"]
    index = trigrams.query_of
    for pattern in PATTERNS:
        query = index(pattern)
        built = secret_scan.TrigramIndex(trigrams.trigrams_of(query))
        built.build([t.encode() for t in texts])
        possible = set(built.candidates(query).tolist())
        assert {i for i, t in enumerate(texts) if re.search(pattern, t)} <= possible, pattern


def test_queries_by_hand():
    q = trigrams.query_of
    assert q("abcd") == ("and", (b"abc", b"bcd")) and q("ABC") == b"abc"
    assert q("a(bc|de)f+") == ("or", (("and", (b"abc", b"bcf")), ("and", (b"ade", b"def"))))
    assert q("abc|abcd") == b"abc" and q("ab") is None and q("abc|d") is None and q("[0-9a-f]{16,}") is None
    assert q("abc.*xyz") == ("and", (b"abc", b"xyz")) and q("(abc|xyz)+") == ("or", (b"abc", b"xyz"))
    # Case of letters beyond ASCII: s, k and i fold into them unless the flag forbids it.
    assert q("(?i)ask") is None and q("ask", re.IGNORECASE | re.ASCII) == b"ask"


def test_segments_do_not_change_spans(spark, secret_texts):
    docs = spark.createDataFrame(list(secret_texts.items()), "doc_id long, text string")
    some = {r.doc_id: r.s for r in docs.select("doc_id", secret_scan.secret_spans(F.col("text"), segment_bytes=40).alias("s")).collect()}
    assert some == {r.doc.doc_id: r.spans for r in scan_secrets(docs).collect()}


def test_odd_rows_rules_and_empty_tables(spark, odd_docs, no_docs):
    got = scan_secrets(odd_docs)
    assert got.count() == odd_docs.count() and got.select("doc.*").columns == odd_docs.columns
    assert scan_secrets(no_docs).count() == 0
    own = (Rule("pin", "pin[0-9]+", 5),)
    rows = scan_secrets(spark.createDataFrame([(1, "pin12 pin1 PIN123"), (2, None)], "doc_id long, text string"), own).collect()
    assert [[tuple(s) for s in r.spans] for r in sorted(rows, key=lambda r: r.doc.doc_id)] == [[("pin", 0, 5, "pin12")], []]
    with pytest.raises(ValueError):
        scan_secrets(odd_docs, (Rule("a", "b"), Rule("a", "c")))


def test_redacted(spark):
    docs = spark.createDataFrame([(1, "é token=0123456789abcdef, ok 0123456789abcdef."), (2, "clean"), (3, None)], "doc_id long, text string")
    found = scan_secrets(docs).select("doc.doc_id", redacted(F.col("doc.text"), F.col("spans")).alias("t")).collect()
    assert {r.doc_id: r.t for r in found} == {1: "é [secret], ok [secret].", 2: "clean", 3: None}
