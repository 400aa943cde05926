from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factweave.llm import chunks, golay, rolling, suffix_array
from factweave.llm.components import components, first_by_hash
from factweave.llm.simhash import near_duplicates, one_of_each, simhash
from factweave.llm.substring_dedup import dedup_substrings, without_repeats
from factweave.llm.suffix_dedup import dedup_bytes


def removed(units: dict, width: int) -> dict:
    """Plain program: for each id, marks of the units covered by a window of an earlier id."""
    first, marks = {}, {}
    for i in sorted(units):
        unit = units[i]
        marks[i] = [False] * len(unit)
        for k in range(len(unit) - width + 1):
            if first.setdefault(tuple(unit[k : k + width]), i) < i:
                marks[i][k : k + width] = [True] * width
    return marks


def spans_of(mark: list[bool]) -> list[tuple[int, int]]:
    joined = "".join("x" if m else " " for m in mark)
    return [m.span() for m in re.finditer("x+", joined)]


def test_substrings_equal_a_plain_program(odd_docs, texts):
    units = {i: (t or "").encode().split() for i, t in texts.items()}
    marks = removed(units, 13)
    rows = dedup_substrings(odd_docs).select("doc.*", *[F.col(c).alias(f"r_{c}") for c in ("n_words", "n_removed", "spans", "kept")])
    got = rows.collect()
    assert len(got) == odd_docs.count() and sum(map(any, marks.values())) > 20
    for r in got:
        if r.doc_id is None:
            assert r.r_n_removed == 0 and r.r_kept == " ".join((r.text or "").split())
            continue
        kept = b" ".join(w for w, m in zip(units[r.doc_id], marks[r.doc_id], strict=True) if not m)
        assert (r.r_n_words, r.r_n_removed, r.r_kept) == (len(units[r.doc_id]), sum(marks[r.doc_id]), kept.decode())
        assert [tuple(s) for s in r.r_spans] == spans_of(marks[r.doc_id])
        assert r.kept == "y" and r.n_removed == 6  # own columns of the documents


def test_bytes_equal_a_plain_program(odd_docs, texts):
    units = {i: (t or "").encode() for i, t in texts.items()}
    marks = removed(units, 50)
    got = dedup_bytes(odd_docs).select("doc.doc_id", "doc.text", "n_bytes", "n_removed", "spans", "kept").collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0 and bytes(r.kept) == (r.text or "").encode()
            continue
        kept = bytes(b for b, m in zip(units[r.doc_id], marks[r.doc_id], strict=True) if not m)
        assert (r.n_bytes, r.n_removed, bytes(r.kept)) == (len(units[r.doc_id]), sum(marks[r.doc_id]), kept)
        assert [tuple(s) for s in r.spans] == spans_of(marks[r.doc_id])


def test_bytes_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    """Shuffles bring the rows of a chunk in another order at each reading; all readings agree."""
    rng = random.Random(2)
    shared = ["".join(rng.choice("abcdefgh é") for _ in range(120)) for _ in range(10)]
    texts = {}
    for i in range(200):
        cuts = [(rng.choice(shared), rng.randrange(60)) for _ in range(rng.randrange(5))]
        texts[i] = "".join(s[a : a + rng.randrange(90)] + "x" * rng.randrange(2) for s, a in cuts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(1)

    def shuffled(batches):
        for batch in batches:
            yield batch.sample(frac=1)

    monkeypatch.setattr(chunks, "CHUNK_BYTES", 8_000)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = dedup_bytes(docs.mapInPandas(shuffled, docs.schema)).select("doc.doc_id", "spans").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    marks = removed({i: t.encode() for i, t in texts.items()}, 50)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in got} == {i: spans_of(m) for i, m in marks.items()}


def test_other_widths(spark):
    rng = random.Random(1)
    texts = {i: "".join(rng.choice("ab ") for _ in range(rng.randrange(150))) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width in (19, 24):
        marks = removed({i: t.encode() for i, t in texts.items()}, width)
        got = {r.doc.doc_id: r.n_removed for r in dedup_bytes(docs, width=width).collect()}
        assert got == {i: sum(m) for i, m in marks.items()}
    with pytest.raises(ValueError):
        dedup_bytes(docs, width=10)


def test_empty_tables_give_empty_results(no_docs):
    assert dedup_substrings(no_docs).count() == 0
    assert dedup_bytes(no_docs).count() == 0
    assert near_duplicates(no_docs).count() == 0


def test_without_repeats_keeps_clean_texts_and_columns(odd_docs, texts):
    got = without_repeats(odd_docs)
    assert got.columns == odd_docs.columns
    rows = {r.doc_id: r.text for r in got.where("doc_id is not null").collect()}
    marks = removed({i: (t or "").encode().split() for i, t in texts.items()}, 13)
    for i, t in texts.items():
        if not any(marks[i]):
            assert rows[i] == t
        elif all(marks[i]):
            assert i not in rows


def test_white_space_stays_where_passages_go(spark):
    passage = " \t".join(f"w{i}" for i in range(15))
    rows = [
        (1, f"first {passage}"),
        (2, f"  Title line\n\n\tcode   block\n{passage}\n\n    é  tail\r\n"),
        (3, f"\n {passage} \n"),
        (4, f"{passage}\n\nmid  dle\n{passage}"),
    ]
    got = {r.doc_id: r.text for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "  Title line\n\n\tcode   block\né  tail\r\n", 4: "mid  dle\n"}


def test_intervals_by_hand():
    # Suffixes with common prefixes 5, 3, 5 between neighbours: two pairs inside one group of four.
    assert sorted(suffix_array.intervals([5, 3, 5])) == [(3, 0, 3), (5, 0, 1), (5, 2, 3)]
    assert suffix_array.intervals([4, 4]) == [(4, 0, 2)]
    parents = suffix_array.intervals([2, 6, 4])
    assert parents.index((2, 0, 3)) < parents.index((4, 1, 3)) < parents.index((6, 1, 2))


def test_run_hashes_depend_on_content_only():
    items = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    hashes = rolling.run_hashes(items, 3, 1)
    assert hashes[0] == hashes[3] and len(set(hashes.tolist())) == 4
    assert len(rolling.run_hashes(items, 8, 1)) == 0


def test_word_hashes_do_not_depend_on_place():
    (h,), owner = rolling.words_of([b"ab cd", b"", b" cd\x0bab "], (1,))
    assert h[0] == h[3] and h[1] == h[2] and owner.tolist() == [0, 0, 2, 2]


def test_long_texts_are_cut_alike(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000)).encode()
    (whole,), _ = rolling.words_of([text], (1,))
    monkeypatch.setattr(rolling, "PIECE", 500)
    (cut,), _ = rolling.words_of([text], (1,))
    assert np.array_equal(whole, cut)


def test_golay_code_is_perfect():
    decoder = golay.Decoder()
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    codes = np.array([c << 11 | golay._remainder(c << 11) for c in range(1 << 12)])
    nearest = np.bitwise_count(words[:, None] ^ codes[None, :])
    assert (nearest.min(axis=1) <= 3).all()
    assert np.array_equal(decoder.index(words), nearest.argmin(axis=1))
    near = {(int(a), int(b)) for a, b in decoder.nearby(words, 23)}
    for bit in range(23):
        own = decoder.index(words ^ (1 << bit))
        assert all((i, int(c)) in near for i, c in enumerate(own))


def plain_simhash(text, width=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprints(texts):
    for t in list(texts.values())[:70] + ["a b", "a b c", "Ä B"]:
        assert simhash(t) & (1 << 64) - 1 == plain_simhash(t)


def test_near_duplicates_equal_all_pairs(odd_docs, texts):
    prints = {i: plain_simhash(t) for i, t in texts.items()}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.id is not None:
            assert (r.fingerprint & (1 << 64) - 1, r.component) == (prints[r.id], root(r.id))
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {root(i) for i in ids} | {None}


def test_links_of_three_bits_are_all_found(spark):
    from factweave.llm.simhash import links

    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for bits in (1, 2, 3, 4):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints)]
    found = links(spark.createDataFrame(signed, "fingerprint long"))
    roots = {r.node: r.root for r in components(found).collect()}
    for (a,) in signed:
        for (b,) in signed:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                assert roots.get(a, a) == roots.get(b, b)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 120)}
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0


def test_digests_are_of_the_remaining_text(spark):
    docs = spark.createDataFrame([(1, "x " * 20), (2, "y " + "x " * 20)], "doc_id long, text string")
    row = dedup_substrings(docs).where("doc.doc_id = 2").select(F.sha2("kept", 256).alias("d")).first()
    assert row.d == hashlib.sha256(b"y").hexdigest()


def test_first_by_hash(spark):
    rows = spark.range(5_000).selectExpr("id", "id * 2 AS other")
    order = [r.id for r in rows.orderBy(F.shiftrightunsigned(F.xxhash64("id"), 1), "id").collect()]
    for most in (100, 2_500, 4_000, 9_000):
        got = first_by_hash(rows, most, "id")
        assert got.columns == ["id", "other"] and [r.id for r in got.collect()] == order[:most]
    assert first_by_hash(rows.where("false"), 10, "id").count() == 0
