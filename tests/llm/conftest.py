from __future__ import annotations

import random

import pytest

SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
ODD = (
    "doc_id long, text string, lang string, source string, n_chars long, chunk long, doc string, kept string,"
    " spans string, score double, predicted int, fingerprint string, component long, copy int, place string,"
    " id long, n_removed long, label string, words int, size double, _gone long, _source string, mean double"
)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def odd_row(doc_id, text, source="src0"):
    return (doc_id, text, "en", source, len(text or ""), 9, "x", "y", "z", 0.5, 1, "f", 3, 4, "p", 5, 6, "l", 7, 8.0, 1, "s", 2.0)


@pytest.fixture(scope="session")
def texts():
    """Texts with shared passages, copies, near copies and odd ones, by id."""
    rng = random.Random(5)
    shared = [" ".join(words(rng, n)) for n in (5, 14, 20, 60)]
    out = {}
    for i in range(60):
        parts = [" ".join(words(rng, rng.randrange(0, 70)))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), " ".join(words(rng, rng.randrange(0, 30)))]
        out[i * 3] = rng.choice([" ", "\n", " \t"]).join(parts)
    base = words(rng, 200)
    for i in range(8):
        near = list(base)
        near[rng.randrange(len(near))] = "changed"
        out[300 + i] = " ".join(near)
    out |= {400: "", 401: " \n\t", 402: "one", 403: "One", 404: "é" * 120, 405: "é" * 130, 406: "ab" * 70, 407: None}
    out[408] = " ".join(words(rng, 30_000))
    out[409] = out[408][5_000:90_000]
    return out


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """The texts with null ids, repeated rows and columns named like those of the operators."""
    rows = [odd_row(i, t, f"src{i % 7}" if i % 5 else None) for i, t in texts.items()]
    rows += [rows[0], rows[3], odd_row(None, texts[3]), odd_row(None, None)]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD)
