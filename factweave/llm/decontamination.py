"""Benchmark decontamination: a BM25 index of test items, asked by every passage of every document.

The index is on the items, not the documents. Impacts of an item's terms are divided by the item's
score against itself, so a threshold is a share of the item. A passage asks with its different terms;
block-max WAND finds every item at or above the threshold: terms whose greatest impacts together stay
below the threshold cannot lift an item alone, so only blocks of items with a posting of another term
are looked at; a block is scored only if its terms' greatest impacts in the block reach the threshold.
What is found is verified twice: five-word shingles of the whole item must overlap, and the passage must hold
enough words of both question and answer. Items have no fields of their own for the two, so the last sentence is
taken as the answer; one missing word never decides (a short answer may be that word), half of a part's words do.

Document frequency and mean length are those of all items, counted in Spark, so a score does not depend on how items
fall into blocks.

Passages are two strides long and a stride is as long as the longest item, so each copy of an item
lies inside a passage. Items are indexed in blocks of about half ``INDEX_BYTES`` of text, and a task
or the driver holds the index of one block at a time, however many items there are.

Contract for odd input: null and empty texts match nothing; items without words are
no items; items without an id are looked for like any other and reported with a null id; an item with fewer words than a shingle is one shingle; a question or answer that holds none
has an overlap of one; equal items are reported each; a null
document id is kept; of several passages with one item the best score counts, then the first.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm.components import shared_folder, stored

K1, B = 1.2, 0.75
MIN_SCORE = 0.5
SHINGLE = 5
SIMILARITY = 0.8
PART = 0.5  # share of a part's words which a passage holds at least, but for one word
BLOCK = 8
PASSAGES = 64  # asked at a time
INDEX_BYTES = 8 << 20
MAX_KNOWN = 200_000
_WORD = re.compile(r"\w+")
_BREAK = re.compile(r"[.!?\n]\s+(?=\S)")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts_of(text: str) -> tuple[list[str], int]:
    """Words of an item and how many of them are the question: all up to the last sentence, or, of
    one sentence, the first three quarters."""
    words, cut = words_of(text), 0
    for found in _BREAK.finditer(text):
        cut = len(words_of(text[: found.end()]))
    return words, cut if 0 < cut < len(words) else -(-3 * len(words) // 4)


def _shingles(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word codes; of all codes if there are fewer."""
    width = min(width, len(codes))
    if not width:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ codes[k : len(codes) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _code(word: str) -> int:
    data = word.encode()
    return zlib.crc32(data) << 32 | zlib.adler32(data) ^ len(data) << 24


@dataclass
class Match:
    item: int
    passage: int
    score: float
    overlap: float
    question_overlap: float
    answer_overlap: float


@dataclass
class Statistics:
    """Of all items, however they are indexed: their number, mean length, and how many hold each term."""

    items: int
    mean_length: float
    frequency: dict[str, int]


class Index:
    """Postings by term, items in blocks, and the greatest impact of each term by block."""

    def __init__(self, texts: list[str], statistics: Statistics | None = None):
        items = [parts_of(t) for t in texts]
        self.terms: dict[str, int] = {}
        rows = [sorted({self.terms.setdefault(w, len(self.terms)) for w in words}) for words, _ in items]
        counts = [np.bincount([self.terms[w] for w in words], minlength=1) for words, _ in items]
        lengths = np.array([len(words) for words, _ in items], float)
        n_terms, n = len(self.terms), len(items)
        if statistics is None:
            frequency, n_items, mean_length = np.bincount(np.concatenate([np.array(r, int) for r in rows]), minlength=n_terms), n, lengths.mean()
        else:
            frequency, n_items, mean_length = np.array([statistics.frequency[t] for t in self.terms]), statistics.items, statistics.mean_length
        idf = np.log(1 + (n_items - frequency + 0.5) / (frequency + 0.5))
        term, item, impact = [], [], []
        for i, row in enumerate(rows):
            at = np.array(row, int)
            tf = counts[i][at]
            own = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[i] / mean_length))
            term.append(at)
            item.append(np.full(len(at), i))
            impact.append(own / own.sum())
        term, item, impact = np.concatenate(term), np.concatenate(item), np.concatenate(impact)
        order = np.lexsort((item, term))
        self.item, self.impact = item[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(n_terms + 1))
        key = term[order] * (n // BLOCK + 1) + self.item // BLOCK
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.block, self.block_max = self.item[start] // BLOCK, np.maximum.reduceat(self.impact, start)
        self.block_first = np.searchsorted(term[order][start], np.arange(n_terms + 1))
        self.most = np.maximum.reduceat(self.impact, self.first[:-1])
        self.n, self.blocks, self.stride = n, n // BLOCK + 1, int(lengths.max())
        self.shingles, self.question, self.parts = [], [], []
        self.width = [min(SHINGLE, len(words)) for words, _ in items]
        for words, cut in items:
            coded = np.array([_code(w) for w in words], np.uint64)
            self.shingles.append(_shingles(coded, SHINGLE))
            self.parts.append((np.unique(coded[:cut]), np.unique(coded[cut:])))
            # A shingle belongs to the question if it begins there, to the answer if it ends there.
            starts = np.arange(len(self.shingles[-1]))
            self.question.append((starts < cut, starts + min(SHINGLE, len(words)) > cut))

    @staticmethod
    def _gather(first: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Places of all entries of some terms."""
        start, size = first[terms], first[terms + 1] - first[terms]
        return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, passages: int, least: float) -> list[tuple[int, int, float]]:
        """All (passage, item, score) with a score of at least ``least``, for passages given by rows
        (passage, term) without repeats."""
        most = self.most[term]
        order = np.lexsort((most, passage))
        sums = np.cumsum(most[order])
        begin = np.searchsorted(passage[order], np.arange(passages))
        before = np.append(0.0, sums)[begin][passage[order]]
        essential = order[sums - before >= least - 1e-9]
        if not len(essential):
            return []
        seen = np.zeros(passages * self.blocks, bool)
        cell, _ = self._cells(passage[essential], term[essential])
        seen[cell] = True
        cell, at = self._cells(passage, term)
        bound = np.bincount(cell, self.block_max[at], len(seen))
        chosen = (seen & (bound >= least - 1e-9)).reshape(passages, self.blocks)
        found = []
        for p in np.flatnonzero(chosen.any(axis=1)):
            at = self._gather(self.first, term[passage == p])
            inside = chosen[p][self.item[at] // BLOCK]
            score = np.bincount(self.item[at[inside]], self.impact[at[inside]], self.n)
            found.extend((int(p), int(i), float(score[i])) for i in np.flatnonzero(score >= least - 1e-9))
        return found

    def _cells(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage and block, place) of each block entry of some rows."""
        at = self._gather(self.block_first, term)
        size = self.block_first[term + 1] - self.block_first[term]
        return np.repeat(passage, size) * self.blocks + self.block[at], at


class Scanner:
    """Asks an index with every passage of a text."""

    def __init__(self, index: Index, least: float, similarity: float):
        self.index, self.least, self.similarity = index, least, similarity
        self.codes: dict[str, int] = {}

    def matches(self, text: str | None) -> list[Match]:
        index, words = self.index, words_of(text or "")
        found = np.array([index.terms.get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(found >= 0)
        if not len(at):
            return []
        stride, best = index.stride, {}
        half = at // stride
        last = max(1, int(half[-1]))  # passages: two strides each, the last one ends with the text
        codes = None
        for low in range(0, last, PASSAGES):
            inside = slice(*np.searchsorted(half, (low, low + PASSAGES + 1)))
            here, term = half[inside] - low, found[at[inside]]
            n = min(PASSAGES, last - low)
            rows = np.concatenate([here[here < n] * len(index.terms) + term[here < n], (here[here > 0] - 1) * len(index.terms) + term[here > 0]])
            passage, terms = np.divmod(np.unique(rows), len(index.terms))
            for p, item, score in index.retrieve(passage, terms, n, self.least):
                if codes is None:
                    codes = self._codes(words)
                begin = (low + p) * stride
                match = self._verified(item, low + p, score, codes[begin : begin + 2 * stride])
                if match and (item not in best or score > best[item].score):
                    best[item] = match
        return [best[i] for i in sorted(best)]

    def _codes(self, words: list[str]) -> np.ndarray:
        if len(self.codes) > MAX_KNOWN:
            self.codes.clear()
        for w in words:
            if w not in self.codes:
                self.codes[w] = _code(w)
        return np.array([self.codes[w] for w in words], np.uint64)

    def _verified(self, item: int, passage: int, score: float, codes: np.ndarray) -> Match | None:
        wanted = self.index.shingles[item]
        width = self.index.width[item]
        if len(codes) < width:
            return None
        hit = np.isin(wanted, _shingles(codes, width))
        question, answer = (float(hit[p].mean()) if p.any() else 1.0 for p in self.index.question[item])
        if hit.mean() < self.similarity:
            return None
        for part in self.index.parts[item]:
            if np.isin(part, codes, invert=True).sum() > max(1.0, (1 - PART) * len(part)):
                return None
        return Match(item, passage, score, float(hit.mean()), question, answer)


def _match_type(item_type: T.DataType) -> T.ArrayType:
    kinds = [("item_id", item_type), ("passage", T.IntegerType())]
    kinds += [(n, T.DoubleType()) for n in ("score", "overlap", "question_overlap", "answer_overlap")]
    return T.ArrayType(T.StructType([T.StructField(n, k) for n, k in kinds]))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, term, words): a row per different term of an item, and one with its number of words."""
    for batch in batches:
        out: list[tuple] = []
        for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            out.extend((part, term, None) for term in set(words))
            out.append((part, None, len(words)))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["part", "term", "words"])


def _index_blocks(items: DataFrame, id_col: str, text_col: str):
    """(ids, index) of each block, of about half ``INDEX_BYTES`` of text by a hash. Terms are counted
    over all items, and a block gets the counts of its own terms."""
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where(F.col("text").rlike(r"(?U)\w"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // (INDEX_BYTES // 2))
    if not parts:
        return
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    words = stored(rows.mapInArrow(_words, "part long, term string, words long"), f"{shared_folder(items.sparkSession, 'terms')}")
    total = words.agg(F.count("words").alias("n"), F.avg("words").alias("mean")).first()
    terms = words.where(F.col("term").isNotNull())
    counts = terms.groupBy("term").agg(F.count("*").alias("n"))
    for part in range(parts):
        mine = rows.where(F.col("part") == part).orderBy("id", "text").collect()
        if mine:
            known = counts.join(terms.where(F.col("part") == part).select("term").distinct(), "term", "left_semi").collect()
            statistics = Statistics(total.n, total.mean, {r.term: r.n for r in known})
            yield [r.id for r in mine], Index([r.text for r in mine], statistics)


def finders(
    items: DataFrame, id_col: str = "item_id", text_col: str = "text", least: float = MIN_SCORE, similarity: float = SIMILARITY
):
    """One function per block of items, from a text column to an array of the items a text holds:
    item_id, passage, score and overlaps."""
    spark, kind = items.sparkSession, _match_type(items.schema[id_col].dataType)
    for ids, index in _index_blocks(items, id_col, text_col):
        yield _matcher(spark.sparkContext.broadcast((ids, index)), kind, least, similarity)


def _matcher(sent, kind: T.ArrayType, least: float, similarity: float):
    @F.pandas_udf(kind)
    def of(texts: pd.Series) -> pd.Series:
        ids, index = sent.value
        scanner = Scanner(index, least, similarity)
        return pd.Series([[{**vars(m), "item_id": ids[m.item]} for m in scanner.matches(t)] for t in texts])

    # Else Spark would add a filter on the array's size below an explode, and run the scan for it again.
    return of.asNondeterministic()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and test item it holds: id, item_id, passage, score and overlaps. Each
    block of items has a scan of its own, so a task holds one index."""
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").alias("id")
    none = F.array().cast(_match_type(items.schema["item_id"].dataType))
    scans = [docs.select(key, f(text).alias("found")) for f in finders(items)]
    found = reduce(DataFrame.unionAll, scans) if scans else docs.select(key, none.alias("found")).where("false")
    return found.select("id", F.explode("found").alias("m")).select("id", "m.*")


def without_benchmark(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents which hold no test item. Between blocks of items the documents which are left are
    written to the shared folder, so a task holds one index."""
    folder = shared_folder(docs.sparkSession, "clean")
    for step, f in enumerate(finders(items)):
        if step:
            docs = stored(docs, f"{folder}/{step}")
        docs = docs.where(F.size(f(F.col(f"`{text_col}`"))) == 0)
    return docs
