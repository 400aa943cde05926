"""Substring dedup: every window of consecutive words is hashed (Rabin-Karp) and looked up by
its hash across all documents; repeated windows merge into maximal removal intervals.

A word is removed where a window that covers it also starts in a document with a smaller id.
Windows are judged on the input. Contract for odd input: a null text has no words; a row with a
null id keeps its text and takes part in no match; rows which repeat an id are one document, so
they do not remove each other; texts shorter than a window stay whole; further columns, whatever
their names, are carried inside ``doc``.

Windows are told apart by 96 bits of two hashes. A first question with 32 bits and the bucket
leaves only windows which another document may have, a second settles them by full hash and
least id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.llm import chunks, rolling

WIDTH = 13
SEEDS = (11, 12)
_32 = np.uint64(32)


class _Windows:
    """All windows of a chunk: two hashes, id and place among the chunk's words."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, width: int):
        self.ids, self.texts = chunks.documents_of(table, id_col, text_col)
        (one, two), self.owner = rolling.words_of(self.texts, SEEDS)
        first = rolling.run_hashes(one, width, SEEDS[0])
        second = rolling.run_hashes(two, width, SEEDS[1])
        n = len(first)
        inside = self.owner[:n] == self.owner[width - 1 : width - 1 + n]
        self.start = np.flatnonzero(inside)
        self.first, self.second = first[inside], second[inside] >> _32
        self.id = self.ids[self.owner[self.start]] if n else np.zeros(0, np.int64)

    def keys(self, buckets: int) -> chunks.ChunkKeys:
        return chunks.ChunkKeys(self.first, self.id, buckets)


class _Exact:
    """The distinct windows of a chunk which another document may have, sorted by bucket and
    hash, each with the least id in the chunk."""

    def __init__(self, windows: _Windows, repeated: np.ndarray, buckets: int):
        self.chosen = np.flatnonzero(repeated)
        first, second, ids = (x[self.chosen] for x in (windows.first, windows.second, windows.id))
        bucket = chunks.split_key(first, buckets) >> _32
        order = np.lexsort((ids, second, first, bucket))
        first, second, ids, bucket = (x[order] for x in (first, second, ids, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.first, self.second, self.least = first[new], second[new].astype(np.uint32), ids[new]
        self.slices = chunks.per_bucket(bucket[new] << _32)


def settle(table: pa.Table) -> pa.Table:
    """Per chunk, which of its windows a document with a smaller id than the chunk's least has."""
    bodies = [np.frombuffer(x, np.uint64) for x in table.column("b").to_pylist()]
    first = np.concatenate(bodies)
    second = np.frombuffer(b"".join(table.column("c").to_pylist()), np.uint32)
    least = np.frombuffer(b"".join(table.column("d").to_pylist()), np.int64)
    order = np.lexsort((least, second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    smallest = least[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else least
    flags = np.empty(len(order), bool)
    flags[order] = smallest < least[order]
    ends = np.cumsum([len(x) for x in bodies])
    answers = [chunks.bits(x) for x in np.split(flags, ends[:-1])]
    return pa.table(
        [table.column("bucket"), table.column("chunk"), table.column("a"), pa.array(answers, pa.binary())]
        + [pa.array([b""] * len(answers), pa.binary())] * 2,
        names=table.column_names,
    )


def _covered(n_words: int, starts: np.ndarray, width: int) -> np.ndarray:
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:-1]) > 0


def _without(text: bytes, runs: np.ndarray) -> str:
    """The text without runs of words (first, end), each word with the white space after it."""
    places = np.append(rolling.word_spans(np.frombuffer(text, np.uint8))[0], len(text))
    ends = [0, *places[runs[:, 1]].tolist()]
    starts = [*places[runs[:, 0]].tolist(), len(text)]
    return b"".join(text[e:s] for e, s in zip(ends, starts, strict=True)).decode()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc (all its columns), n_words, n_removed, spans of removed words
    (start, end), kept, the words left joined by one space, and rest, the text without the removed
    words and the white space after each of them (null where nothing was removed)."""
    parts, size = chunks.chunked(docs, id_col, text_col)
    buckets = chunks.buckets_for(size // 5)

    def send_cells(chunk: int, table: pa.Table) -> list[tuple]:
        return _Windows(table, id_col, text_col, width).keys(buckets).rows(chunk)

    def send_exact(chunk: int, table: pa.Table, replies: pa.Table) -> list[tuple]:
        windows, answers = _Windows(table, id_col, text_col, width), chunks.by_bucket(replies, "a")
        exact = _Exact(windows, windows.keys(buckets).repeated(answers), buckets)
        found = {
            b: (exact.first[s].tobytes(), exact.second[s].tobytes(), exact.least[s].tobytes())
            for b, s in exact.slices
        }
        return [(b, chunk, a, *found.get(b, (b"", b"", b""))) for b, a in answers.items()]

    kept_type = T.StructType(
        [
            T.StructField("doc", parts.schema["doc"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("kept", T.StringType()),
            T.StructField("rest", T.StringType()),
        ]
    )

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        windows = _Windows(table, id_col, text_col, width)
        keys = windows.keys(buckets)
        exact = _Exact(windows, keys.repeated(chunks.by_bucket(replies, "a")), buckets)
        answers, earlier = chunks.by_bucket(replies, "b"), np.zeros(len(exact.first), bool)
        for b, s in exact.slices:
            earlier[s] = chunks.unbits(answers[b], s.stop - s.start)
        ids = windows.id[exact.chosen]
        drop = (ids > exact.least[exact.group]) | earlier[exact.group]
        gone = _covered(len(windows.owner), windows.start[exact.chosen[drop]], width)
        return kept_table(table, windows, gone)

    def kept_table(table: pa.Table, windows: _Windows, gone: np.ndarray) -> pa.Table:
        doc = table.column("doc")
        raw = doc.combine_chunks().field(text_col).cast(pa.large_binary()).to_pylist()
        counts = np.bincount(windows.owner, minlength=len(windows.texts))
        ends = np.cumsum(counts)
        spans, kept, rest, removed, n_words = [], [], [], [], []
        for text, own, n, end in zip(raw, windows.texts, counts, ends, strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            mine = gone[end - n : end]
            if own and mine.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
                spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
                removed.append(int(mine.sum()))
                rest.append(_without(text, edge.reshape(-1, 2)))
                words = [w for w, x in zip(words, mine.tolist(), strict=True) if not x]
            else:
                spans.append([])
                removed.append(0)
                rest.append(None)
            kept.append(b" ".join(words).decode())
        columns = [doc, n_words, removed, spans, kept, rest]
        return pa.table([c if i == 0 else pa.array(c, f.type) for i, (c, f) in enumerate(zip(columns, arrow, strict=True))], names=arrow.names)

    arrow = _arrow(kept_type)
    empty = arrow.empty_table()
    first = chunks.ask(parts, send_cells)
    second = chunks.ask_again(parts, first, send_exact, settle)
    return parts.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(finish, kept_type)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents with their columns; removed words go with the white space after them, and all
    else of a text (line breaks, indentation) stays as it was. A text of which no word is left goes."""
    found = dedup_substrings(docs, id_col, text_col, width)
    left = F.when(F.col("n_removed") > 0, F.col("rest")).otherwise(F.col(f"doc.`{text_col}`"))
    rows = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return rows.select(*[(left if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
