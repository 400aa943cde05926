"""Documents in chunks which ask, by key, whether other chunks hold the same thing.

A chunk is a few megabytes of whole documents, chosen by the hash of the document id. It sends
each of its keys once, so a key in a third of all documents makes one entry per chunk, not one
per document, and the answers come back in the order of the entries as packed bits. Every step
recomputes its keys from the text, so nothing but keys and answers is shuffled beside the
documents, and a lost task is run again from its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20
BUCKET_KEYS = 2_000_000
SENT = "bucket int, chunk long, a binary, b binary, c binary, d binary"
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def chunked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(chunk, doc) with all columns of a document in one struct, and the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    chunks = max(1, -(-total // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(chunks)).alias("chunk")
    return docs.select(chunk, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), total


def buckets_for(keys: int) -> int:
    return max(4, -(-keys // BUCKET_KEYS))


def documents_of(table: pa.Table, id_col: str, text_col: str) -> tuple[np.ndarray, list[bytes]]:
    """Ids (-1 and no text where the id is null, so that such a row takes no part) and texts."""
    doc = table.column("doc").combine_chunks()
    ids = doc.field(id_col)
    texts = doc.field(text_col).cast(pa.large_binary()).to_pylist()
    known = np.asarray(ids.is_valid())
    return (
        np.asarray(ids.fill_null(-1)).astype(np.int64),
        [t if t is not None and k else b"" for t, k in zip(texts, known, strict=True)],
    )


def split_key(keys: np.ndarray, buckets: int) -> np.ndarray:
    """64-bit keys as (bucket, 32 further bits) in one number."""
    return (((keys >> _32) % np.uint64(buckets)) << _32) | (keys & _LOW)


def per_bucket(cells: np.ndarray) -> list[tuple[int, slice]]:
    """The slices of sorted cells which belong to one bucket."""
    found, starts = np.unique(cells >> _32, return_index=True)
    ends = [*starts[1:], len(cells)][: len(starts)]
    return [(int(b), slice(s, e)) for b, s, e in zip(found, starts, ends, strict=True)]


class ChunkKeys:
    """The distinct cells of a chunk, sorted, and whether two documents of it share one."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, buckets: int):
        self.cells, self.inverse = np.unique(split_key(keys, buckets), return_inverse=True)
        low = np.full(len(self.cells), np.iinfo(np.int64).max)
        high = np.full(len(self.cells), np.iinfo(np.int64).min)
        np.minimum.at(low, self.inverse, ids)
        np.maximum.at(high, self.inverse, ids)
        self.shared = low != high

    def rows(self, chunk: int) -> list[tuple]:
        return [
            (b, chunk, (self.cells[s] & _LOW).astype(np.uint32).tobytes(), bits(self.shared[s]), b"", b"")
            for b, s in per_bucket(self.cells)
        ]

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """For each key given, whether another document has its cell."""
        found = np.zeros(len(self.cells), bool)
        for b, s in per_bucket(self.cells):
            found[s] = unbits(answers[b], s.stop - s.start)
        return found[self.inverse]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)


def sent_table(rows: list[tuple]) -> pa.Table:
    names = [x.split()[0] for x in SENT.split(", ")]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def find_repeated(table: pa.Table) -> pa.Table:
    """Answers per chunk: the cells of one bucket which several chunks or documents have."""
    bodies = [np.frombuffer(x, np.uint32) for x in table.column("a").to_pylist()]
    shared = [
        unbits(x, len(k)) for x, k in zip(table.column("b").to_pylist(), bodies, strict=True)
    ]
    cells = np.concatenate(bodies)
    order = np.argsort(cells, kind="stable")
    ordered, more = cells[order], np.concatenate(shared)[order]
    same = ordered[1:] == ordered[:-1]
    more[1:] |= same
    more[:-1] |= same
    # A cell shared in one chunk only stands alone here; one in several chunks has equal neighbours.
    flags = np.empty(len(cells), bool)
    flags[order] = more
    ends = np.cumsum([len(x) for x in bodies])
    answers = [bits(x) for x in np.split(flags, ends[:-1])]
    none = [b""] * len(answers)
    return pa.table(
        [table.column("bucket"), table.column("chunk"), pa.array(answers, pa.binary())]
        + [pa.array(none, pa.binary())] * 3,
        names=[x.split()[0] for x in SENT.split(", ")],
    )


def ask(docs: DataFrame, send: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """First question of every chunk, settled by ``find_repeated``."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return sent_table(send(key[0].as_py(), table))

    sent = docs.groupBy("chunk").applyInArrow(run, SENT)
    return sent.groupBy("bucket").applyInArrow(find_repeated, SENT)


def ask_again(docs: DataFrame, answers: DataFrame, send: Callable, settle: Callable) -> DataFrame:
    """A further question, from the documents and the answers so far."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        return sent_table(send(key[0].as_py(), table, replies) if table.num_rows else [])

    sent = docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SENT)
    return sent.groupBy("bucket").applyInArrow(settle, SENT)


def by_bucket(replies: pa.Table, column: str) -> dict[int, bytes]:
    return dict(zip(replies.column("bucket").to_pylist(), replies.column(column).to_pylist(), strict=True))
