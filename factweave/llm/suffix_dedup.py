"""Suffix-array dedup: bytes covered by a string of ``WIDTH`` bytes that also starts in a document
with a smaller id are removed; strings are judged on the input and never cross documents.

Every window of ``WIDTH`` bytes chooses an anchor, the place in it whose 18-byte hash is least, so
equal windows have equal anchors. A first question leaves anchors which another document may have.
Their contexts (the windows that chose them) are sent once per chunk; a bucket holds all contexts
of an anchor, sorts their suffixes and reads maximal repeats off the tree of common-prefix
intervals (``suffix_array``). A context in a third of all documents makes one entry per chunk.

Contract for odd input: a null text is empty; a row with a null id keeps its text and takes part in
no match; rows which repeat an id are one document; texts shorter than a window stay whole; columns
of any name are carried inside ``doc``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factweave.llm import chunks, rolling, suffix_array

WIDTH = 50
ANCHOR = 18
SEED = 21
_PLACE = np.uint64(22)  # bits for a place inside a piece of text
_ENTRY = np.dtype([("length", "u1"), ("at", "u1"), ("key", "<u4")])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    step = 1
    while step * 2 <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    if step < width:
        values = np.minimum(values[: len(values) - (width - step)], values[width - step :])
    return values


def _pieces(texts: list[bytes], width: int):
    """(document of each part, offset of each part in its document, parts) of about a megabyte;
    parts of one document overlap so that each window lies in exactly one of them."""
    for first, last in rolling.batches(texts):
        if last - first > 1:
            yield np.arange(first, last), np.zeros(last - first, np.int64), texts[first:last]
            continue
        text = texts[first]
        for at in range(0, max(1, len(text) - width + 1), rolling.PIECE):
            yield np.array([first]), np.array([at]), [text[at : at + rolling.PIECE + width - 1]]


class _Runs:
    """Runs of windows with one anchor: key, document, first and last window, place of the anchor."""

    def __init__(self, texts: list[bytes], width: int):
        found = [x for piece in _pieces(texts, width) if (x := _runs(*piece, width))]
        none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
        self.key, self.doc, self.first, self.last, self.anchor = (
            np.concatenate(x) for x in zip(*(found or [none]), strict=True)
        )


def _runs(owner: np.ndarray, offset: np.ndarray, parts: list[bytes], width: int):
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(parts), np.uint8)
    n = len(text) - width + 1
    if n <= 0:
        return None
    hashes = rolling.run_hashes(rolling.byte_values(text, SEED), ANCHOR, SEED)
    places = np.arange(len(hashes), dtype=np.uint64)
    chosen = _least((hashes >> _PLACE << _PLACE) | places, width - ANCHOR + 1)
    chosen = (chosen & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    part = np.repeat(np.arange(len(parts)), sizes)
    inside = part[:n] == part[width - 1 :]
    new = np.ones(n, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (part[1:n] != part[: n - 1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.ones(n, bool)
    ends[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(ends & inside)
    p, at = part[first], chosen[first]
    shift = offset[p] - begin[p]
    return hashes[at], owner[p], first + shift, last + shift, at + shift


class _Contexts:
    """The distinct contexts of a chunk's repeated anchors, sorted by cell and text, with their least id."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, runs: _Runs, repeated: np.ndarray, buckets: int, width: int):
        self.chosen = np.flatnonzero(repeated)
        doc, first, last = (x[self.chosen] for x in (runs.doc, runs.first, runs.last))
        self.doc, self.first = doc, first
        key, at = runs.key[self.chosen], (runs.anchor[self.chosen] - first)
        known: dict[bytes, int] = {}
        found = [
            known.setdefault(texts[d][f : l + width], len(known))
            for d, f, l in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True)
        ]
        group = np.array(found, np.int64)
        _, one = np.unique(group, return_index=True)
        least = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(least, group, ids[doc])
        cell = chunks.split_key(key[one], buckets)
        # Answers are matched by place and rows come in any order at each reading, so contexts of a cell are in order of their text.
        every = list(known)
        order = np.array(sorted(range(len(every)), key=every.__getitem__), np.int64)
        order = order[np.argsort(cell[order], kind="stable")]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.group = place[group]
        self.texts = [every[i] for i in order.tolist()]
        self.least = least[order]
        self.entry = np.zeros(len(order), _ENTRY)
        self.entry["length"] = [len(t) for t in self.texts]
        self.entry["at"], self.entry["key"] = at[one][order], cell[order] & np.uint64(0xFFFFFFFF)
        self.slices = chunks.per_bucket(cell[order])


def settle(table: pa.Table, width: int = WIDTH) -> pa.Table:
    """Per entry, as bits, the windows which a document with a smaller id than the entry's has."""
    sizes = [len(x) // 8 for x in table.column("d").to_pylist()]
    entry = np.frombuffer(b"".join(table.column("c").to_pylist()), _ENTRY)
    least = np.frombuffer(b"".join(table.column("d").to_pylist()), np.int64)
    masks = np.zeros(len(entry), np.uint64)
    if len(entry):
        masks = _masks(b"".join(table.column("b").to_pylist()), entry, least, width)
    answers = [x.tobytes() for x in np.split(masks, np.cumsum(sizes)[:-1])]
    return pa.table(
        [table.column("bucket"), table.column("chunk"), table.column("a"), pa.array(answers, pa.binary())]
        + [pa.array([b""] * len(answers), pa.binary())] * 2,
        names=table.column_names,
    )


def _masks(text: bytes, entry: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    length = entry["length"].astype(np.int64)
    ends = np.cumsum(length)
    known: dict[bytes, int] = {}
    starts = (ends - length).tolist()
    group = np.array([known.setdefault(text[s:e], len(known)) for s, e in zip(starts, ends.tolist(), strict=True)])
    _, one = np.unique(group, return_index=True)
    smallest = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, least)
    every = (np.uint64(1) << (length - width + 1).astype(np.uint64)) - np.uint64(1)
    # Contexts of one anchor: only where there are several can further windows repeat.
    _, anchor, many = np.unique(entry["key"][one], return_inverse=True, return_counts=True)
    some = np.flatnonzero(many[anchor] > 1)
    masks = np.zeros(len(known), np.uint64)
    if len(some):
        pick = one[some]
        masks[some] = suffix_array.earlier_windows(
            text, ends[pick] - length[pick], length[pick], anchor[some], entry["at"][pick].astype(np.int64), smallest[some], width
        )
    return np.where(least > smallest[group], every, masks[group])


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: doc (all its columns), n_bytes, n_removed, spans of removed bytes
    (start, end; maximal), and kept, the remaining bytes."""
    if not ANCHOR < width < 63 + ANCHOR:
        raise ValueError(f"width must be in {ANCHOR + 1}..{62 + ANCHOR}")
    parts, size = chunks.chunked(docs, id_col, text_col)
    buckets = chunks.buckets_for(size // 6)

    def runs_of(table: pa.Table) -> tuple:
        ids, texts = chunks.documents_of(table, id_col, text_col)
        runs = _Runs(texts, width)
        return ids, texts, runs, chunks.ChunkKeys(runs.key, ids[runs.doc], buckets)

    def send_cells(chunk: int, table: pa.Table) -> list[tuple]:
        return runs_of(table)[3].rows(chunk)

    def contexts_of(table: pa.Table, answers: dict[int, bytes]) -> tuple:
        ids, texts, runs, keys = runs_of(table)
        return ids, texts, _Contexts(texts, ids, runs, keys.repeated(answers), buckets, width)

    def send_contexts(chunk: int, table: pa.Table, replies: pa.Table) -> list[tuple]:
        answers = chunks.by_bucket(replies, "a")
        found = contexts_of(table, answers)[2]
        sent = {
            b: (b"".join(found.texts[s]), found.entry[s].tobytes(), found.least[s].tobytes())
            for b, s in found.slices
        }
        return [(b, chunk, a, *sent.get(b, (b"", b"", b""))) for b, a in answers.items()]

    def settle_contexts(table: pa.Table) -> pa.Table:
        return settle(table, width)

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    result = T.StructType(
        [
            T.StructField("doc", parts.schema["doc"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(result)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        ids, texts, found = contexts_of(table, chunks.by_bucket(replies, "a"))
        answers, masks = chunks.by_bucket(replies, "b"), np.zeros(len(found.texts), np.uint64)
        for b, s in found.slices:
            masks[s] = np.frombuffer(answers[b], np.uint64)
        length = found.entry["length"].astype(np.uint64)
        every = (np.uint64(1) << (length - np.uint64(width - 1))) - np.uint64(1)
        own = ids[found.doc] > found.least[found.group]
        mask = np.where(own, every[found.group], masks[found.group])
        hit, bit = np.nonzero((mask[:, None] >> np.arange(64, dtype=np.uint64)[None, :]) & np.uint64(1))
        return _kept_table(table, texts, found.doc[hit], found.first[hit] + bit)

    def _kept_table(table: pa.Table, texts: list[bytes], doc: np.ndarray, window: np.ndarray) -> pa.Table:
        raw = table.column("doc").combine_chunks().field(text_col).cast(pa.large_binary()).to_pylist()
        order = np.lexsort((window, doc))
        doc, window = doc[order], window[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (window[1:] > window[:-1] + width)
        start, owner = window[new], doc[new]
        end = window[np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)] + width if len(doc) else window
        borders = np.searchsorted(owner, np.arange(len(texts) + 1))
        columns: tuple[list, ...] = ([], [], [], [])
        for i, text in enumerate(raw):
            mine = slice(borders[i], borders[i + 1])
            spans, kept, at = [], [], 0
            for s, e in zip(start[mine].tolist(), end[mine].tolist(), strict=True):
                spans.append({"start": s, "end": e})
                kept.append(text[at:s])
                at = e
            kept.append((text or b"")[at:])
            row = (len(text or b""), sum(x["end"] - x["start"] for x in spans), spans, b"".join(kept))
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        made = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]
        return pa.table([table.column("doc"), *made], names=arrow.names)

    first = chunks.ask(parts, send_cells)
    second = chunks.ask_again(parts, first, send_contexts, settle_contexts)
    return parts.groupBy("chunk").cogroup(second.groupBy("chunk")).applyInArrow(finish, result)
