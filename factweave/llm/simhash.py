"""SimHash near-dedup: fingerprints of word shingles, linked by Golay-code fuzzy keys.

A fingerprint has three segments of 22, 21 and 21 bits. If two differ in at most three bits, then
either some segment is equal and another differs in at most one bit, or each segment differs in
exactly one. So a fingerprint gives keys (equal segment, codeword near another segment) for the six
ordered pairs, and keys of the three codewords. A word decodes to one codeword; the words one bit
away decode to up to six, so several keys are given for each. Fingerprints of equal key meet, are
verified by their bits, and each bucket gives a spanning forest of its links, not all its pairs.
Only different fingerprints take part; copies follow through their fingerprint.

Contract for odd input: null and empty texts, and texts of white space, have fingerprint zero, which
links like any other; a text of fewer words than a shingle is one shingle; a row with a null id gets
its fingerprint and component, but names none (null where no row of the component has an id); rows
which repeat an id are one document; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.components import components, shared_folder, stored
from factweave.llm.golay import Decoder
from factweave.operators.skew import join_to_unique

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
PAIRS = ((0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1))  # equal segment, near segment
_BLOCK = 1 << 16
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def simhash(text: str | None, width: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is in over half the hashes of the shingles."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) <= width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, width) for t in texts], dtype="int64")

    return of(text)


def _keys(prints: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fingerprint number of each)."""
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(f)) & np.uint64((1 << n) - 1)).astype(np.int64) for f, n in SEGMENTS]
    near = [decoder.nearby(p, n) for p, (_, n) in zip(parts, SEGMENTS, strict=True)]
    keys, rows = [], []
    for kind, (equal, other) in enumerate(PAIRS):
        row, code = near[other].T
        keys.append((kind << 40) | (parts[equal][row] << 12) | code)
        rows.append(row)
    own = [decoder.index(p) for p in parts]
    every = np.arange(len(prints))
    # One bit in each segment: one side tries the codewords near its first two segments, the
    # other side those near its third.
    row, code = near[2].T
    keys.append((6 << 40) | (own[0][row] << 24) | (own[1][row] << 12) | code)
    rows.append(row)
    starts = np.searchsorted(near[1][:, 0], every)
    counts = np.bincount(near[1][:, 0], minlength=len(prints))
    row, code = near[0].T
    times = counts[row]
    row2, code2 = np.repeat(row, times), np.repeat(code, times)
    inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + starts[row2]
    keys.append((6 << 40) | (code2 << 24) | (near[1][inner, 1] << 12) | own[2][row2])
    rows.append(row2)
    return np.concatenate(keys), np.concatenate(rows)


def _give_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = Decoder()
    for batch in batches:
        prints = np.asarray(batch.column(0)).astype(np.int64)
        for at in range(0, len(prints), 4096):
            some = prints[at : at + 4096]
            keys, rows = _keys(some, decoder)
            yield pa.record_batch([pa.array(keys), pa.array(some[rows])], names=["key", "fingerprint"])


def _forest(prints: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of each member of a bucket to the least of those it is connected with there."""
    links, open_ = [], np.sort(prints)
    while len(open_) > 1:
        root, frontier, reached = open_[0], [open_[0]], []
        open_ = open_[1:]
        while frontier and len(open_):
            near = np.bitwise_count(open_ ^ frontier.pop()) <= distance
            found = open_[near]
            open_ = open_[~near]
            reached.append(found)
            frontier.extend(found)
        if reached and len(members := np.concatenate(reached)):
            links.append((members, np.full(len(members), root)))
    return links


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links inside each bucket of rows sorted by key; a bucket may span batches."""

    def settle(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(first, len(keys)))
        two = first[size == 2]
        close = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= distance]
        found = [(prints[close], prints[close + 1])]
        for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found.extend(_forest(prints[f : f + n], distance))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(a):
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(0))
        prints = np.asarray(batch.column(1)).astype(np.int64).view(np.uint64)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1][0][-1] != keys[0]):
            done = [*held, (keys[:cut], prints[:cut])]
            held = []
            yield from settle(*(np.concatenate(x) for x in zip(*done, strict=True)))
        held.append((keys[cut:], prints[cut:]))
    if held:
        yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) which connect the same fingerprints as all pairs of at most ``distance`` (up to
    three) differing bits do; ``prints`` holds different values in column fingerprint."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("distance must be 0 to 3")
    keyed = prints.select("fingerprint").mapInArrow(_give_keys, "key long, fingerprint long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _links(batches, distance)

    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """One row per document: its id, fingerprint (long) and component, the least id reachable."""
    folder = shared_folder(docs.sparkSession, "simhash")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint(F.col(f"`{text_col}`"), width).alias("fingerprint"))
    rows = stored(rows, f"{folder}/rows")
    prints = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), f"{folder}/prints")
    roots = components(links(prints, distance))
    prints = prints.join(roots, prints.fingerprint == roots.node, "left")
    prints = prints.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = prints.join(prints.groupBy("root").agg(F.min("least").alias("component")), "root")
    found = join_to_unique(rows, named.select("fingerprint", "component"), "fingerprint", spread_by="id")
    return found.select("id", "fingerprint", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents which have the least id of their component; rows without an id stay."""
    found = near_duplicates(docs, id_col, text_col)
    gone = found.where("id <> component").select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone["_gone"], "left_anti")
