"""Secret scans by an inverted index of trigrams.

Each rule's regular expression gives a Boolean query of trigrams (``trigrams``). The texts of a
segment, some megabytes of one Arrow batch, are indexed: for every trigram that a rule asks for, the
sorted places of the texts which hold it. Postings are intersected and united as the query says, and
only the candidates are verified by the expression. Rules without mandatory trigrams (runs of
hexadecimal digits) scan every text of the segment. Segments are independent, so the scan is a projection: nothing is
shuffled, and a lost task is run again from its input.

Matches of a rule are leftmost and do not overlap; those of too few characters are dropped after
that, as are their texts. Places are code points, ends are exclusive.

Contract for odd input: null and empty texts have no spans; equal rows are scanned each for
itself; a null id is carried on; other columns, whatever their names, stay in ``doc``; a text longer
than a segment is a segment of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.trigrams import Query, query_of, trigrams_of

SEGMENT_BYTES = 8 << 20
_BLOCK = 1 << 20
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_GAP = b"\xff\xff"  # no byte of UTF-8, so no trigram spans two texts
SPANS = "array<struct<kind:string,start:int,end:int,secret:string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and how many characters one of its groups has at least."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


#: The kinds of the contract. A run of 16 digits or more is one match of at least 16.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: Public formats of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (RSA |DSA |EC |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY( BLOCK)?-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("code_host", r"(gh[oprsu]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,})"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[prs]k_(live|test)_[0-9A-Za-z]{16,}"),
    Rule("url_login", r"://[A-Za-z0-9._~%+-]{1,64}:[^\x20\t\r\n/@:]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES


class TrigramIndex:
    """Postings of the texts of a segment, for the trigrams which some queries name."""

    def __init__(self, trigrams: Iterable[bytes]):
        self.slots = {t: i for i, t in enumerate(sorted(trigrams))}
        self.slot_of = np.zeros(1 << 24, np.uint16)
        for t, i in self.slots.items():
            self.slot_of[int.from_bytes(t)] = i + 1

    def build(self, texts: list[bytes]) -> None:
        self.size = len(texts)
        body = np.frombuffer(_GAP.join(texts).translate(_LOWER), np.uint8)
        starts = np.cumsum([0, *(len(t) + len(_GAP) for t in texts[:-1])])
        there = np.zeros((len(self.slots), self.size), bool)
        for at in range(0, len(body) - 2, _BLOCK):
            some = body[at : at + _BLOCK + 2].astype(np.uint32)
            slots = self.slot_of[(some[:-2] << 16) | (some[1:-1] << 8) | some[2:]]
            hits = np.flatnonzero(slots)
            there[slots[hits] - 1, np.searchsorted(starts, hits + at, side="right") - 1] = True
        self.postings = [np.flatnonzero(row) for row in there]

    def candidates(self, query: Query) -> np.ndarray:
        """Places of the texts which satisfy a query, in order."""
        if query is None:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings[self.slots[query]]
        found = sorted((self.candidates(q) for q in query[1]), key=len)
        out = found[0]
        for other in found[1:]:
            out = np.union1d(out, other) if query[0] == "or" else np.intersect1d(out, other, assume_unique=True)
        return out


def asked_by(rules: Iterable[Rule]) -> tuple[list[Query], set[bytes]]:
    """The query of each rule and all trigrams in them; derived once, on the driver."""
    queries = [query_of(r.pattern, r.flags) for r in rules]
    return queries, set().union(*(trigrams_of(q) for q in queries))


class Scanner:
    """Rules, their queries, and the index of one segment after the other."""

    def __init__(self, rules: Iterable[Rule], queries: list[Query], trigrams: set[bytes]):
        self.rules, self.queries = tuple(rules), queries
        self.compiled = [re.compile(r.pattern, r.flags) for r in self.rules]
        self.index = TrigramIndex(trigrams)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int, str]]]:
        """Of each text, (start, rule, end, secret) in order."""
        found: list[list[tuple[int, int, int, str]]] = [[] for _ in texts]
        if not texts:
            return found
        self.index.build(texts)
        decoded: dict[int, str] = {}
        for number, (rule, compiled, query) in enumerate(zip(self.rules, self.compiled, self.queries, strict=True)):
            for at in self.index.candidates(query).tolist():
                text = decoded.get(at)
                if text is None:
                    text = decoded[at] = texts[at].decode()
                found[at].extend(
                    (m.start(), number, m.end(), m[rule.group]) for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least
                )
        for spans in found:
            spans.sort()
        return found


def _segments(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES, segment_bytes: int = SEGMENT_BYTES) -> Column:
    """The secrets of a text by start, then by the order of the rules."""
    kinds = [r.kind for r in rules]
    if len(set(kinds)) < len(kinds) or not rules:
        raise ValueError("rules must have kinds of their own")
    queries, trigrams = asked_by(rules)
    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.string())]

    def rows(texts: pa.Array, scanner: Scanner) -> pa.Array:
        spans: list[list[tuple[int, int, int, str]]] = []
        for some in _segments([t or b"" for t in texts.cast(pa.large_binary()).to_pylist()], segment_bytes):
            spans.extend(scanner.scan(some))
        flat = [(kinds[k], s, e, secret) for found in spans for s, k, e, secret in found]
        columns = list(zip(*flat, strict=True)) if flat else [()] * len(fields)
        body = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]), pa.int32()), body)

    @F.arrow_udf(SPANS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(rules, queries, trigrams)
        for texts in batches:
            yield rows(texts, scanner)

    return of(text)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """One row per document: doc (all its columns) and spans (kind, start, end, secret)."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(doc, secret_spans(F.col(f"`{text_col}`"), rules).alias("spans"))


def span_list(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced by a mask; spans that overlap are replaced as one."""

    @F.arrow_udf("string")
    def of(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, f in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            if t is None or not f:
                out.append(t)
                continue
            parts, at, end = [], 0, 0
            for s in f:
                if s["start"] >= end:
                    parts += [t[at : s["start"]], mask]
                end = at = max(end, s["end"])
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    return of(text, spans)
