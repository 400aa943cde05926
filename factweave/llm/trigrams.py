"""Boolean trigram queries of regular expressions.

A query is what every text with a match must hold: a trigram (three bytes), ("and", queries),
("or", queries), or None where nothing is known. It is derived from the parsed expression: strings
of which one must stand in the text are carried along a sequence as long as they are few, and
turned into trigrams where the sequence has a gap. Trigrams are over UTF-8 with A-Z lower-cased, so
queries do not tell case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as op
from re import _parser as parser

MOST = 48  # strings carried at once
_CLASS = 12  # characters of a class which count as alternatives
_FOLDED = set("ikIKsS")  # match letters beyond ASCII when case is ignored

_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)

Query = bytes | tuple | None


def both(a: Query, b: Query) -> Query:
    return _joined("and", (a, b)) if a is not None and b is not None else (b if a is None else a)


def either(queries: list[Query]) -> Query:
    """Of alternatives, those go which ask for all that another one asks for, and more."""
    if any(q is None for q in queries):
        return None
    asked = [(q, set(q[1]) if isinstance(q, tuple) and q[0] == "and" else {q}) for q in dict.fromkeys(queries)]
    return _joined("or", tuple(q for q, own in asked if not any(other < own for _, other in asked)))


def _joined(kind: str, queries: tuple) -> Query:
    flat: dict = {}
    for q in queries:
        flat |= dict.fromkeys(q[1] if isinstance(q, tuple) and q[0] == kind else (q,))
    return next(iter(flat)) if len(flat) == 1 else (kind, tuple(flat))


def of_strings(strings: set[bytes]) -> Query:
    """One of the strings stands in the text."""
    found: list[Query] = []
    for s in sorted(strings):
        if len(s) < 3:
            return None
        found.append(_joined("and", tuple(s[i : i + 3] for i in range(len(s) - 2))))
    return either(found)


def _crossed(left: set[bytes], right: set[bytes]) -> set[bytes] | None:
    """All strings of a left and a right part; None if too many."""
    return {a + b for a in left for b in right} if len(left) * len(right) <= MOST else None


def _characters(codes: list[int], flags: int) -> set[bytes] | None:
    found = set()
    for char in map(chr, codes):
        if flags & re.IGNORECASE and (not char.isascii() or (char in _FOLDED and not flags & re.ASCII)):
            return None
        found.add(char.lower().encode() if char.isascii() else char.encode())
    return found if len(found) <= _CLASS else None


def _class(items: list, flags: int) -> set[bytes] | None:
    codes: list[int] = []
    for kind, value in items:
        if kind is op.LITERAL:
            codes.append(value)
        elif kind is op.RANGE and value[1] - value[0] < 2 * _CLASS:
            codes.extend(range(value[0], value[1] + 1))
        else:
            return None
    return _characters(codes, flags)


def _with_gaps(nodes) -> Iterator[tuple]:
    """The nodes; one that repeats at least so often is so many repeats and a gap."""
    for kind, value in nodes:
        if kind in _REPEATS and 0 < value[0] < value[1]:
            yield kind, (value[0], value[0], value[2])
            yield None, None
        else:
            yield kind, value


def _repeat(least: int, most: int, body, flags: int) -> tuple[set[bytes] | None, Query]:
    strings, query = _sequence(body, flags)
    if least == 0:
        return (strings | {b""}, None) if strings is not None and most == 1 else (None, None)
    if strings is None:
        return None, query
    whole: set[bytes] = {b""}
    for done in range(least):
        if (longer := _crossed(whole, strings)) is None:
            return None, of_strings(whole if done else strings)
        whole = longer
    return whole, None


def _node(kind, value, flags: int) -> tuple[set[bytes] | None, Query]:
    """(strings, query): the strings that the node matches, if they are few, else what must be there."""
    if kind is op.LITERAL:
        return _characters([value], flags), None
    if kind is op.IN:
        return _class(value, flags), None
    if kind is op.SUBPATTERN:
        _, add, drop, body = value
        return _sequence(body, (flags | add) & ~drop)
    if kind is op.ATOMIC_GROUP:
        return _sequence(value, flags)
    if kind in _REPEATS:
        return _repeat(*value, flags)
    if kind is op.BRANCH:
        parts = [_sequence(body, flags) for body in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST:
            return set().union(*(s for s, _ in parts)), None
        return None, either([q if s is None else of_strings(s) for s, q in parts])
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {b""}, None
    return None, None


def _sequence(nodes, flags: int) -> tuple[set[bytes] | None, Query]:
    strings: set[bytes] = {b""}
    query: Query = None
    whole = True
    for kind, value in _with_gaps(nodes):
        piece, must = _node(kind, value, flags)
        query = both(query, must)
        if piece is None:
            query, strings, whole = both(query, of_strings(strings)), {b""}, False
        elif (longer := _crossed(strings, piece)) is not None:
            strings = longer
        else:  # too many: settle these and go on with their last two bytes
            query, whole = both(query, of_strings(strings)), False
            strings = _crossed({s[-2:] for s in strings}, piece) or piece
    return (strings, None) if whole else (None, both(query, of_strings(strings)))


def query_of(pattern: str, flags: int = 0) -> Query:
    """The trigram query of a regular expression; None if a text may match without any trigram."""
    tree = parser.parse(pattern, flags)
    strings, query = _sequence(tree, tree.state.flags)
    return query if strings is None else of_strings(strings)


def trigrams_of(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams_of(q) for q in query[1]))
