"""Polynomial (Rabin-Karp) hashes of words, of runs of words and of runs of bytes, as arrays."""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
PIECE = 1 << 20
_M = (1 << 64) - 1


_KEPT: dict = {}


def _tables(seed: int) -> tuple[np.ndarray, int, int]:
    """A random value per byte, an odd base and its inverse modulo 2^64."""
    if seed not in _KEPT:
        _KEPT[seed] = _new_tables(seed)
    return _KEPT[seed]


def _new_tables(seed: int) -> tuple[np.ndarray, int, int]:
    random = np.random.default_rng(seed)
    base = int(random.integers(1 << 62, dtype=np.uint64)) * 8 + 5
    return random.integers(0, 1 << 64, 256, dtype=np.uint64), base & _M, pow(base, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    if (base, n) not in _KEPT:
        out = np.full(n, np.uint64(base), np.uint64)
        out[0] = 1
        _KEPT[base, n] = np.multiply.accumulate(out)
    return _KEPT[base, n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _is_word() -> np.ndarray:
    table = np.ones(256, bool)
    table[np.frombuffer(SPACES, np.uint8)] = False
    return table


_WORD = _is_word()


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = _WORD[buffer]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    values, base, inverse = _tables(seed)
    size = 1 << max(10, int(len(buffer)).bit_length())
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(values[buffer] * _powers(base, size)[: len(buffer)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers(inverse, size)[starts] + (ends - starts).astype(np.uint64))


def run_hashes(items: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive items, by doubling."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _tables(seed)[1]
    done, done_width, power, power_width = None, 0, items, 1
    left = width
    while True:
        if left & 1:
            if done is None:
                done, done_width = power, power_width
            else:
                m = len(power) - done_width
                done = done[:m] * np.uint64(pow(base, power_width, 1 << 64)) + power[done_width:]
                done_width += power_width
        left >>= 1
        if not left:
            return mixed(done[:n])
        m = len(power) - power_width
        power = power[:m] * np.uint64(pow(base, power_width, 1 << 64)) + power[power_width:]
        power_width *= 2


def byte_values(buffer: np.ndarray, seed: int) -> np.ndarray:
    return _tables(seed)[0][buffer]


def batches(texts: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of documents with about ``PIECE`` bytes together."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            out.append((first, i))
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        out.append((first, len(texts)))
    return out


def _cuts(text: bytes) -> list[bytes]:
    """A long text cut at white space into pieces, so that memory is bounded."""
    out, at = [], 0
    while len(text) - at > 2 * PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in SPACES:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def words_of(texts: list[bytes], seeds: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes (one array per seed) of all words in order, and the document of each word."""
    hashes: list[list[np.ndarray]] = [[] for _ in seeds]
    owner = []
    for first, last in batches(texts):
        pieces = _cuts(texts[first]) if last - first == 1 else [b" ".join(texts[first:last])]
        borders = np.cumsum([len(t) + 1 for t in texts[first:last]])
        for piece in pieces:
            buffer = np.frombuffer(piece, np.uint8)
            starts, ends = word_spans(buffer)
            for k, seed in enumerate(seeds):
                hashes[k].append(word_hashes(buffer, starts, ends, seed))
            at = np.searchsorted(borders, starts, "right") if last - first > 1 else np.zeros(len(starts), np.int64)
            owner.append(at + first)
    none = [np.zeros(0, np.uint64)]
    return [np.concatenate(h or none) for h in hashes], np.concatenate(owner or [np.zeros(0, np.int64)])
