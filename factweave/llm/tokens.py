"""Token counts from a byte-level BPE tokenizer compiled to deterministic transducers.

Two transducers run in a row. The first splits text into words by character class; its transitions
say where a word begins. Texts are cut into chunks, each chunk's transitions compose to a map from
entry state to exit state, and a prefix scan over these maps gives every chunk its entry state, so
all chunks advance together. The second runs over the bytes of a word; each transition carries the
change in the number of tokens, so the sum along a word is its count. Its states (what can still
become part of a longer token, and the tokens that end there) are compiled as texts need them.

A token sequence is the tokenizer's own if each pair of neighbours is; so the last token of a prefix
is the one suffix in the vocabulary that may stand after the last token before it.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SPECIAL = "<|endoftext|>"  # fixed value of the vocabulary file
MAX_STATES = 400_000
MAX_WORDS = 400_000
PIECE = 1 << 20
CHUNK = 256

# Character classes; SHORT are s, t, m, d, which end a contraction by themselves.
END, SPACE, BLANK, QUOTE, OTHER, NUMBER, LETTER, SHORT, R, V, E, L = range(12)
# States of the splitter: what the last characters belong to.
START, IN_L, IN_N, IN_O, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SHORTENED, ONE_SPACE, ONE_BLANK, SPACED, BLANKED = range(13)
HERE, BEFORE = 1, 2  # a word begins at this character, at the one before

_FIRST = {SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: AT_QUOTE, OTHER: IN_O, NUMBER: IN_N}
_JOINED = {QUOTE: IN_O, OTHER: IN_O, NUMBER: IN_N}  # after a space that belongs to the word


def _step(state: int, char: int) -> tuple[int, int]:
    """Next state and where words begin."""
    pending = {QUOTE_R: E, QUOTE_V: E, QUOTE_L: L}
    if char == END:
        return START, BEFORE if state in pending else 0
    first, blank, letter = _FIRST.get(char, IN_L), char in (SPACE, BLANK), char >= LETTER
    if state in pending:
        if char == pending[state]:
            return SHORTENED, 0
        return (IN_L, BEFORE) if letter else (first, BEFORE | HERE)
    if state == AT_QUOTE:
        after = {SHORT: SHORTENED, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L, OTHER: IN_O, QUOTE: IN_O}
        return (after[char], 0) if char in after else (first, HERE)
    if state in (ONE_SPACE, ONE_BLANK, SPACED, BLANKED) and blank:
        return (SPACED if char == SPACE else BLANKED), 0
    if state in (ONE_SPACE, SPACED):
        return _JOINED.get(char, IN_L), 0 if state == ONE_SPACE else BEFORE
    if state == BLANKED:
        return first, BEFORE | HERE
    same = {IN_L: letter, IN_N: char == NUMBER, IN_O: char in (OTHER, QUOTE)}
    return (state, 0) if same.get(state) else (first, HERE)


def character_classes(path: str) -> np.ndarray:
    """Class of every code point, as the library itself splits it from neighbours: a letter stays
    with a letter before it, a number with a number after it, a mark between marks."""
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    table = np.full(0x110000, OTHER, np.uint8)

    def begins(points: np.ndarray, before: str, after: str) -> tuple[np.ndarray, np.ndarray]:
        found = np.zeros(4 * len(points), bool)
        found[[s for _, (s, _) in split("".join(f"{before}{chr(c)}{after}\n" for c in points))]] = True
        return found[1::4], found[2::4]

    # Planes from the fourth on hold no letter, number or white space, the first block all white space.
    for low in range(0, 0x40000, 1 << 15):
        points = np.array([c for c in range(low, low + (1 << 15)) if not 0xD800 <= c < 0xE000])
        if low == 0:
            table[points[begins(points, "!", "!")[0]]] = BLANK
        here, next_one = begins(points, "a", "1")
        table[points[~next_one]] = NUMBER
        table[points[~here]] = LETTER
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", SHORT), ("r", R), ("v", V), ("e", E), ("l", L)):
        table[[ord(c) for c in chars]] = kind
    return table


class Splitter:
    """The first transducer, run over all chunks of a text at once."""

    def __init__(self, path: str):
        self.classes = character_classes(path)
        steps = np.array([[_step(s, c) for c in range(12)] for s in range(13)], np.uint8)
        self.next, self.begins = steps[:, :, 0], steps[:, :, 1]
        # Maps of four characters at a time: state after each of the 12^4 class strings.
        two = self.next[self.next][:, :, :].reshape(13, 144)
        self.four = np.ascontiguousarray(two[two].reshape(13, 144 * 144).T)

    def word_starts(self, kinds: np.ndarray) -> np.ndarray:
        """For each character, whether a word begins there. The classes end with END."""
        chunks = -(-len(kinds) // CHUNK)
        padded = np.zeros(chunks * CHUNK, np.uint8)
        padded[: len(kinds)] = kinds
        grid = padded.reshape(chunks, CHUNK)
        state = self._entries(grid)
        out = np.empty((CHUNK, chunks), np.uint8)
        columns = np.ascontiguousarray(grid.T)
        for t in range(CHUNK):
            out[t] = self.begins[state, columns[t]]
            state = self.next[state, columns[t]]
        marks = out.T.ravel()
        starts = (marks & HERE).astype(bool)
        starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return starts[: len(kinds)]

    def _entries(self, grid: np.ndarray) -> np.ndarray:
        """Entry state of each chunk: an exclusive prefix scan over the chunks' state maps."""
        quads = grid.reshape(len(grid), -1, 4).astype(np.int64) @ np.array([1728, 144, 12, 1])
        maps = np.tile(np.arange(13, dtype=np.uint8), (len(grid), 1))
        for t in range(quads.shape[1]):
            maps = np.take_along_axis(self.four[quads[:, t]], maps.astype(np.intp), 1)
        step = 1
        while step < len(maps):
            later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
            maps = np.concatenate([maps[:step], later])
            step *= 2
        return np.append(np.uint8(START), maps[:-1, START])


def _byte_letters() -> dict[str, int]:
    """The letters which stand for bytes in the vocabulary file: printable ones for themselves,
    the others in order from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """The second transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        written = {t: bytes(letters[c] for c in t) for t in model["vocab"] if t != SPECIAL}
        self.vocab = {b: model["vocab"][t] for t, b in written.items()}
        self.text = {i: b for b, i in self.vocab.items()}
        self.prefixes = {b[:n] for b in self.vocab for n in range(1, len(b))}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {
            (model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(pairs)
        }
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        """Forget compiled states; the first is the beginning of a word."""
        begin = (b"", (-1,), (0,))
        self.states, self.numbers, self.steps = [begin], {begin: 0}, {}

    def encode(self, text: bytes) -> list[int]:
        ids = [self.vocab[text[i : i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            found = [(self.merges.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False))]
            rank, i = min(found)
            if rank == 1 << 60:
                break
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def _may_follow(self, before: int, token: int) -> bool:
        known = self.fits.get((before, token))
        if known is None:
            wanted = [token] if before < 0 else [before, token]
            known = self.encode(b"".join(self.text[t] for t in wanted)) == wanted
            self.fits[before, token] = known
        return known

    def _compile(self, state: int, byte: int) -> int:
        """The transition from a state: next state and, in the low bits, the change in tokens."""
        live, tokens, counts = self.states[state]
        text = live + bytes([byte])
        for n in range(len(text), 0, -1):
            token = self.vocab.get(text[-n:])
            if token is not None and self._may_follow(tokens[-n], token):
                change = counts[-n] + 1
                break
        tokens, counts = (*tokens, token), (*counts, change)
        keep = next((n for n in range(len(text), 0, -1) if text[-n:] in self.prefixes), 0)
        reached = (text[len(text) - keep :], tokens[-keep - 1 :], tuple(c - change for c in counts[-keep - 1 :]))
        number = self.numbers.setdefault(reached, len(self.states))
        if number == len(self.states):
            self.states.append(reached)
        step = (number << 8) | (change + 128)
        self.steps[state << 8 | byte] = step
        return step

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        total, state, steps = 0, 0, self.steps
        for byte in word:
            step = steps.get(state << 8 | byte)
            if step is None:
                step = self._compile(state, byte)
            state = step >> 8
            total += (step & 255) - 128
        if len(self.states) > MAX_STATES:
            self._clear()
        return total

    def counts(self, words: list[bytes]) -> list[int]:
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        known = self.words
        out = list(map(known.get, words))
        for i in [i for i, n in enumerate(out) if n is None]:
            word = words[i]
            if word not in known:
                known[word] = self.count(word)
            out[i] = known[word]
        return out


_CUT = regex.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _pieces(text: str) -> list[str]:
    """A long text cut where a word begins whatever stands around it."""
    out, at = [], 0
    while len(text) - at > 2 * PIECE and (found := _CUT.search(text, at + PIECE)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Counter:
    """Counts tokens of whole texts, as the tokenizer's library does by default: its special string
    inside a text is one token."""

    def __init__(self, path: str):
        self.splitter, self.bpe = Splitter(path), Bpe(path)

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for k, part in enumerate((text or "").split(SPECIAL)):
                out[i] += k > 0
                for piece in _pieces(part) if part else ():
                    parts.append(piece)
                    owners.append(i)
                    size += len(piece)
                    if size > PIECE:
                        np.add.at(out, owners, self._count(parts))
                        parts, owners, size = [], [], 0
        if parts:
            np.add.at(out, owners, self._count(parts))
        return out

    def _count(self, parts: list[str]) -> np.ndarray:
        joined = "\n".join([*parts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.splitter.classes[points]
        last = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[last] = END
        starts = self.splitter.word_starts(kinds)
        ends = kinds == END
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        offset = np.cumsum(width) - width
        marks = np.flatnonzero(starts | ends)
        at, begins = offset[marks], starts[marks] & ~ends[marks]
        first, after = at[:-1][begins[:-1]], at[1:][begins[:-1]]
        data = joined.encode()
        words = [data[s:e] for s, e in zip(first.tolist(), after.tolist(), strict=True)]
        counts = np.array(self.bpe.counts(words), np.int64)
        part = np.searchsorted(last, marks[:-1][begins[:-1]])
        return np.bincount(part, weights=counts, minlength=len(parts)).astype(np.int64)


def token_count(text: Column, path: str, spark) -> Column:
    """Tokens of a text column; the compiled tables are about 20 MB and are broadcast once.

    Null and empty texts have none. Any length is counted whole."""
    compiled = spark.sparkContext.broadcast(Counter(path))

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(compiled.value.count(texts.tolist()))

    return count(text)


def with_token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the documents: id, n_bytes, n_tokens and over_limit. Null texts are empty;
    null ids, repeated rows and further columns of any name do no harm."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counted = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        token_count(text, path, docs.sparkSession).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
