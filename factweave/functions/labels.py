"""Random renumbering of entities and facts inside one decomposition text.

The random order comes from hashes of (seed, key, number): a row gives the same result in
every run and on every executor. Labels are replaced in one pass over label tokens, so that
``ENTITY1`` never hits ``ENTITY10``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions.text import _col, let, split_facts
from factweave.schemas import FACT_SEP

COMPAT_MAX_ID = 30  # fixed value: entity numbers looked for by the compatible mode


def _draw(seed: int, key: Column, number: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), number.cast("string")))


def _relabel(text: Column, label: str, new_id: Callable[[Column], Column]) -> Column:
    """Replace each ``<label><n>`` by ``<label><new_id(n)>``; 0 keeps the number."""

    def rename(piece: Column, place: Column) -> Column:
        digits = F.regexp_extract(piece, "^[0-9]+", 0)
        new = F.nullif(new_id(digits.try_cast("int")).cast("int"), F.lit(0)).cast("string")
        renamed = F.concat(F.coalesce(new, digits), F.substr(piece, F.length(digits) + 1))
        return F.when(place == 0, piece).otherwise(renamed)

    # Each piece after the first starts with the digits of a label.
    return F.array_join(F.transform(F.split(text, label + "(?=[0-9])"), rename), label)


def _numbers_in_order(size: Column, seed: int, key: Column) -> Column:
    """Numbers 1..size in the order of their hashes."""
    places = F.array_repeat(F.lit(0), size)
    drawn = F.transform(
        places, lambda _, i: F.struct(_draw(seed, key, i + 1).alias("draw"), (i + 1).alias("number"))
    )
    return F.sort_array(drawn)["number"]


def relabel_entities(c: Column | str, key: Column | str, seed: int = 666, compat: bool = False) -> Column:
    """Permute the entity numbers which the text names among themselves. What is kept per row is
    bounded by the text, whatever numbers are in it.

    ``compat=True`` takes for m the smallest number whose label is found as a substring, and
    replaces substrings: then texts which name ENTITY1 (or ENTITY10 and so on) stay as they are.
    """
    c, key = _col(c), _col(key)
    if compat:
        found = F.filter(
            F.sequence(F.lit(1), F.lit(COMPAT_MAX_ID)),
            lambda i: F.contains(c, F.concat(F.lit("ENTITY"), i.cast("string"))),
        )

        def replaced(last: Column) -> Column:
            new = F.array_position(_numbers_in_order(last, seed, key), last)
            old = F.concat(F.lit("ENTITY"), last.cast("string"))
            return F.replace(c, old, F.concat(F.lit("ENTITY"), new.cast("string")))

        return let(
            F.coalesce(F.array_min(found), F.lit(1)),
            lambda last: F.when(last == 1, c).otherwise(replaced(last)),
        )
    ids = F.regexp_extract_all(c, F.lit("ENTITY([0-9]{1,9})(?![0-9])"), F.lit(1)).cast("array<int>")
    return let(
        F.array_sort(F.array_distinct(ids)),
        lambda there: let(
            F.sort_array(F.transform(there, lambda n: F.struct(_draw(seed, key, n).alias("draw"), n.alias("number"))))["number"],
            lambda drawn: _relabel(c, "ENTITY", lambda n: F.get(there, F.array_position(drawn, n).cast("int") - 1)),
        ),
    )


def shuffle_facts(c: Column | str, key: Column | str, seed: int = 666) -> Column:
    """Permute the facts, keep the question last, renumber FACT labels and references."""
    c, key = _col(c), _col(key)

    def drawn(parts: Column) -> Column:
        facts = F.slice(parts, F.lit(1), F.size(parts) - 1)
        entries = F.transform(
            facts,
            lambda fact, i: F.struct(
                _draw(seed, key, i + 1).alias("draw"), (i + 1).alias("old"), fact.alias("fact")
            ),
        )
        return F.struct(F.sort_array(entries).alias("facts"), F.element_at(parts, -1).alias("question"))

    def renumbered(moved: Column) -> Column:
        text = F.array_join(F.concat(moved["facts"]["fact"], F.array(moved["question"])), FACT_SEP)
        return let(
            moved["facts"]["old"],
            lambda olds: _relabel(text, "FACT", lambda n: F.array_position(olds, n)),
        )

    return let(split_facts(c), lambda parts: let(drawn(parts), renumbered))
