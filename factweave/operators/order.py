"""Places, limits, slices, strides, shuffles and batches over an ordered corpus.

Rows carry their place in a unique whole-number column, dense or sparse. Places are counted per
block of that column: one narrow aggregate gives the rows per block, running sums over the block
table give the place of each block's first row, and ``row_number`` counts inside each block. The
block table may be as long as the corpus if numbers are sparse, so its running values are taken on
levels (``prefix_scan``): in groups of 2^24 blocks, and over the groups, of which there are at most 2^24. No window
ever holds more than that (dense numbers of 10^11 rows make 1.5 million blocks in one group), and no
step collects the first n rows of every task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.functions.arrays import pad_to
from factweave.operators.skew import partitions
from factweave.schemas import INPUT_PAD, LABEL_PAD

BLOCK_BITS = 16  # 65,536 consecutive numbers per block
LEVEL_BITS = 24  # numbers of one level in a group of the next
NUMBER_BITS = 64
HASH_BITS = 60


def _block(order: str, bits: int) -> Column:
    return F.shiftright(F.col(order).cast("long"), bits)


class Sums:
    """Prefix sums of a column."""

    def __init__(self, rows: str, name: str):
        self.rows, self.name = rows, name

    def inside(self, df: DataFrame, before: Window) -> DataFrame:
        """Add the sum of the smaller numbers of the window."""
        return df.withColumn(self.name, F.coalesce(F.sum(self.rows).over(before), F.lit(0)))

    def total(self) -> list[Column]:
        """The value of a whole group, under the names of the input."""
        return [F.sum(self.rows).alias(self.rows)]

    def joined(self, df: DataFrame, outer: dict[str, str]) -> DataFrame:
        """The value before the group, in the columns ``outer`` names, and the one inside it, as one."""
        return df.withColumn(self.name, F.col(outer[self.name]) + F.col(self.name))

    @property
    def names(self) -> list[str]:
        return [self.name]


class Marks:
    """Prefix maxima of marks (v, at), whose place ``at`` counts rows backwards from the start of its own
    block: the places shift by the rows before the block, so that of equal values the first row is the greatest."""

    def __init__(self, rows: str, mark: str, offset: str, best: str):
        self.rows, self.mark, self.offset, self.best = rows, mark, offset, best
        self.sums = Sums(rows, offset)

    @staticmethod
    def shift(mark: Column, offset: Column) -> Column:
        moved = F.struct(mark["v"].alias("v"), (mark["at"] - offset).cast("long").alias("at"))
        return F.when(mark.isNotNull(), moved)

    def inside(self, df: DataFrame, before: Window) -> DataFrame:
        placed = self.sums.inside(df, before).withColumn(self.mark, self.shift(F.col(self.mark), F.col(self.offset)))
        return placed.withColumn(self.best, F.max(self.mark).over(before))

    def total(self) -> list[Column]:
        return [*self.sums.total(), F.max(self.mark).alias(self.mark)]

    def joined(self, df: DataFrame, outer: dict[str, str]) -> DataFrame:
        best = F.greatest(F.col(outer[self.best]), self.shift(F.col(self.best), F.col(outer[self.offset])))
        return self.sums.joined(df.withColumn(self.best, best), outer)

    @property
    def names(self) -> list[str]:
        return [self.offset, self.best]


def prefix_scan(
    table: DataFrame, number: str, keys: Sequence[str], bits: int, scan: Sums | Marks, level_bits: int = LEVEL_BITS
) -> DataFrame:
    """Add to each row what ``scan`` makes of all rows of smaller numbers of the same keys.

    Any associative rule will do: it says how rows are combined inside a window, what a whole group
    is worth, and how the value before a group joins the one inside it. A number has ``bits`` bits. Values inside groups of
    2^level_bits consecutive numbers come from windows over such a group; those before the groups are found the same
    way from one row per group, until one group is left. No window holds more than one level.
    """
    if bits <= level_bits:
        before = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
        return scan.inside(table, before)
    group = f"_g{bits}"
    # The joins ask for a group of each level; asked here already, all read one shuffle of the table.
    levels = [F.col(number)]
    for _ in range(bits - level_bits, 0, -level_bits):
        levels.append(F.shiftright(levels[-1], level_bits))
    known = reduce(and_, [x.isNotNull() for x in levels[1:]])
    grouped = table.where(known).withColumn(group, F.shiftright(number, level_bits))
    inside = Window.partitionBy(*keys, group).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    here = scan.inside(grouped, inside)
    totals = here.groupBy(*keys, group).agg(*scan.total())
    outer = {n: f"_s{bits}_{n}" for n in scan.names}
    starts = prefix_scan(totals, group, keys, bits - level_bits, scan, level_bits)
    starts = starts.select(*keys, group, *[F.col(n).alias(o) for n, o in outer.items()])
    return scan.joined(here.join(starts, [*keys, group]), outer).drop(group, *outer.values())


def running_starts(
    counts: DataFrame, number: str, rows: str, keys: Sequence[str], bits: int, name: str
) -> DataFrame:
    """Add the sum of ``rows`` over all smaller numbers of the same keys; a number has ``bits`` bits."""
    return prefix_scan(counts, number, keys, bits, Sums(rows, name))


def block_places(
    df: DataFrame, order: str, keys: Sequence[str] = (), bits: int = BLOCK_BITS, number_bits: int = NUMBER_BITS
) -> DataFrame:
    """Rows of each block and the place of its first row, from the order column alone.

    With 10^11 rows at dense numbers the table has some 1.5 million blocks of 24 bytes; with sparse
    numbers at most a block per row. ``number_bits``: how many bits the numbers have.
    """
    placed = F.when(F.col(order).isNull(), F.raise_error(F.lit(f"row without {order}"))).otherwise(
        _block(order, bits)
    )
    counts = df.groupBy(*keys, placed.alias("_block")).agg(F.count("*").alias("_block_rows"))
    return running_starts(counts, "_block", "_block_rows", keys, number_bits - bits, "_block_start")


def _count_in_blocks(
    df: DataFrame,
    places: DataFrame,
    order: str,
    keys: Sequence[str],
    bits: int,
    name: str,
    ties: Sequence[str] = (),
) -> DataFrame:
    on = [*keys, "_block"]
    inside = Window.partitionBy(*on).orderBy(order, *ties)
    return (
        df.withColumn("_block", _block(order, bits))
        .join(places, on)
        .withColumn(name, F.col("_block_start") + F.row_number().over(inside) - 1)
        .drop("_block", "_block_rows", "_block_start")
    )


def dense_index(
    df: DataFrame,
    order: str = "ord",
    keys: Sequence[str] = (),
    bits: int = BLOCK_BITS,
    name: str = "idx",
    ties: Sequence[str] = (),
    number_bits: int = NUMBER_BITS,
) -> DataFrame:
    """Number the rows 0, 1, 2, ... by a unique whole-number column, per key if given.

    ``ties`` orders the rows if a few numbers may be equal.
    """
    places = block_places(df, order, keys, bits, number_bits)
    return _count_in_blocks(df, places, order, keys, bits, name, ties)


def positional_split(
    df: DataFrame, lo: int, hi: int, order: str = "ord", bits: int = BLOCK_BITS, name: str = "idx"
) -> DataFrame:
    """Rows at the places lo, ..., hi - 1, with their place.

    Only blocks which reach into the range are kept, before any row is moved, and their first
    and last numbers are a filter of the scan, which skips row groups of a sorted corpus. They are
    two scalars, since a field of one struct would not reach the scan; both read the same shuffles.
    There are at most hi - lo + 1 such blocks, for a block has at least one row.
    """
    blocks = block_places(df, order, (), bits).where(
        (F.col("_block_start") < hi) & (F.col("_block_start") + F.col("_block_rows") > lo)
    )
    first = blocks.agg(F.shiftleft(F.min("_block"), bits)).scalar()
    end = blocks.agg(F.shiftleft(F.max("_block") + 1, bits)).scalar()
    near = df.where((F.col(order) >= first) & (F.col(order) < end))
    return _count_in_blocks(near, blocks, order, (), bits, name).where(
        (F.col(name) >= lo) & (F.col(name) < hi)
    )


def head_n(df: DataFrame, n: int, order: str = "ord", bits: int = BLOCK_BITS) -> DataFrame:
    """The first n rows when n > 0, else all rows."""
    return positional_split(df, 0, n, order, bits, "_place").drop("_place") if n > 0 else df


def cap_matching(
    df: DataFrame, predicate: Column, n: int, order: str = "ord", bits: int = BLOCK_BITS
) -> DataFrame:
    """The first n rows for which the predicate holds."""
    return head_n(df.where(predicate), n, order, bits)


def stride(df: DataFrame, k: int, order: str = "ord", bits: int = BLOCK_BITS) -> DataFrame:
    """Every k-th row, starting with the first."""
    return dense_index(df, order, (), bits, "_place").where(F.col("_place") % k == 0).drop("_place")


def shard(df: DataFrame, lo: int, hi: int, order: str = "ord") -> DataFrame:
    """Rows with lo <= order < hi; the filter reaches the scan."""
    return df.where((F.col(order) >= lo) & (F.col(order) < hi))


def shuffle_key(key: Column | str, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ordered_by_hash(df: DataFrame, hashed: str, *ties: str, parts: int | None = None) -> DataFrame:
    """Rows in the order of a column of hexadecimal hashes, then of ``ties``.

    Hashes are uniform, so partitions are cut at fixed ones, n equal stretches of their first 32 bits, and sorted inside: the
    input is computed once, where a range sort would compute it a second time for a sample.
    """
    n = partitions(df) if parts is None else parts
    first = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long")
    return df.repartitionById(n, F.shiftright(first * n, 32).cast("int")).sortWithinPartitions(hashed, *ties)


def seeded_shuffle(df: DataFrame, key: str = "ord", seed: int = 666) -> DataFrame:
    """Rows in the order of a seeded hash of a unique key: the same in every run."""
    return ordered_by_hash(df.withColumn("shuffle_key", shuffle_key(key, seed)), "shuffle_key", key)


def epoch_order(
    df: DataFrame,
    key: str = "ord",
    seed: int | None = None,
    epoch: int = 0,
    bits: int | None = None,
    name: str = "idx",
) -> DataFrame:
    """Place of each row in one pass: random per (seed, epoch), or the corpus order.

    The first 60 bits of the hash take the part of the order column, 2^16 blocks by default; the
    corpus order takes the blocks of the column itself, whatever its numbers.
    """
    if seed is None:
        return dense_index(df, key, (), BLOCK_BITS if bits is None else bits, name)
    draw = F.conv(F.substring(shuffle_key(key, f"{seed}/{epoch}"), 1, 15), 16, 10).cast("long")
    bits = HASH_BITS - 16 if bits is None else bits
    drawn = df.withColumn("_draw", draw)
    return dense_index(drawn, "_draw", (), bits, name, [key], HASH_BITS).drop("_draw")


def assign_batches(
    df: DataFrame, size: int, order: str = "ord", bits: int = BLOCK_BITS
) -> DataFrame:
    """Number consecutive groups of ``size`` rows; the last group may be short."""
    return batches_of(dense_index(df, order, (), bits, "idx"), size)


def batches_of(df: DataFrame, size: int, index: str = "idx") -> DataFrame:
    return df.withColumn("batch_id", F.expr(f"`{index}` div {int(size)}"))


def pad_batches(df: DataFrame, inputs: str = "input_ids", labels: str = "label_ids") -> DataFrame:
    """Pad inputs and labels to the longest of their batch; a window holds one batch."""
    batch = Window.partitionBy("batch_id")
    return (
        df.withColumn("_in", F.max(F.size(inputs)).over(batch))
        .withColumn("_out", F.max(F.size(labels)).over(batch))
        .withColumn(inputs, pad_to(inputs, F.col("_in"), INPUT_PAD))
        .withColumn(labels, pad_to(labels, F.col("_out"), LABEL_PAD))
        .drop("_in", "_out")
    )
