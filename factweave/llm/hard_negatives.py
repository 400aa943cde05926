"""Hard negatives by threshold joins of anchors with all rows.

Scores are inner products of integers. The positives of an anchor are its best rows of the same
label; each positive gives a window of scores, and the best rows of another label inside the window
are its negatives. Both are found by joins with a threshold (``threshold_join``): the threshold of an
anchor, or of a window, starts high and is lowered, round by round, only for those which are not
full yet; a last round has no threshold (for windows: their lower end), so the result is whole for any data.

A join runs in tiles: rows are dealt to parts of about ``PART_ROWS`` by a hash of the id, anchors to blocks
of about ``BLOCK_ANCHORS``, and each pair of a part and a block is one group, in which every anchor keeps only
its best few. So no label, copy or anchor can make a large group, and no pairs of copies are made. A
round is written to the shared folder, as are the rows. Work is anchors x rows less what the bounds spare; without clusters
they spare little.

Contract for odd input: a row with a null id, label or vector, or with a null or non-finite
component takes no part; an empty vector is all zeros, and shorter vectors end in zeros; of rows
which repeat an id the one with the least label and vector counts; an anchor is no partner of its own; fewer
partners than asked for are all returned; positives below zero have no window (its ends cross), one of zero has the rows of
score zero; ties go to the smaller id. Scores must fit in a long; one that does not is an error.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.llm.components import shared_folder, stored
from factweave.llm.threshold_join import Index
from factweave.operators.skew import join_to_unique

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score, in hundredths of the positive's
PART_ROWS, BLOCK_ANCHORS = 4_096, 4_096
#: Thresholds of the positives, as a share of the anchor's norm times the mean norm; the last one is none.
FOR_POSITIVES = (0.4, 0.2, 0.0, float("-inf"))
#: Thresholds of a window, as a share of it from its upper end.
FOR_WINDOWS = (0.25, 0.5, 1.0)

_WINDOW = "struct<positive_id:long,positive_score:long,least:long,most:long>"
_FOUND = "anchor_id long, positive_id long, positive_score long, id long, score long"


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, x): one row per id, x as longs of one length."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), label.cast("string").alias("label"), x.alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & good)
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(v * scale)))
    row = F.min(F.struct("label", "x")).alias("row")
    return rows.groupBy("id").agg(row).select("id", "row.label", "row.x")


def _long_rows(lists: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return np.asarray(lists.flatten()).reshape(n, -1)


class Tile:
    """Rows of a part, indexed for the anchors of a block."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, order: np.ndarray):
        self.ids = np.asarray(rows.column("id"))
        self.asked = _long_rows(anchors.column("x"), anchors.num_rows)[:, order]
        self.thresholds = np.asarray(anchors.column("threshold"))
        self.anchors = anchors.column("id").to_pylist()
        labels = rows.column("label").to_pylist() + anchors.column("label").to_pylist()
        _, codes = np.unique(np.array(labels, dtype=object), return_inverse=True)
        self.labels, self.own = codes[: len(self.ids)], codes[len(self.ids) :]
        norms = np.sqrt((self.asked.astype(np.float64) ** 2).sum(axis=1))
        # The least threshold per norm; where one is not positive every row is indexed whole.
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(self.thresholds > 0, self.thresholds / norms, 0.0).min()
        self.index = Index(_long_rows(rows.column("x"), rows.num_rows)[:, order], float(least))

    def partners(self, i: int, same_label: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the rows at the threshold of an anchor or above, best first."""
        places, scores = self.index.at_least(self.asked[i], self.thresholds[i])
        fits = (self.labels[places] == self.own[i]) == same_label
        fits &= self.ids[places] != self.anchors[i]
        ids, scores = self.ids[places[fits]], scores[fits]
        best = np.lexsort((ids, -scores))
        return ids[best], scores[best]


def _table(rows: Iterable[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    names = [c.split()[0] for c in _FOUND.split(", ")]
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=names)


def positives_of(tile: Tile, k: int) -> list[tuple]:
    out = []
    for i, anchor in enumerate(tile.anchors):
        ids, scores = tile.partners(i, True)
        out.extend((anchor, None, None, x, s) for x, s in zip(ids[:k].tolist(), scores[:k].tolist(), strict=True))
    return out


def negatives_of(tile: Tile, windows: list[list[dict]], k: int) -> list[tuple]:
    out = []
    for i, anchor in enumerate(tile.anchors):
        ids, scores = tile.partners(i, False)
        for w in windows[i]:
            at = np.searchsorted(-scores, -w["most"])  # first of at most this score
            some = slice(int(at), int(at) + k)
            found = zip(ids[some].tolist(), scores[some].tolist(), strict=True)
            out.extend((anchor, w["positive_id"], w["positive_score"], x, s) for x, s in found if s >= w["least"])
    return out


class _Join:
    """Rows in parts, and one round of a join with anchors (id, label, x, threshold, windows)."""

    def __init__(self, rows: DataFrame, folder: str):
        self.spark, self.folder, self.rounds = rows.sparkSession, folder, 0
        rows = stored(rows, f"{folder}/rows")
        shape = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
        self.n, width = shape.n, max(shape.width or 0, 1)
        whole = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
        self.rows = rows.withColumn("x", whole)
        energy = self.rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("double") * F.col("col")).alias("e"))
        by_energy = sorted((r.e, r.pos) for r in energy.collect())  # one row per dimension
        self.order = np.array([p for _, p in by_energy] or [0])
        self.mean_norm = (sum(e for e, _ in by_energy) / max(self.n, 1)) ** 0.5
        self.parts = max(1, -(-self.n // PART_ROWS))

    def run(self, anchors: DataFrame, n_anchors: int, same_label: bool, k: int) -> DataFrame:
        """The best ``k`` of each anchor (or window) over all tiles; written to the shared folder."""
        blocks, order = max(1, -(-n_anchors // BLOCK_ANCHORS)), self.order
        part = F.pmod(F.xxhash64("id"), F.lit(self.parts))
        block = F.pmod(F.xxhash64("id"), F.lit(blocks))

        def every(n: int) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

        rows = self.rows.withColumn("part", part).withColumn("block", every(blocks))
        asked = anchors.withColumn("block", block).withColumn("part", every(self.parts))

        def tile(row_table: pa.Table, anchor_table: pa.Table) -> pa.Table:
            if not row_table.num_rows or not anchor_table.num_rows:
                return _table([])
            found = Tile(row_table, anchor_table, order)
            if same_label:
                return _table(positives_of(found, k))
            return _table(negatives_of(found, anchor_table.column("windows").to_pylist(), k))

        found = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(tile, _FOUND)
        best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
        self.rounds += 1
        return stored(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), f"{self.folder}/round{self.rounds}")


def _positives(join: _Join, anchors: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score) of every anchor."""
    same = join.rows.groupBy("label").agg((F.count("*") - 1).alias("same"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    open_ = join_to_unique(anchors, same, "label", spread_by="id").withColumn("wanted", F.least("same", F.lit(k))).withColumn("norm", norm)
    open_, done = stored(open_.drop("same"), f"{join.folder}/anchors").where("wanted > 0"), []
    for number, share in enumerate(FOR_POSITIVES):
        if not (n := open_.count()):
            break
        threshold = F.lit(share) if share == float("-inf") else F.col("norm") * join.mean_norm * share
        asked = open_.select("id", "label", "x", threshold.alias("threshold"))
        found = join.run(asked, n, True, k)
        full = open_.join(found.groupBy(F.col("anchor_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
        full = stored(full.withColumn("full", F.coalesce("n", F.lit(0)) >= F.col("wanted")).drop("n"), f"{join.folder}/anchors{number}")
        done.append(found.join(full.where("full").select(F.col("id").alias("anchor_id")), "anchor_id", "left_semi"))
        open_ = full.where("not full").drop("full")
    chosen = [d.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")) for d in done]
    return _union(chosen, join.spark, "anchor_id long, positive_id long, positive_score long")


def _union(tables: list[DataFrame], spark, schema: str) -> DataFrame:
    out = tables[0] if tables else spark.createDataFrame([], schema)
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row for
    which ``is_anchor``, a condition on column id, holds. ``label`` is an expression over the input."""
    join = _Join(integer_rows(vectors, id_col, vector_col, label, scale), shared_folder(vectors.sparkSession, "negatives"))
    anchors = join.rows.where(is_anchor)
    chosen = stored(_positives(join, anchors, positives), f"{join.folder}/positives")
    score = F.col("positive_score")
    ends = (F.expr(f"(positive_score * {low} + 99) div 100").alias("lower"), F.expr(f"positive_score * {high} div 100").alias("most"))
    open_ = chosen.where(score >= 0).select("*", *ends).where("lower <= most")
    done = []
    for number, share in enumerate(FOR_WINDOWS):
        least = F.col("most") - F.floor((F.col("most") - F.col("lower")) * share).cast("long")
        open_ = stored(open_.withColumn("least", F.col("lower") if share == 1 else least), f"{join.folder}/windows{number}")
        windows = F.struct("positive_id", "positive_score", "least", "most")
        asked = open_.groupBy(F.col("anchor_id").alias("id")).agg(
            F.collect_list(windows).cast(f"array<{_WINDOW}>").alias("windows"), F.min("least").cast("double").alias("threshold")
        )
        asked = stored(anchors.join(asked, "id"), f"{join.folder}/asked{number}")
        if not (n := asked.count()):
            break
        found = join.run(asked, n, False, negatives)
        if share == FOR_WINDOWS[-1]:
            done.append(found)
            break
        keys = ["anchor_id", "positive_id"]
        full = found.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= negatives).drop("n")
        done.append(found.join(full, keys, "left_semi"))
        open_ = open_.drop("least").join(full, keys, "left_anti")
    found = _union(done, join.spark, f"{_FOUND}, rank int")
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
