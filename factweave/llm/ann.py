"""Approximate nearest neighbours by cosine, with an inverted multi-index.

Unit vectors are cut into two halves, each half is quantised by its own centroids, and a vector's cell
is the pair of them. A query ranks the centroids of each half by distance and walks the pairs in
order of their summed distance with a heap, until the cells it has seen hold enough entries; these
are ranked by the exact cosine of the original vectors in double precision. Enough is a share of the
index, the same at every size: vectors without any clusters, the hardest case, need to look at about four tenths of it for nine
tenths of the true neighbours; clustered ones need far less, and ``share`` can be lowered.

Centroids are fitted on at most ``SAMPLE`` vectors, the first by a hash of the id; every vector is
indexed. Equal vectors are one entry which carries as many of its least ids as a result can use, so a
vector in a third of all rows costs one entry. Cells are dealt by their first centroid, in parts of about
``PART_ROWS`` entries; a query is sent once to each part with the cells it looks at there, and each part
answers with its best few, so neither a cell nor a query meets in one task.

Contract for odd input: a vector that is null, empty, zero, of another length than most, or holds a null or
non-finite component takes no part, as do null ids; rows which repeat an id and vector are one; a
query's own id is no candidate, equal vectors of other ids are; ties go to the smaller id; fewer
candidates than asked for are all returned if the index is small.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.components import first_by_hash, shared_folder, stored
from factweave.operators.skew import partitions

SAMPLE = 20_000
CENTROIDS = 64
ROUNDS = 12
SHARE = 0.5
ENTRIES_PER_RESULT = 20  # looked at, at least
PART_ROWS = 4_096
_KEY = "query_id"


def valid(vector: Column) -> Column:
    """Whether a vector has a direction."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _rows(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = np.asarray(vectors.flatten()).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    largest = np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    rows = rows / largest
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centroids.T + (centroids * centroids).sum(axis=1)[None, :]


def centroids_of(rows: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm from rows spread over the sample; an empty centroid stays where it was."""
    centroids = rows[np.linspace(0, len(rows) - 1, min(count, len(rows))).astype(int)]
    for _ in range(rounds):
        nearest = _distances(rows, centroids).argmin(axis=1)
        size = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return centroids


def pairs_by_distance(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids by the sum of their distances, least first, from a heap of next pairs."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[one[0]] + second[two[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(one[i]), int(two[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(one) and b < len(two) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (first[one[a]] + second[two[b]], a, b))


class MultiIndex:
    """Centroids of both halves and the entries of each cell."""

    def __init__(self, sample: np.ndarray, count: int):
        self.half = sample.shape[1] // 2
        unit = _unit(sample)
        self.first = centroids_of(unit[:, : self.half], count)
        self.second = centroids_of(unit[:, self.half :], count)
        self.entries: dict[tuple[int, int], int] = {}

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each half."""
        unit = _unit(rows)
        one = _distances(unit[:, : self.half], self.first).argmin(axis=1)
        two = _distances(unit[:, self.half :], self.second).argmin(axis=1)
        return one, two

    def visited(self, rows: np.ndarray, enough: int) -> list[dict[int, list[int]]]:
        """Cells which each query looks at: second centroids by first."""
        unit = _unit(rows)
        one, two = _distances(unit[:, : self.half], self.first), _distances(unit[:, self.half :], self.second)
        out = []
        for a, b in zip(one, two, strict=True):
            cells, held = {}, 0
            for i, j in pairs_by_distance(a, b):
                if size := self.entries.get((i, j), 0):
                    cells.setdefault(i, []).append(j)
                    held += size
                if held >= enough:
                    break
            out.append(cells)
        return out


def _distinct(vectors: DataFrame, keep: int) -> DataFrame:
    """(vector, ids): different vectors, each with its ``keep`` least ids, fewer first by a window
    limit that Spark applies before the shuffle."""
    from pyspark.sql import Window

    rows = vectors.distinct()
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("place", place).where(F.col("place") <= keep)
    return few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(_KEY).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = SAMPLE,
    centroids: int = CENTROIDS,
    share: float = SHARE,
    enough: int | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each row for which ``is_query``, a
    condition on column id, holds. A query looks at ``share`` of all entries, and at ``enough`` at least, by
    default ``ENTRIES_PER_RESULT`` times ``k``."""
    spark = vectors.sparkSession
    folder = shared_folder(spark, "vectors")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("vector")))
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, id long, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == width.n)
    entries = stored(_distinct(rows, k + 1), f"{folder}/entries")
    chosen = first_by_hash(entries.select("vector"), sample, "vector").toArrow()
    index = MultiIndex(_rows(chosen.column(0)), centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = [pa.array(x) for x in index.cells(_rows(batch.column("vector")))]
                yield pa.record_batch([*cells, batch.column("vector"), batch.column("ids")], names=["first", "second", "vector", "ids"])

    placed = entries.mapInArrow(place, "first long, second long, vector array<double>, ids array<long>")
    placed = stored(placed, f"{folder}/cells")
    sizes = placed.groupBy("first", "second").agg(F.count("*").alias("n")).collect()
    index.entries = {(r["first"], r.second): r.n for r in sizes}
    held = np.bincount([r["first"] for r in sizes], weights=[r.n for r in sizes], minlength=len(index.first))
    parts = np.maximum(np.ceil(held / PART_ROWS), 1).astype(int).tolist()
    wanted = max(ENTRIES_PER_RESULT * k if enough is None else enough, int(share * held.sum()))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = index.visited(_rows(batch.column("vector")), wanted)
            to = [(i, c, p, seconds) for i, cells in enumerate(seen) for c, seconds in cells.items() for p in range(parts[c])]
            at, first, part, seconds = zip(*to, strict=True)
            at = pa.array(at)
            columns = [pa.array(first), pa.array(part), batch.column("id").take(at), batch.column("vector").take(at), pa.array(seconds)]
            yield pa.record_batch(columns, names=["first", "part", "query_id", "query", "seconds"])

    # Few rows with much work each: dealt over all partitions, which Spark would merge for their size.
    asked = rows.where(is_query).distinct().repartition(partitions(rows), "id")
    asked = asked.mapInArrow(visit, "first long, part long, query_id long, query array<double>, seconds array<long>")
    counts = F.broadcast(spark.createDataFrame(list(enumerate(parts)), "first long, parts int"))
    part = F.pmod(F.xxhash64("vector"), F.col("parts")).alias("part")
    dealt = placed.join(counts, "first").select("first", part, "second", "vector", "ids")

    def answer(entries_: pa.Table, queries: pa.Table) -> pa.Table:
        return _best(entries_, queries, k)

    found = dealt.groupBy("first", "part").cogroup(asked.groupBy("first", "part")).applyInArrow(answer, "query_id long, id long, score double")
    return _ranked(found, k).select(_KEY, "rank", "id", "score")


def _best(entries: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The best few of one part for each query that looks into it."""
    out: list[tuple[int, int, float]] = []
    if entries.num_rows and queries.num_rows:
        rows, ids = _unit(_rows(entries.column("vector"))), entries.column("ids").to_pylist()
        second = np.asarray(entries.column("second"))
        asked = zip(queries.column("query_id").to_pylist(), _unit(_rows(queries.column("query"))), queries.column("seconds").to_pylist(), strict=True)
        for query, vector, seconds in asked:
            allowed = np.zeros(second.max() + 1, bool)
            allowed[[s for s in seconds if s < len(allowed)]] = True
            at = np.flatnonzero(allowed[second])
            scores = (rows[at] * vector).sum(axis=1)
            if len(scores) > k + 1:
                least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                at, scores = at[scores >= least], scores[scores >= least]
            pairs = zip(at.tolist(), scores.tolist(), strict=True)
            best = sorted((-s, x) for i, s in pairs for x in ids[i] if x != query)[:k]
            out.extend((query, x, -s) for s, x in best)
    columns = list(zip(*out, strict=True)) if out else [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "id", "score"])
