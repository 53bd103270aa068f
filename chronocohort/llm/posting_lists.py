"""Approximate nearest neighbours by balanced posting lists.

Centroids come from spherical k-means over a bounded sample (``sample_rows`` vectors in order of a hash); clusters that
hold more than twice their share are split until they do not. Each vector goes into the list of its nearest centroid
and, near a boundary, into those of all centroids whose distance is at most ``replicate`` times the smallest. A query goes
through its nearest lists until they hold ``least_rows`` different ids (more than ``k`` in any case), and visits every
list whose distance is at most ``visit`` times that of the last of them; where the search does not reach so many, it
visits all lists. Centroids are found by best-first search of a neighbour graph held in memory by each task. There are
at most ``max_lists`` of them; by default 4 times the root of the table's size, between 1,024 and 4,096, so that above
a million vectors the lists and the work of a query grow. Long lists are dealt over blocks
of about ``block_rows`` by a hash of the id, and queries of a list likewise, so a very common vector fills many tasks.
Every valid vector is indexed; within a visited list the search is exact, by cosine in double precision.

Vectors that are null, zero, of another length than most, or that hold nulls or non-finite numbers take no part, nor do
rows with a null id. Copies of a vector are all candidates; ties go to the smaller id. Rows with equal ids count as one
candidate, with the best of their scores. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from chronocohort.llm.components import stored

PAIRS = "query_id bigint, vec_id bigint, score double"


@dataclass
class Graph:
    """Unit centroids, the nearest other centroids of each, and entry points."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    @staticmethod
    def of(centroids: np.ndarray, degree: int = 16, entries: int = 8) -> Graph:
        n = len(centroids)
        near = centroids @ centroids.T
        np.fill_diagonal(near, 2.0)
        links = np.argsort(-near, axis=1, kind="stable")[:, : min(n, degree + 1)]
        # Entry points far from each other, so that every region is reached.
        chosen = [0]
        least = near[0].copy()
        while len(chosen) < min(entries, n):
            chosen.append(int(least.argmin()))
            least = np.maximum(least, near[chosen[-1]])
        return Graph(centroids, links, np.array(chosen))

    def search(self, vectors: np.ndarray, ratio: float, width: int = 48, held: np.ndarray | None = None, least: int = 0) -> Iterator[np.ndarray]:
        """For each unit vector the centroids within ``ratio`` of the smallest distance found.

        With ``held``, the ids that each list is counted for, the distance is instead that of the list with which the
        nearest ones hold ``least`` ids; all centroids, where those found do not hold so many.
        """
        n = len(self.centroids)
        for at in range(0, len(vectors), 256):
            some = vectors[at : at + 256]
            near = np.full((len(some), n), -np.inf)
            near[:, self.entries] = some @ self.centroids[self.entries].T
            opened = np.zeros((len(some), n), bool)
            while True:
                best = np.argpartition(-near, min(width, n) - 1, axis=1)[:, : min(width, n)] if n > width else np.broadcast_to(np.arange(n), (len(some), n))
                fresh = np.isfinite(np.take_along_axis(near, best, 1)) & ~np.take_along_axis(opened, best, 1)
                row, place = np.nonzero(fresh)
                if not len(row):
                    break
                node = best[row, place]
                opened[row, node] = True
                reached = np.unique((row[:, None] * n + self.links[node]).ravel())
                row, node = reached // n, reached % n
                unseen = ~np.isfinite(near[row, node])
                row, node = row[unseen], node[unseen]
                near[row, node] = np.einsum("ij,ij->i", some[row], self.centroids[node])
            distance = np.sqrt(np.maximum(0.0, 2 - 2 * near))
            for d in distance:
                base = d.min()
                if held is not None:
                    order = np.argsort(d, kind="stable")
                    enough = int(np.searchsorted(np.cumsum(held[order]), least))
                    base = d[order[enough]] if enough < n else np.inf
                yield np.flatnonzero(d <= ratio * base + 1e-12)


def _kmeans(unit: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids, farthest-first from a fixed start, then the usual rounds; empty ones go."""
    step = max(1, len(unit) // k)
    centroids = unit[::step][:k].copy()
    for _ in range(rounds):
        near = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, unit)
        size = np.linalg.norm(sums, axis=1)
        centroids = sums[size > 1e-9] / size[size > 1e-9, None]
    return centroids


def balanced_centroids(unit: np.ndarray, k: int, max_lists: int) -> np.ndarray:
    """k-means, with clusters above twice the mean split in two while there is room and they hold different vectors."""
    centroids = _kmeans(unit, k)
    near = (unit @ centroids.T).argmax(axis=1)
    done, waiting = [], [unit[near == i] for i in range(len(centroids))]
    limit = max(2, 2 * len(unit) // k)
    while waiting:
        own = waiting.pop()
        if not len(own):
            continue
        if len(own) > limit and len(done) + len(waiting) + 2 <= max_lists:
            two = _kmeans(own, 2)
            side = (own @ two.T).argmax(axis=1)
            if len(two) == 2 and 0 < side.sum() < len(own):
                waiting += [own[side == 0], own[side == 1]]
                continue
        mean = own.mean(axis=0)
        size = np.linalg.norm(mean)
        done.append(mean / size if size > 1e-9 else own[0])
    return np.stack(done)


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with nulls or non-finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or very small components stay in range.
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def nearest(
    df: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, sample_rows: int = 20_000, max_lists: int | None = None,
    list_rows: int = 200, least_rows: int = 100, replicate: float = 1.05, visit: float = 1.25, block_rows: int = 4000,
) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the k nearest of each query (a row of ``df`` that ``queries`` holds for)."""
    valid = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), queries.alias("q")).where(usable(F.col("v")) & F.col("id").isNotNull())
    sizes = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    spark = df.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, total = sizes[0]["d"], sizes[0]["count"]
    valid = valid.where(F.size("v") == dims)
    rows = valid.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").collect()
    sample = _unit(np.array([r["v"] for r in rows], np.float64))
    if max_lists is None:
        max_lists = min(4096, max(1024, 4 * math.isqrt(total)))
    graph = Graph.of(balanced_centroids(sample, int(min(max_lists // 2, max(1, total // list_rows))), max_lists))

    def placed(ratio: float, held: np.ndarray | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    lists = [found.tolist() for found in graph.search(_unit(_matrix(batch.column(1))), ratio, held=held, least=max(least_rows, k + 1))]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["id", "v", "lists"])

        return run

    schema = "id bigint, v array<double>, lists array<int>"
    posted = valid.select("id", "v").mapInArrow(placed(replicate), schema).select("id", "v", F.explode("lists").alias("list"))
    # Every id counts for one of its lists, so that lists which count more than k ids hold k others.
    places = stored(posted.select("id", "list"), "places")
    ids = np.zeros(len(graph.centroids), np.int64)
    for r in places.groupBy("id").agg(F.min("list").alias("list")).groupBy("list").count().collect():  # at most max_lists rows
        ids[r["list"]] = r["count"]
    asked = valid.where("q").select("id", "v").mapInArrow(placed(visit, ids), schema).select("id", "v", F.explode("lists").alias("list"))
    # One row per list: how many blocks its vectors and its queries are dealt over.
    blocks = places.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    turns = asked.groupBy("list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("turns"))
    shape = F.broadcast(blocks.join(turns, "list"))  # at most max_lists rows
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    posted = posted.join(shape, "list").select("list", dealt("blocks").alias("block"), every("turns").alias("turn"), "id", "v")
    asked = asked.join(shape, "list").select("list", every("blocks").alias("block"), dealt("turns").alias("turn"), "id", "v")

    def compare(ask: pa.Table, have: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if ask.num_rows and have.num_rows:
            ids = np.asarray(have.column("id").combine_chunks())
            order = np.argsort(ids, kind="stable")
            ids, units = ids[order], _unit(_matrix(have.column("v").combine_chunks()))[order]
            for query, vec in zip(np.asarray(ask.column("id").combine_chunks()), _unit(_matrix(ask.column("v").combine_chunks()))):
                rough = units @ vec
                rough[ids == query] = -np.inf
                least = np.partition(rough, -k)[-k] if len(rough) > k else -np.inf
                some = np.flatnonzero((rough >= least - 1e-9) & np.isfinite(rough))
                # Summed in one fixed order, so that copies of a vector get one and the same score.
                exact = (units[some] * vec).sum(axis=1)
                best = np.lexsort((ids[some], -exact))[:k]
                out.append((np.full(len(best), query), ids[some][best], exact[best]))
        column = lambda i, kind: pa.array(np.concatenate([x[i] for x in out]) if out else [], kind)
        return pa.table({"query_id": column(0, pa.int64()), "vec_id": column(1, pa.int64()), "score": column(2, pa.float64())})

    keys = ["list", "block", "turn"]
    found = asked.groupBy(*keys).cogroup(posted.groupBy(*keys)).applyInArrow(compare, PAIRS).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
