"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors are dealt to shards of about ``shard_rows`` by a hash. A shard's graph starts random; its
vectors are inserted in rounds: a greedy search from the vector nearest the middle proposes
neighbours, and robust pruning keeps the nearest, then the nearest not ``alpha`` times nearer to one
already kept, so edges stay few and point in different directions. Links back are added and pruned
alike. A query is searched with a beam in every shard; the best of all shards are the answer.

A shard's vectors are the only ones a task holds at once; queries stream past in batches. Equal
vectors are one vertex with its k + 1 smallest ids, which are all that an answer can hold (one may be the
query's own), so a vector shared by very many rows is one row before anything is gathered.

Nearness is the cosine in double precision on the original vectors, ties go to the smaller id. A query
is never its own neighbour, nor are rows with its id. Vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do rows without an id; vectors of different lengths are not
compared. Repeated query rows are answered once. With fewer candidates all are returned; empty tables
give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keystride.llm.common import bound_batches, ship
from keystride.llm.vectors import directions, is_usable, matrix
from keystride.session import materialize

K = 5
SHARD_ROWS = 2048
DEGREE = 32
BEAM = 100
BUILD_BEAM = 64
ALPHA = 1.2
EXPAND = 4      # vertices a search opens at once
ROUND = 256     # vectors inserted or queries searched side by side
SEED = 3


class Graph:
    """Directed graph over unit vectors; distance is one less the cosine."""

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = SEED):
        self.unit, self.degree, self.alpha = unit, degree, alpha
        n = len(unit)
        draw = np.random.default_rng([seed, n])
        self.entry = int(np.argmax(unit @ unit.mean(axis=0)))
        start = min(degree // 2, n - 1)
        self.out = np.full((n, degree), -1, dtype=np.int64)
        if start > 0:
            shift = draw.integers(1, n, size=(n, start))
            first = (np.arange(n)[:, None] + shift) % n
            first.sort(axis=1)
            first[:, 1:][first[:, 1:] == first[:, :-1]] = -1
            self.out[:, :start] = first
        order = draw.permutation(n)
        for low in range(0, n, ROUND):
            self._insert(order[low:low + ROUND], beam)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest vertices that greedy search meets, nearest first, and their distances; -1 pads."""
        q = len(queries)
        rows = np.arange(q)
        seen = np.zeros((q, len(self.unit)), dtype=bool)
        ids = np.full((q, beam), -1, dtype=np.int64)
        far = np.full((q, beam), np.inf)
        closed = np.ones((q, beam), dtype=bool)
        ids[:, 0], closed[:, 0], seen[:, self.entry] = self.entry, False, True
        far[:, 0] = 1 - queries @ self.unit[self.entry]
        while True:
            open_at = np.where(closed, np.inf, far)
            width = min(EXPAND, beam)
            take = np.argpartition(open_at, width - 1, axis=1)[:, :width]
            real = np.take_along_axis(open_at, take, axis=1) < np.inf
            active = real.any(axis=1)
            if not active.any():
                return ids, far
            a = rows[active]
            take, real = take[active], real[active]
            closed[a[:, None], take] |= real
            heads = np.where(real, ids[a[:, None], take], -1)
            near = np.where(heads[..., None] >= 0, self.out[heads], -1).reshape(len(a), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[a[:, None], near]
            row, column = np.nonzero(fresh)
            seen[a[row], near[row, column]] = True
            at = np.where(fresh, near, 0)
            distance = 1 - np.einsum("qnd,qd->qn", self.unit[at], queries[a])
            distance[~fresh] = np.inf
            all_far = np.hstack([far[a], distance])
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            far[a] = np.take_along_axis(all_far, best, axis=1)
            ids[a] = np.take_along_axis(np.hstack([ids[a], np.where(fresh, near, -1)]), best, axis=1)
            closed[a] = np.take_along_axis(np.hstack([closed[a], ~fresh]), best, axis=1)

    def _prune(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning of candidates (-1 pads) to at most ``degree`` neighbours of each point."""
        candidates = np.where(candidates == points[:, None], -1, candidates)
        candidates.sort(axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        vectors = self.unit[candidates]
        far = 1 - np.einsum("pcd,pd->pc", vectors, self.unit[points])
        far[candidates < 0] = np.inf
        between = 1 - np.einsum("pcd,ped->pce", vectors, vectors)
        kept = np.full((len(points), self.degree), -1, dtype=np.int64)
        rows, alive = np.arange(len(points)), far.copy()
        for k in range(self.degree):
            best = np.argmin(alive, axis=1)
            some = alive[rows, best] < np.inf
            if not some.any():
                break
            kept[:, k] = np.where(some, candidates[rows, best], -1)
            covered = self.alpha * between[rows, best] <= far
            alive[covered & some[:, None]] = np.inf
            alive[rows[some], best[some]] = np.inf
        return kept

    def _insert(self, points: np.ndarray, beam: int) -> None:
        met, _ = self.search(self.unit[points], beam)
        self.out[points] = self._prune(points, np.hstack([met, self.out[points]]))
        # Links back: grouped by target, pruned where they no longer fit.
        source = np.repeat(points, self.degree)
        target = self.out[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        ends, starts, sizes = np.unique(target, return_index=True, return_counts=True)
        added = np.full((len(ends), sizes.max(initial=1)), -1, dtype=np.int64)
        added[np.repeat(np.arange(len(ends)), sizes), np.arange(len(target)) - np.repeat(starts, sizes)] = source
        for low in range(0, len(ends), ROUND):
            part = slice(low, low + ROUND)
            both = np.hstack([self.out[ends[part]], added[part]])
            self.out[ends[part]] = self._prune(ends[part], both)


class Shard:
    """A shard's graph and what its vertices stand for."""

    def __init__(self, ids: list[list[int]], rows: np.ndarray):
        self.ids = ids
        self.graph = Graph(directions(rows))

    def nearest(self, query_ids: list[int], rows: np.ndarray, k: int, beam: int):
        """(query id, vector id, cosine) of the best candidates in the shard."""
        unit = directions(rows)
        for low in range(0, len(unit), ROUND):
            met, _ = self.graph.search(unit[low:low + ROUND], min(beam, max(k + 1, len(self.ids))))
            for query, vertices, q in zip(query_ids[low:low + ROUND], met, unit[low:low + ROUND], strict=True):
                vertices = vertices[vertices >= 0]
                scores = (self.graph.unit[vertices] * q).sum(axis=1)
                found = [(-s, i) for v, s in zip(vertices, scores, strict=True) for i in self.ids[v] if i != query]
                for s, i in sorted(found)[:k]:
                    yield query, i, min(1.0, max(-1.0, -s))


def _search_shards(rows: DataFrame, k: int, beam: int) -> DataFrame:
    """``rows`` come sorted by shard, its vectors before the queries to it."""
    def run(batches):
        at, shard, ids, parts = None, None, [], []
        for batch in batches:
            keys, kinds = batch.column("shard").to_pylist(), batch.column("is_query").to_pylist()
            low = 0
            while low < batch.num_rows:
                high = low
                while high < batch.num_rows and (keys[high], kinds[high]) == (keys[low], kinds[low]):
                    high += 1
                part = batch.slice(low, high - low)
                if keys[low] != at:
                    at, shard, ids, parts = keys[low], None, [], []
                lists, vectors = part.column("ids").to_pylist(), matrix(part.column("vector"))
                if not kinds[low]:
                    ids += lists
                    parts.append(vectors)
                elif ids:
                    shard = shard or Shard(ids, np.vstack(parts))
                    found = list(shard.nearest([x[0] for x in lists], vectors, k, beam))
                    if found:
                        query, vec, score = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
                            names=["query_id", "vec_id", "score"])
                low = high

    ship(rows.sparkSession)
    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def search(embeddings: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = BEAM,
           vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` neighbours of each row that ``is_query`` (over ``vec_id``) names."""
    rows = embeddings.select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & is_usable(F.col("vector")))
    # The limit on a group's rows is applied before the shuffle as well.
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = rows.distinct().withColumn("_n", nth).where(F.col("_n") <= k + 1)
    vertices = materialize(few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    dims = F.size("vector")
    counts = {r.d: r.n for r in vertices.groupBy(dims.alias("d")).count().withColumnRenamed("count", "n").collect()}
    parts = []
    for d, n in sorted(counts.items()):
        shards = math.ceil(n / shard_rows)
        of_size = vertices.where(dims == d)
        first = of_size.select(
            F.lit(d).alias("dims"), F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int").alias("number"), "ids", "vector")
        asked = rows.where((dims == d) & is_query).distinct().select(
            F.lit(d).alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("number"),
            F.array("vec_id").alias("ids"), "vector")
        parts.append((shards, first.withColumn("is_query", F.lit(False)).unionByName(asked.withColumn("is_query", F.lit(True)))))
    if not parts:
        return embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    placed = parts[0][1]
    for _, p in parts[1:]:
        placed = placed.unionByName(p)
    placed = placed.withColumn("shard", F.concat_ws("-", "dims", "number"))
    total = sum(s for s, _ in parts)
    # Ranges, as hashes of so few keys would put several shards into one task.
    dealt = placed.repartitionByRange(total, "shard").sortWithinPartitions("shard", "is_query", "ids")
    found = _search_shards(dealt.select("shard", "is_query", "ids", "vector"), k, beam)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
