"""Exact top-k inner products by branch and bound over ball trees.

Candidates are scanned where they lie; every task builds a ball tree over each few thousand of them. A node's ball bounds
the inner product of a query with all vectors inside, nodes are visited from the highest bound down, and
a search ends when no bound reaches the current k-th score. That score is shared: a bounded sample of
candidates gives each query its first one, and a task hands it on from tree to tree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.session import materialize

SCALE, TOP = 1024, 10
SHARD_ROWS, LEAF_ROWS = 8192, 256
# Query vectors that one broadcast holds, and candidates that give the first k-th scores.
BLOCK_BYTES, SEED_ROWS = 8 << 20, 2048
_EXACT = 2.0**53


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(F.col(vector).cast("array<double>"), fine), F.lit(True))


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of every component, as doubles that hold whole numbers."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(vectors * float(scale)), posinf=1.7e308, neginf=-1.7e308)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; a sum outside that range is held at its end."""
    if len(query) == 0:
        return np.zeros(len(vectors), np.int64)
    peak = np.abs(vectors).max(initial=0.0) * np.abs(query).max(initial=0.0) * len(query)
    if peak < _EXACT:
        return (vectors @ query).astype(np.int64)
    q = [int(x) for x in query]
    sums = [sum(int(x) * y for x, y in zip(row, q)) for row in vectors]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in sums], np.int64)


class BallTree:
    """Vectors in the order of their leaves, with centre, radius and children of each node."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        order = np.arange(len(ids))
        centres, radii, spans, children = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node, mine = len(spans), order[lo:hi]
            points = vectors[mine]
            with np.errstate(over="ignore", invalid="ignore"):
                centre = points.mean(0)
                radius = float(np.sqrt(((points - centre) ** 2).sum(1).max())) if points.size else 0.0
            centres.append(centre)
            radii.append(radius)
            spans.append((lo, hi))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = node
            if hi - lo > leaf_rows:
                with np.errstate(over="ignore", invalid="ignore"):
                    wide = int(np.argmax(np.ptp(points, axis=0))) if points.shape[1] else 0
                cut = (hi - lo) // 2
                if points.shape[1]:
                    order[lo:hi] = mine[np.argpartition(points[:, wide], cut)]
                todo += [(lo + cut, hi, node, 1), (lo, lo + cut, node, 0)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres, self.radii, self.spans, self.children = np.array(centres), np.array(radii), spans, children

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product, a row for each query; a little above the true ones for rounding."""
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.sqrt((queries**2).sum(1))[:, None]
            reach = np.sqrt((self.centres**2).sum(1)) + self.radii
            bound = queries @ self.centres.T + norms * self.radii + 1e-9 * norms * reach + 1e-6
        return np.where(np.isnan(bound), np.inf, bound)

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, best: "Best") -> None:
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < best.floor:
                return
            left, right = self.children[node]
            if left < 0:
                lo, hi = self.spans[node]
                best.offer(self.ids[lo:hi], products(self.vectors[lo:hi], query), own)
            else:
                for child in (left, right):
                    if bounds[child] >= best.floor:
                        heapq.heappush(heap, (-bounds[child], child))


class Best:
    """The highest scores of one query so far, ties to smaller ids; ``floor`` is what a newcomer must reach."""

    def __init__(self, k: int, floor: float) -> None:
        self.k, self.floor = k, floor
        self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray, own: int) -> None:
        keep = (scores >= self.floor) & (ids != own)
        if not keep.any():
            return
        ids, scores = np.r_[self.ids, ids[keep]], np.r_[self.scores, scores[keep]]
        order = np.lexsort((ids, -scores.astype(object) if scores.min() == -(1 << 63) else -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.floor = max(self.floor, float(np.nextafter(float(self.scores[-1]), -np.inf)) if abs(
                int(self.scores[-1])) >= _EXACT else float(self.scores[-1]))


def _stacked(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number vectors by number of components."""
    by_width: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors):
        held = by_width.setdefault(len(v), ([], []))
        held[0].append(i)
        held[1].append(v)
    return {
        d: (np.array(i, np.int64), whole(np.array(v, np.float64).reshape(len(i), d))) for d, (i, v) in by_width.items()
    }


def _rows(df: DataFrame) -> tuple[list, list]:
    table = df.toArrow()
    return table.column("id").to_pylist(), table.column("v").to_pylist()


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES, id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products over all ``vectors``.

    Components become ``floor(1024 * x)``. Ties go to the smaller id. A query meets no row of its own id, and only
    vectors with as many components. Rows with a null id, a null vector, or a null or non-finite component take no
    part. Rows that repeat an id are candidates each; as queries the smallest vector stands for the id. Queries
    are broadcast in blocks of ``block_bytes``, and each block scans the candidates once.
    """
    spark = vectors.sparkSession

    def plain(df: DataFrame) -> DataFrame:
        return df.filter(usable(vector_column) & F.col(id_column).isNotNull()).select(
            F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")
        )

    asked = materialize(plain(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    candidates = plain(vectors)
    total = asked.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    # The first k-th scores come from the candidates with the smallest hashes.
    seed = _stacked(*_rows(candidates.orderBy(F.xxhash64("id"), "id").limit(SEED_ROWS)))
    found = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        held = {}
        for d, (ids, q) in _stacked(*_rows(mine)).items():
            floors = np.full(len(ids), -np.inf)
            if d in seed:
                tree = BallTree(*seed[d])
                bounds = tree.bounds(q)
                for i in range(len(ids)):
                    best = Best(k, -np.inf)
                    tree.search(q[i], int(ids[i]), bounds[i], best)
                    floors[i] = best.floor
            held[d] = (ids, q, floors)
        part = _search(candidates, spark.sparkContext.broadcast(held), k)
        part = part if blocks == 1 else materialize(part, "block")
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(candidates: DataFrame, shared, k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        best = {d: [Best(k, f) for f in floors] for d, (_, _, floors) in held.items()}
        waiting: tuple[list, list] = ([], [])

        def search() -> None:
            for d, (ids, vectors) in _stacked(*waiting).items():
                if d in held:
                    asked, q, _ = held[d]
                    tree = BallTree(ids, vectors)
                    for lo in range(0, len(asked), 1024):
                        bounds = tree.bounds(q[lo : lo + 1024])
                        for i in range(lo, min(lo + 1024, len(asked))):
                            tree.search(q[i], int(asked[i]), bounds[i - lo], best[d][i])
            waiting[0].clear()
            waiting[1].clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(lo, SHARD_ROWS)
                waiting[0].extend(part.column("id").to_pylist())
                waiting[1].extend(part.column("v").to_pylist())
                if len(waiting[0]) >= SHARD_ROWS:
                    search()
        search()
        for d, (asked, _, _) in held.items():
            for lo in range(0, len(asked), 4096):
                mine = [(int(asked[i]), best[d][i]) for i in range(lo, min(lo + 4096, len(asked)))]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array([q for q, _ in mine], np.int64), [len(b.ids) for _, b in mine])),
                    pa.array(np.concatenate([b.ids for _, b in mine])),
                    pa.array(np.concatenate([b.scores for _, b in mine])),
                ], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(scan, "query_id long, vec_id long, score long")
