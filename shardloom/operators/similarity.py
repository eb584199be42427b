"""All-pairs similarity without all-pairs rows.

Two exact forms share the same numpy kernels:

* resident: the smaller side's matrix is proved to fit ``RESIDENT_BYTES`` and is
  broadcast, so the other side is scanned in place without a shuffle;
* lanes: both sides are cut into lanes by a hash of the id. Every image lane meets every
  text lane in exactly one cell, an equi-join on the cell number. A cell holds two lanes
  of at most about ``LANE_BYTES`` each, and only partial results leave it.

The lane of a row depends on its id alone, so a task that is run again after a lost
executor sees the same cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.vectors import NORM_FLOOR, cosine
from shardloom.session import materialize

# Fixed value: scores are compared after rounding to this many decimals; ties go to the lowest id.
DECIMALS = 9

RESIDENT_BYTES = 64 << 20
LANE_BYTES = 32 << 20
# Texts and images of one tile of scores.
TILE, TILE_ROWS = 2048, 256

TOPK_SCHEMA = "image_id bigint, rank int, caption_id bigint, score double"
COUNT_SCHEMA = "id bigint, i2t bigint, t2i bigint"


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Matrix of normalised rows from a list column. A null vector or component, or one of another length, is an error."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    if vectors.null_count or vectors.flatten().null_count:
        raise ValueError("null among the vectors")
    if len(set(np.diff(np.asarray(vectors.offsets)).tolist())) > 1:
        raise ValueError("vectors of different lengths")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n == 0:
        return flat.reshape(0, 0)
    m = flat.reshape(n, -1)
    for x in tiles(n):
        norm = np.sqrt((m[x] * m[x]).sum(axis=1))
        m[x] /= np.maximum(norm, NORM_FLOOR)[:, None]
    return m


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def tiles(n: int, size: int = TILE) -> Iterator[slice]:
    for start in range(0, n, size):
        yield slice(start, min(start + size, n))


def best_k(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the k best columns, score first and lowest id on ties.

    Column ids must be ascending, so that a stable sort settles ties.
    """
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return ids[order], np.take_along_axis(scores, order, axis=1)


def block_topk(a: np.ndarray, t: np.ndarray, t_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Running top-k of every row of ``a`` against all of ``t``, one tile of both at a time. ``t_ids`` must be ascending."""
    found = [_tile_topk(a[x], t, t_ids, k) for x in tiles(len(a), TILE_ROWS)]
    if not found:
        return np.empty((0, min(k, len(t_ids))), np.int64), np.empty((0, min(k, len(t_ids))))
    return np.vstack([ids for ids, _ in found]), np.vstack([scores for _, scores in found])


def _tile_topk(a: np.ndarray, t: np.ndarray, t_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.empty((len(a), 0), np.int64)
    scores = np.empty((len(a), 0))
    for s in tiles(len(t_ids)):
        sims = a @ t[s].T
        if ids.shape[1] < k:
            ids, scores = _merge_topk(ids, scores, t_ids[s], np.round(sims, DECIMALS), k)
            continue
        # Later texts have higher ids, so only a score above the k-th best, after rounding, changes a row. NaN is looked at.
        rows = np.flatnonzero(~(sims.max(axis=1) <= scores[:, -1] + 0.25 * 10.0**-DECIMALS))
        if len(rows):
            ids[rows], scores[rows] = _merge_topk(ids[rows], scores[rows], t_ids[s], np.round(sims[rows], DECIMALS), k)
    return ids, scores


def _merge_topk(
    ids: np.ndarray, scores: np.ndarray, t_ids: np.ndarray, sims: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """The k best of those held and of one more tile of texts."""
    if sims.shape[1] > 4 * k:
        # Keep every column that ties with the k-th best, then settle ties by id.
        floor = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
        width = max(k, int((sims >= floor[:, None]).sum(axis=1).max()))
        if width <= 4 * k:
            pick = np.sort(np.argpartition(-sims, width - 1, axis=1)[:, :width], axis=1)
            new_ids, new_scores = t_ids[pick], np.take_along_axis(sims, pick, axis=1)
        else:
            new_ids, new_scores = best_k(t_ids, sims, k)
    else:
        new_ids, new_scores = np.broadcast_to(t_ids, sims.shape), sims
    all_ids = np.hstack([ids, new_ids])
    all_scores = np.hstack([scores, new_scores])
    order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
    return np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_scores, order, axis=1)


def block_better(
    a: np.ndarray, a_ids: np.ndarray, a_pos: np.ndarray,
    t: np.ndarray, t_ids: np.ndarray, t_pos: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """How many rivals beat each image's and each text's own partner inside this block."""
    i2t = np.zeros(len(a_ids), np.int64)
    t2i = np.zeros(len(t_ids), np.int64)
    for x in tiles(len(a_ids), TILE_ROWS):
        for y in tiles(len(t_ids)):
            sims = np.round(a[x] @ t[y].T, DECIMALS)
            ai, ti = a_ids[x][:, None], t_ids[y][None, :]
            ap, tp = a_pos[x][:, None], t_pos[y][None, :]
            rival = ai != ti
            i2t[x] += ((sims > ap) & rival).sum(axis=1) + ((sims == ap) & (ti < ai)).sum(axis=1)
            t2i[y] += ((sims > tp) & rival).sum(axis=0) + ((sims == tp) & (ai < ti)).sum(axis=0)
    return i2t, t2i


def vector_bytes(df: DataFrame, column: str = "v") -> tuple[int, int]:
    """Row count and size in bytes as doubles."""
    n, width = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(column)), F.lit(0))).first()
    return n, n * width * 8


def lanes_for(total: int, floor: int, limit: int = LANE_BYTES) -> int:
    return max(1, floor, math.ceil(total / limit))


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that a table can be cogrouped with itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def cells(images: DataFrame, texts: DataFrame, rows: int, cols: int) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by ``row``, ``col`` such that each pair of ids shares exactly one cell.

    The number of tasks is fixed: a cell costs far more than its bytes suggest to adaptive
    execution.
    """
    most = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(rows * cols, max(most, 4 * images.sparkSession.sparkContext.defaultParallelism))
    left = images.withColumn("row", F.pmod(F.xxhash64("id"), F.lit(rows)).cast("int")).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))
    )
    right = fresh(texts).withColumn("col", F.pmod(F.xxhash64("id"), F.lit(cols)).cast("int")).withColumn(
        "row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))
    )
    return left.repartition(tasks, "row", "col"), right.repartition(tasks, "row", "col")


def grid_side(df: DataFrame) -> int:
    """Lanes per side that give every core a couple of cells."""
    return max(1, math.ceil(math.sqrt(2 * df.sparkSession.sparkContext.defaultParallelism)))


def topk(
    images: DataFrame,
    texts: DataFrame,
    k: int,
    resident_bytes: int = RESIDENT_BYTES,
    lane_bytes: int = LANE_BYTES,
) -> DataFrame:
    """Best ``k`` texts of every image as ``image_id, rank, caption_id, score``, exact.

    Both inputs are ``(id, v)``. Hand in stored tables: each side may be read more than once. Rows
    without a vector, as of unreadable images, take no part; vectors of other lengths are an error.
    """
    images, texts = with_vector(images.select("id", "v")), with_vector(texts.select("id", "v"))
    n_text, text_size = vector_bytes(texts)
    if text_size <= resident_bytes:
        return _topk_resident(images, texts, k)
    n_image, image_size = vector_bytes(images)
    side = grid_side(images)
    left, right = cells(
        images, texts, lanes_for(image_size, side, lane_bytes), lanes_for(text_size, side, lane_bytes)
    )

    def cell(left_part: pa.Table, right_part: pa.Table) -> pa.Table:
        if left_part.num_rows == 0 or right_part.num_rows == 0:
            return _topk_table(np.empty(0, np.int64), np.empty((0, k), np.int64), np.empty((0, k)))
        right_part = right_part.sort_by("id")
        got = block_topk(
            unit_rows(left_part["v"]), unit_rows(right_part["v"]), ids_of(right_part["id"]), k
        )
        return _topk_table(ids_of(left_part["id"]), *got)

    partial = (
        left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(cell, TOPK_SCHEMA)
    )
    return keep_k(partial, k)


def keep_k(partial: DataFrame, k: int) -> DataFrame:
    """Merge partial top-k rows. The rank filter is also applied before the exchange."""
    best = Window.partitionBy("image_id").orderBy(F.col("score").desc(), "caption_id")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _topk_table(image_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "image_id": pa.array(np.repeat(image_ids, ids.shape[1])),
            "rank": pa.array(np.tile(np.arange(1, ids.shape[1] + 1, dtype=np.int32), len(image_ids))),
            "caption_id": pa.array(ids.ravel()),
            "score": pa.array(scores.ravel()),
        }
    )


def _topk_resident(images: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    table = texts.toArrow().sort_by("id")
    if table.num_rows == 0:
        return images.sparkSession.createDataFrame([], TOPK_SCHEMA)
    held = images.sparkSession.sparkContext.broadcast((ids_of(table["id"]), unit_rows(table["v"])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t_ids, t = held.value
        for batch in batches:
            for s in tiles(batch.num_rows):
                part = batch.slice(s.start, s.stop - s.start)
                got = block_topk(unit_rows(part["v"]), t, t_ids, k)
                yield from _topk_table(ids_of(part["id"]), *got).to_batches()

    # A row's work is a product with all texts, so rows are spread where their few bytes lie in fewer tasks than cores.
    tasks = 2 * images.sparkSession.sparkContext.defaultParallelism
    spread = images if images.rdd.getNumPartitions() >= tasks else images.repartition(tasks, "id")
    return spread.mapInArrow(scan, TOPK_SCHEMA)


def with_vector(df: DataFrame, column: str = "v") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def joined_pairs(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Image i with text i as ``id, iv, tv`` and the other image columns; pairs need both vectors."""
    return with_vector(images).withColumnRenamed("v", "iv").join(
        with_vector(texts).select("id", F.col("v").alias("tv")), "id"
    )


def positive_pairs(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Image i with text i and their similarity ``p``."""
    return scored_pairs(joined_pairs(images.select("id", "v"), texts))


def scored_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("id", "iv", "tv", F.round(cosine(F.col("iv"), F.col("tv")), DECIMALS).alias("p"))


def paired_score(images: DataFrame, texts: DataFrame) -> DataFrame:
    return positive_pairs(images, texts).select("id", F.col("p").alias("score"))


def better_counts(
    images: DataFrame,
    texts: DataFrame,
    resident_bytes: int = RESIDENT_BYTES,
    lane_bytes: int = LANE_BYTES,
) -> DataFrame:
    """``id, i2t, t2i``: rivals that outrank the true partner, in both directions.

    Counting replaces a full sort of each row. One product of two blocks serves both
    directions, and counts add up over blocks with map-side combine. Only pairs are ranked, and only
    paired vectors are rivals.
    """
    return better_counts_of(positive_pairs(images, texts), resident_bytes, lane_bytes)


def better_counts_of(
    pairs: DataFrame, resident_bytes: int = RESIDENT_BYTES, lane_bytes: int = LANE_BYTES
) -> DataFrame:
    """``better_counts`` of scored pairs ``id, iv, tv, p``."""
    n, size = vector_bytes(pairs, "tv")
    resident = size <= resident_bytes
    if not resident:
        pairs = materialize(pairs, "pairs")
    left = pairs.select("id", "p", F.col("iv").alias("v"))
    right = pairs.select("id", "p", F.col("tv").alias("v"))
    if resident:
        partial = _better_resident(left, right)
    else:
        lanes = lanes_for(size, grid_side(pairs), lane_bytes)
        left, right = cells(left, right, lanes, lanes)

        def cell(a: pa.Table, b: pa.Table) -> pa.Table:
            if a.num_rows == 0 or b.num_rows == 0:
                return _count_table(np.empty(0, np.int64), np.empty(0, np.int64), True)
            ia, ib = ids_of(a["id"]), ids_of(b["id"])
            i2t, t2i = block_better(
                unit_rows(a["v"]), ia, a["p"].to_numpy(), unit_rows(b["v"]), ib, b["p"].to_numpy()
            )
            return pa.concat_tables([_count_table(ia, i2t, True), _count_table(ib, t2i, False)])

        partial = (
            left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(cell, COUNT_SCHEMA)
        )
    return partial.groupBy("id").agg(F.sum("i2t").alias("i2t"), F.sum("t2i").alias("t2i"))


def _count_table(ids: np.ndarray, counts: np.ndarray, image_side: bool) -> pa.Table:
    none = np.zeros(len(ids), np.int64)
    first, second = (counts, none) if image_side else (none, counts)
    return pa.table({"id": pa.array(ids), "i2t": pa.array(first), "t2i": pa.array(second)})


def _better_resident(left: DataFrame, right: DataFrame) -> DataFrame:
    table = right.toArrow()
    if table.num_rows == 0:
        return left.sparkSession.createDataFrame([], COUNT_SCHEMA)
    held = left.sparkSession.sparkContext.broadcast(
        (ids_of(table["id"]), table["p"].to_numpy(), unit_rows(table["v"]))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t_ids, t_pos, t = held.value
        t2i = np.zeros(len(t_ids), np.int64)
        for batch in batches:
            ids = ids_of(batch["id"])
            i2t, more = block_better(
                unit_rows(batch["v"]), ids, batch["p"].to_numpy(), t, t_ids, t_pos
            )
            t2i += more
            yield from _count_table(ids, i2t, True).to_batches()
        yield from _count_table(t_ids, t2i, False).to_batches()

    return left.mapInArrow(scan, COUNT_SCHEMA)


def block_sums(
    paired: DataFrame,
    group: str,
    kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], float],
    lane_rows: int = 4096,
) -> DataFrame:
    """``group, total, n_pairs``: a kernel summed over all pairs inside each group.

    ``paired`` is ``(group, id, iv, tv)``. A group larger than ``lane_rows`` is cut into
    lanes, so that no task holds more than two lanes of it.
    """
    sizes = paired.groupBy(group).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(lane_rows)).cast("int").alias("__lanes")
    )
    sized = paired.join(sizes, group).withColumn(
        "__lane", F.pmod(F.xxhash64("id"), F.col("__lanes").cast("bigint")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("__lanes") - 1))
    left = sized.select(group, "id", F.col("iv").alias("v"), F.col("__lane").alias("row"), every.alias("col"))
    right = fresh(sized).select(group, "id", F.col("tv").alias("v"), every.alias("row"), F.col("__lane").alias("col"))
    keys = [group, "row", "col"]
    group_type = paired.schema[group].dataType.simpleString()

    def cell(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        ia, ib = ids_of(a["id"]), ids_of(b["id"])
        total = 0.0
        if len(ia) and len(ib):
            va, vb = unit_rows(a["v"]), unit_rows(b["v"])
            for x in tiles(len(ia)):
                for y in tiles(len(ib)):
                    total += kernel(va[x], ia[x], vb[y], ib[y])
        return pa.table({group: [key[0].as_py()], "total": [total], "n_pairs": [len(ia) * len(ib)]})

    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        cell, f"{group} {group_type}, total double, n_pairs bigint"
    )
    return partial.groupBy(group).agg(F.sum("total").alias("total"), F.sum("n_pairs").alias("n_pairs"))
