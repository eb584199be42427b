"""Ranked lexical search over bags of terms, scoring equal documents once.

Documents are cut down to the terms of the items that are asked for. Documents with the same term counts and the same
length norm score alike for every item: they are grouped by a hash and by the vectors themselves, each class is
scored once, and its members are put in by ascending id. Items are taken in blocks whose terms fit a counted broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import PLAIN_WORDS, utf8
from shardloom.session import materialize

TOP = 10
# Bytes of the items' terms in one block, an item's id and each pair of item and term counted with 64 more.
BLOCK_BYTES = 32 << 20
# Products of a class's term with an item, and cells of classes by items, worked on at once.
_SLICE = 1 << 21


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the distinct terms of each item; rows of one id are one item, and null is an id like others."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(t.as_py().translate(PLAIN_WORDS).split())) for t in batch.column("bytes")]
            rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(rows)), pa.array([x for t in terms for x in t], pa.binary())], names=["item_id", "term"]
            )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", utf8().alias("bytes")).mapInArrow(cut, f"item_id {kind}, term binary").distinct()


def _bags(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """``doc_id, n`` (terms with repeats) and ``ids, tfs``: which of ``terms`` a row holds, in order, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        width = max(len(known), 1)
        for batch in batches:
            lengths, held, found = [], [], []
            for text in batch.column("bytes"):
                words = text.as_py().translate(PLAIN_WORDS).split()
                hits = [known[w] for w in words if w in known]
                lengths.append(len(words))
                held.append(len(hits))
                found += hits
            keys = np.repeat(np.arange(len(lengths)), held) * width + np.array(found, np.int64)
            keys, times = np.unique(keys, return_counts=True)
            ends = np.searchsorted(keys // width, np.arange(len(lengths) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(keys % width, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
                ],
                names=["doc_id", "n", "ids", "tfs"],
            )

    rows = docs.select("doc_id", utf8().alias("bytes"))
    return rows.mapInArrow(count, f"doc_id {kind}, n long, ids array<int>, tfs array<long>")


def bag_classes(bags: DataFrame, top: int = TOP) -> DataFrame:
    """``m, ids, tfs, doc_ids``: each class of rows with the same term counts and ``m``, with its ``top`` smallest ids.

    A class is told by a hash and then by the vectors themselves. Only ``top`` rows of a class leave a task.
    """
    same = ["hash", "m", "ids", "tfs"]
    keyed = bags.select("doc_id", F.xxhash64("m", "ids", "tfs").alias("hash"), "m", "ids", "tfs")
    place = F.row_number().over(Window.partitionBy(*same).orderBy("doc_id"))
    first = keyed.withColumn("place", place).filter(F.col("place") <= top)
    return first.groupBy(*same).agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids")).drop("hash")


def _score(classes: DataFrame, weights: np.ndarray, starts: np.ndarray, items: np.ndarray, n_items: int, top: int) -> DataFrame:
    """``item, score, doc_ids``: of each task's classes the ``top`` best of every item.

    ``items[starts[t]:starts[t + 1]]`` are the items that hold term ``t``. Of equal scores the class with the smaller first id
    goes before; any class behind ``top`` others has as many documents before its own.
    """
    shared = classes.sparkSession.sparkContext.broadcast((weights, starts, items))
    kind = classes.schema["doc_ids"].dataType.simpleString()

    def best(item, score, first, row):
        order = np.lexsort((first, -score, item))
        item, score, first, row = item[order], score[order], first[order], row[order]
        begins = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        keep = np.arange(len(item)) - np.repeat(begins, np.diff(np.r_[begins, len(item)])) < top
        return item[keep], score[keep], first[keep], row[keep]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, start, held_items = shared.value
        bar = np.ones(n_items, np.int64)
        none = np.empty(0, np.int64)
        held, members = (none, none, none, none), []
        for batch in batches:
            size = batch.num_rows
            ids, tfs = batch.column("ids"), batch.column("tfs")
            ends = ids.offsets.to_numpy().astype(np.int64)
            term = ids.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)
            tf = tfs.values.to_numpy()[ends[0] : ends[-1]]
            ends = ends - ends[0]
            m = np.repeat(batch.column("m").to_numpy(), np.diff(ends))
            worth = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            reach = start[term + 1] - start[term]
            work = np.r_[0, np.cumsum(reach)][ends]
            firsts = batch.column("doc_ids").flatten().to_numpy()[batch.column("doc_ids").offsets.to_numpy()[:-1] - batch.column("doc_ids").offsets[0].as_py()]
            a = 0
            while a < size:
                b = min(int(np.searchsorted(work, work[a] + _SLICE, "right")) - 1, a + max(1, _SLICE // n_items), size)
                b = max(b, a + 1)
                span = slice(ends[a], ends[b])
                times = reach[span]
                total = int(times.sum())
                at = np.repeat(start[term[span]] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(total)
                rows = np.repeat(np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), times)
                table = np.zeros((b - a) * n_items, np.int64)
                np.add.at(table, rows * n_items + held_items[at], np.repeat(worth[span], times))
                table = table.reshape(b - a, n_items)
                row, item = np.nonzero(table >= bar)
                if len(row):
                    known = len(members)
                    used, row_at = np.unique(row, return_inverse=True)
                    members += batch.column("doc_ids").take(pa.array(used + a)).to_pylist()
                    new = (item, table[row, item], firsts[row + a], row_at + known)
                    held = best(*(np.concatenate(x) for x in zip(held, new)))
                    full = np.bincount(held[0], minlength=n_items) >= top
                    lowest = np.full(n_items, np.iinfo(np.int64).max)
                    np.minimum.at(lowest, held[0], held[1])
                    bar = np.where(full, lowest, 1)
                    # Members of classes that are no longer held are let go.
                    used, row_at = np.unique(held[3], return_inverse=True)
                    members = [members[i] for i in used]
                    held = (*held[:3], row_at)
                a = b
        yield pa.RecordBatch.from_arrays(
            [pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array([members[i] for i in held[3]], pa.list_(pa.int64()))],
            names=["item", "score", "doc_ids"],
        )

    return classes.mapInArrow(score, f"item long, score long, doc_ids {kind}")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` best documents with a score above 0, ties by ascending id.

    A null text, or one without terms, scores nothing and is not counted. Rows that repeat an id are documents by
    themselves. A row without id counts in the statistics and is never returned. Items of one id are one item; an item
    without terms, and an empty table, gives no rows. Ids of documents are whole numbers.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pairs = materialize(item_terms(items), "terms")
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    size = pairs.agg(F.sum(F.length("term") + F.lit(64))).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = [_search(docs, pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), top) for b in range(blocks)]
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], schema)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _search(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame | None:
    """One block of items: what is held here and sent to the tasks grows with the block's terms alone."""
    spark = docs.sparkSession
    held = pairs.toArrow()
    if not held.num_rows:
        return None
    terms = held.column("term").combine_chunks().dictionary_encode()
    ids = held.column("item_id").combine_chunks().dictionary_encode("encode")
    names = [bytes(t) for t in terms.dictionary.to_pylist()]
    bags = materialize(_bags(docs, {t: i for i, t in enumerate(names)}), "bags")
    total = bags.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["terms"]:
        return None
    holding = dict(bags.select(F.explode("ids").alias("id")).groupBy("id").count().toArrow().to_pandas().itertuples(index=False))
    weights = np.array([
        math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(names))
    ], np.int64)
    by_term = terms.indices.to_numpy().astype(np.int64)
    order = np.argsort(by_term, kind="stable")
    starts = np.searchsorted(by_term[order], np.arange(len(names) + 1))
    norm = F.expr(f"100 - 90 + ((90 * n * {total['docs']}L) div {total['terms']}L)")
    normed = bags.filter("doc_id IS NOT NULL AND size(ids) > 0").withColumn("m", norm)
    classes = bag_classes(normed, top)
    numbers = ids.indices.to_numpy().astype(np.int64)[order]
    scored = _score(classes, weights, starts, numbers, len(ids.dictionary), top)
    first = F.element_at("doc_ids", 1)
    ahead = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), first))
    members = scored.withColumn("place", ahead).filter(F.col("place") <= top).select("item", "score", F.explode("doc_ids").alias("doc_id"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    named = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids.dictionary)), pa.int64()), "item_id": ids.dictionary}))
    ranked = members.withColumn("rank", rank).filter(F.col("rank") <= top)
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")
