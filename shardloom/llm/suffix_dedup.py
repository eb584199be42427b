"""Removal of every byte inside a 100-byte string that also starts earlier in the corpus.

No task sees the corpus whole, so the work is cut by content:

1. An anchor is a 50-byte string with the smallest hash in some window of 100 bytes. Every 100-byte string has one,
   and equal strings have it at the same place. An anchor's context is all 100-byte strings around it.
2. Of equal contexts only the earliest counts on; all strings of the others start earlier elsewhere. Equal
   contexts inside a task go before the exchange, so a group of copies sends one row per task and anchor.
3. Anchors with several contexts are left. An anchor with too many is refined: the strings that start in one range
   before it share more bytes than it has, so the anchor and those bytes are a longer one, with contexts of its own.
4. Contexts gather at the place where the anchor was first seen, so neighbours come together again, and overlapping
   ones of a document are one segment. A place with too much text is cut between anchors, never through one, so equal
   strings are always in one cut.
5. Stretches of the segments in which no string can have an equal are left out by hash, and of equal stretches only the
   earliest counts on. A suffix array over the rest, by linear grouping, brings equal 100-byte strings together. All
   but the earliest of each are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.llm.common import utf8
from shardloom.llm.shingles import mix, powers
from shardloom.llm.suffix_array import equal_prefixes, suffix_array
from shardloom.session import broadcast_if_small, materialize

LENGTH, ANCHOR = 100, 50
# Bytes of a first-seen place, of the segments that one task step takes, and of contexts in a cut or at an anchor.
PLACE_BYTES, ARRAY_BYTES, CUT_BYTES = 1 << 14, 1 << 19, 1 << 19
TASK_BYTES = 4 << 20
# Ranges of starts that a crowded anchor is refined into at a time, and rounds of narrowing before a suffix array.
RANGES, ROUNDS = 4, 3
BROADCAST_IDS = 1_000_000

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_ROW = "key long, context long, doc long, at int, left int, right int, spans array<int>"


def _sliding(a: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours, from running ones forward and back in blocks."""
    n = len(a) - width + 1
    blocks = np.full(-(-len(a) // width) * width, a[-1], a.dtype)
    blocks[: len(a)] = a
    blocks = blocks.reshape(-1, width)
    ahead = least.accumulate(blocks, axis=1).ravel()
    back = least.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(back[:n], ahead[width - 1 : width - 1 + n])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers. Those that most texts need are kept."""
    if n > 1 << 16:
        return powers(base, n)
    if base not in _POWERS:
        _POWERS[base] = powers(base, 1 << 16)
    return _POWERS[base][:n]


class _Hashes:
    """Hashes of any stretch of a text, from running sums."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        self.back = _powers(_BACK, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, n), out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def anchors(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Place, hash, context hash, and the context's bytes before and after the place, of each anchor."""
    if len(text) < length:
        empty = np.empty(0, np.int64)
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    hashes = _Hashes(np.frombuffer(text, np.uint8))
    starts = np.arange(len(text) - anchor + 1)
    values = hashes.of(starts, starts + anchor)
    width = length - anchor + 1
    least = _sliding(values, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    # A place is an anchor if it is the smallest of some window, that is of the window with the largest minimum.
    at = np.flatnonzero(values == _sliding(np.r_[edge, least, edge], width, np.maximum))
    left = np.minimum(at, length - anchor)
    right = np.minimum(len(text) - at, length)
    context = mix(hashes.of(at - left, at + right) + left.astype(np.uint64))
    return at, values[at], context, left, right


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pairs(flat: list[int]) -> list[tuple[int, int]]:
    return list(zip(flat[::2], flat[1::2]))


def _found_anchors(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """Earliest contexts of each task's batches, and the spans that equal contexts in a batch settle at once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = np.asarray(batch.column("doc"), np.int64), batch.column("bytes").to_pylist()
            order = np.argsort(ids, kind="stable")
            found = [anchors(texts[i], length, anchor) for i in order.tolist()]
            at, key, context, left, right = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 5
            doc = np.repeat(ids[order], [len(f[0]) for f in found])
            # Rows are in order of document and place, so the first of equal ones is the earliest.
            by = np.lexsort((context, key))
            k, c = key[by], context[by]
            first = np.r_[np.ones(min(len(k), 1), bool), (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
            keep = np.sort(by[first])
            yield pa.RecordBatch.from_arrays([
                pa.array(key[keep].view(np.int64)), pa.array(context[keep].view(np.int64)), pa.array(doc[keep]),
                pa.array(at[keep].astype(np.int32)), pa.array(left[keep].astype(np.int32)),
                pa.array(right[keep].astype(np.int32)), pa.nulls(len(keep), pa.list_(pa.int32())),
            ], names=["key", "context", "doc", "at", "left", "right", "spans"])
            settled: dict[int, list[tuple[int, int]]] = {}
            later = by[~first]
            later = later[left[later] + right[later] >= length]
            for d, a, b in zip(doc[later].tolist(), (at - left)[later].tolist(), (at + right)[later].tolist()):
                settled.setdefault(d, []).append((a, b))
            yield _settled(settled)

    return docs.mapInArrow(scan, _ROW)


def _settled(spans: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
    n = len(spans)
    docs = np.array(list(spans), np.int64)
    flat = [[x for span in _joined(s) for x in span] for s in spans.values()]
    none = pa.nulls(n, pa.int32())
    return pa.RecordBatch.from_arrays([
        pa.array(mix(docs.view(np.uint64)).view(np.int64)), pa.nulls(n, pa.int64()), pa.array(docs), none, none, none,
        pa.array(flat, pa.list_(pa.int32())),
    ], names=["key", "context", "doc", "at", "left", "right", "spans"])


def _told_apart(rows: DataFrame, length: int) -> DataFrame:
    """Settle equal contexts of each anchor; pass on the earliest of each where an anchor has several.

    Rows come sorted by anchor, context, document and place, and nothing but one row is held from batch to batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("key", "context", "doc", "at", "left", "right")
        last: dict | None = None  # the row before
        held: dict | None = None  # an anchor's first context, until a second one is seen
        for batch in batches:
            spans = batch.filter(pc.is_valid(batch.column("spans")))
            if spans.num_rows:
                yield spans
            batch = batch.filter(pc.is_null(batch.column("spans")))
            if not batch.num_rows:
                continue
            row = {k: np.asarray(batch.column(k), np.int64) for k in columns}
            before = {k: np.r_[last[k] if last else row[k][:1], row[k][:-1]] for k in ("key", "context")}
            same_key = row["key"] == before["key"]
            same = same_key & (row["context"] == before["context"])
            if last is None:
                same_key[0] = same[0] = False
            last = {k: row[k][-1:] for k in columns}
            settled: dict[int, list[tuple[int, int]]] = {}
            done = np.flatnonzero(same & (row["left"] + row["right"] >= length))
            for d, a, b in zip(row["doc"][done].tolist(), (row["at"] - row["left"])[done].tolist(),
                               (row["at"] + row["right"])[done].tolist()):
                settled.setdefault(d, []).append((a, b))
            if settled:
                yield _settled(settled)
            first = {k: v[~same] for k, v in row.items()}
            if held is not None:
                first = {k: np.r_[held[k], v] for k, v in first.items()}
            n = len(first["key"])
            if not n:
                continue
            alike = first["key"][1:] == first["key"][:-1]
            several = np.r_[False, alike] | np.r_[alike, False]
            # The last one is held, with a mark if it is known to be one of several.
            if held is not None and held["sent"][0]:
                several[0] = False
            out = np.flatnonzero(several)
            if len(out):
                yield pa.RecordBatch.from_arrays([
                    pa.array(first[k][out]) if k in ("key", "context", "doc") else pa.array(first[k][out].astype(np.int32))
                    for k in columns
                ] + [pa.nulls(len(out), pa.list_(pa.int32()))], names=[*columns, "spans"])
            sent = bool(several[-1]) or (n == 1 and held is not None and bool(held["sent"][0]))
            held = {k: first[k][-1:] for k in columns} | {"sent": np.array([sent])}

    ordered = rows.repartition("key").sortWithinPartitions("key", "context", "doc", "at")
    return ordered.mapInArrow(scan, _ROW)


def _keys(several: DataFrame) -> DataFrame:
    """``key, first, bytes``: where each anchor is seen first, and the bytes of its contexts."""
    return materialize(several.groupBy("key").agg(
        F.min(F.struct("doc", "at")).alias("first"), F.sum(F.col("left") + F.col("right")).alias("bytes")
    ), "keys")


def _refined(docs: DataFrame, several: DataFrame, length: int, anchor: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Contexts and keys without crowded anchors, and the spans that were settled on the way.

    A crowded anchor's strings are told apart by ranges of their starts: all that start in one have the same bytes
    from the range's end up to its first string's end, or are not equal. Ranges shrink to one start, where equal
    contexts are equal strings and nothing is left.
    """
    keys = _keys(several)
    kept, known, settled = [], [], []
    parts = None
    width = length - anchor + 1
    while width > 1 and not keys.filter(F.col("bytes") > CUT_BYTES).isEmpty():
        crowded = broadcast_if_small(keys.filter(F.col("bytes") > CUT_BYTES).select("key"), BROADCAST_IDS)
        kept.append(several.join(crowded, "key", "left_anti"))
        known.append(keys.filter(F.col("bytes") <= CUT_BYTES))
        some = several.join(crowded, "key", "left_semi")
        if parts is None:
            origin = F.col("at") - (length - anchor)
            ids = broadcast_if_small(some.select("doc").distinct(), BROADCAST_IDS)
            texts = docs.join(ids, "doc", "left_semi").join(some, "doc").select(
                "key", "doc", origin.alias("origin"), (F.col("at") - F.col("left")).alias("a"),
                F.expr("substring(bytes, at - left + 1, left + right)").alias("bytes"),
            )
        else:
            texts = parts.join(some.select("key", "context", "doc", "at"), ["key", "context", "doc", "at"], "left_semi")
        width = -(-width // RANGES)
        parts = materialize(_ranges(texts, length, width), "ranges")
        told = materialize(_told_apart(parts.select(
            "key", "context", "doc", "at", "left", "right", F.lit(None).cast("array<int>").alias("spans")
        ), length), "refined")
        settled.append(told.filter("spans IS NOT NULL").select("doc", "spans"))
        several = told.filter("spans IS NULL").drop("spans")
        keys = _keys(several)
    for rows, of in zip(kept, known):
        several, keys = several.unionByName(rows), keys.unionByName(of)
    return several, keys, settled


def _ranges(texts: DataFrame, length: int, width: int) -> DataFrame:
    """Each context as one for every range of ``width`` starts, counted from ``origin``. ``a`` is where it starts."""
    first, last = "a - origin", f"a - origin + octet_length(bytes) - {length}"
    ranges = texts.withColumn("range", F.explode(F.expr(f"sequence(({first}) div {width}, ({last}) div {width})")))
    cut = ranges.select(
        "key", "doc", "origin", "range", F.col("a").alias("was"), "bytes",
        F.expr(f"cast(origin + greatest({first}, range * {width}) AS int)").alias("a"),
        F.expr(f"cast(origin + least({last}, range * {width} + {width - 1}) + {length} AS int)").alias("b"),
        F.expr(f"cast(origin + range * {width} + {width - 1} AS int)").alias("at"),
    )
    shared = F.expr(f"substring(bytes, at - was + 1, {length - width + 1})")
    context = F.expr("substring(bytes, a - was + 1, b - a)")
    return cut.select(
        F.xxhash64("key", "range", shared).alias("key"), F.xxhash64(F.col("a") - F.col("origin"), context).alias("context"),
        "doc", "at", (F.col("at") - F.col("a")).alias("left"), (F.col("b") - F.col("at")).alias("right"),
        "origin", "a", context.alias("bytes"),
    )


def _segments(docs: DataFrame, several: DataFrame, keys: DataFrame) -> DataFrame:
    """``place, doc, start, bytes``: contexts of a place in a document, overlapping ones as one segment.

    Crowded places are cut between anchors. Equal strings have their anchor in common, so none are parted.
    """
    slot = F.floor(F.col("first.at") / PLACE_BYTES)
    before = Window.partitionBy("doc", "slot").orderBy("at", "key").rowsBetween(Window.unboundedPreceding, 0)
    homes = keys.select("key", "bytes", F.col("first.doc").alias("doc"), slot.alias("slot"), F.col("first.at").alias("at")).select(
        "key", F.xxhash64("doc", "slot", F.floor(F.sum("bytes").over(before) / CUT_BYTES)).alias("place")
    )
    placed = several.join(materialize(homes, "homes"), "key")
    per_doc = materialize(placed.groupBy("doc").agg(
        F.collect_list(F.struct("place", (F.col("at") - F.col("left")).alias("a"), (F.col("at") + F.col("right")).alias("b")))
        .alias("contexts")
    ), "contexts")
    ids = broadcast_if_small(per_doc.select("doc"), BROADCAST_IDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, contexts in zip(*(batch.column(k).to_pylist() for k in ("doc", "bytes", "contexts"))):
                by_place: dict[int, list[tuple[int, int]]] = {}
                for c in contexts:
                    by_place.setdefault(c["place"], []).append((c["a"], c["b"]))
                out += [(p, doc, a, text[a:b]) for p, spans in by_place.items() for a, b in _joined(spans)]
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, *_ in out], pa.int64()), pa.array([d for _, d, *_ in out], pa.int64()),
                pa.array([a for *_, a, _ in out], pa.int32()), pa.array([t for *_, t in out], pa.binary()),
            ], names=["place", "doc", "start", "bytes"])

    texts = docs.join(ids, "doc", "left_semi").join(per_doc, "doc").select("doc", "bytes", "contexts")
    return materialize(texts.mapInArrow(cut, "place long, doc long, start int, bytes binary"), "segments")


def _sorted_strings(segments: DataFrame, length: int) -> DataFrame:
    """``doc, spans`` of the later ones of equal strings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        place, size = None, 0
        for batch in batches:
            for of, *row in zip(*(batch.column(k).to_pylist() for k in ("place", "doc", "start", "bytes"))):
                # Places may share an array: their strings are equal or not all the same.
                if of != place and size >= ARRAY_BYTES:
                    yield _repeats(rows, length)
                    rows, size = [], 0
                rows.append(tuple(row))
                place = of
                size += len(row[-1])
        if rows:
            yield _repeats(rows, length)

    # Arrays cost far more than their bytes suggest to adaptive execution, so the number of tasks is set.
    total = segments.agg(F.sum(F.length("bytes"))).first()[0] or 0
    least = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = segments.repartition(max(least, -(-total // TASK_BYTES)), "place").sortWithinPartitions("place", "doc", "start")
    return dealt.select("place", "doc", "start", "bytes").mapInArrow(scan, "doc long, spans array<int>")


def _narrowed(rows: list[tuple], length: int, settled: dict[int, list[tuple[int, int]]]) -> list[tuple]:
    """Stretches of strings whose hash is there twice, the earliest of equal ones; the others are settled."""
    text = b"".join(r[-1] for r in rows)
    ends = np.cumsum([len(r[-1]) for r in rows])
    begins = np.r_[0, ends[:-1]]
    offset = np.array([r[1] for r in rows], np.int64) - begins
    last = np.repeat(ends - length, ends - begins)
    starts = np.flatnonzero(np.arange(len(text)) <= last)
    values = _Hashes(np.frombuffer(text, np.uint8)).of(starts, starts + length)
    order = np.argsort(values)
    same = values[order[1:]] == values[order[:-1]]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    starts = starts[twice]
    of = np.searchsorted(ends, starts, side="right")
    new = np.flatnonzero((starts[1:] != starts[:-1] + 1) | (of[1:] != of[:-1])) + 1
    heads, tails = (np.r_[0, new], np.r_[new - 1, len(starts) - 1]) if len(starts) else (new, new)
    first: dict[bytes, tuple[int, int]] = {}
    for i, a, b, shift in zip(of[heads].tolist(), starts[heads].tolist(), (starts[tails] + length).tolist(), offset[of[heads]].tolist()):
        part, here = text[a:b], (rows[i][0], a + shift)
        known = first.setdefault(part, here)
        # A string may be there twice, by two places; it does not start earlier than itself.
        if known != here:
            first[part], (doc, start) = min(known, here), max(known, here)
            settled.setdefault(doc, []).append((start, start + b - a))
    return [(doc, start, part) for part, (doc, start) in first.items()]


def _repeats(rows: list[tuple], length: int) -> pa.RecordBatch:
    """``doc, spans`` of the later ones of equal strings in ``doc, start, bytes``."""
    settled: dict[int, list[tuple[int, int]]] = {}
    for _ in range(ROUNDS):
        rows = _narrowed(rows, length, settled) if rows else rows
    for doc, start in _later(rows, length) if rows else ():
        settled.setdefault(doc, []).append((start, start + length))
    return pa.RecordBatch.from_arrays([
        pa.array(list(settled), pa.int64()),
        pa.array([[x for span in _joined(s) for x in span] for s in settled.values()], pa.list_(pa.int32())),
    ], names=["doc", "spans"])


def _later(rows: list[tuple], length: int) -> Iterator[tuple[int, int]]:
    """Document and start of all but the earliest of equal strings, from a suffix array."""
    lengths = np.array([len(r[-1]) for r in rows], np.int64)
    text = np.frombuffer(b"\0".join(r[-1] for r in rows) + b"\0", np.uint8)
    ends = np.cumsum(lengths + 1) - 1
    # Between segments stand symbols of their own, below all bytes.
    symbols = text.astype(np.int64) + len(rows)
    symbols[ends] = np.arange(len(rows))
    order = suffix_array(symbols)
    of = np.searchsorted(ends, order)
    same = equal_prefixes(text, order, length)
    whole = order + length <= ends[of]
    fits = np.r_[False, whole[:-1]] & whole & same
    group = np.cumsum(~fits)
    keep = np.flatnonzero(whole)
    order, of, group = order[keep], of[keep], group[keep]
    doc = np.array([r[0] for r in rows], np.int64)[of]
    start = np.array([r[1] for r in rows], np.int64)[of] + order - (ends - lengths)[of]
    by = np.lexsort((start, doc, group))
    g, doc, start = group[by], doc[by], start[by]
    first = np.r_[np.ones(min(len(g), 1), bool), g[1:] != g[:-1]]
    # A string may be there twice, by two places; it does not start earlier than itself.
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    repeat = (doc != doc[head]) | (start != start[head])
    return zip(doc[repeat].tolist(), start[repeat].tolist())


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc, spans``: per document the byte spans that repeat something earlier, as flat starts and ends.

    ``docs`` has ``doc`` (distinct) and ``bytes``. Spans may overlap; documents without any are left out.
    """
    rows = materialize(_told_apart(_found_anchors(docs, length, anchor), length), "anchors")
    found = rows.filter("spans IS NOT NULL").select("doc", "spans")
    several, keys, settled = _refined(docs, rows.filter("spans IS NULL").drop("spans"), length, anchor)
    for spans in [*settled, _sorted_strings(_segments(docs, several, keys), length)]:
        found = found.unionByName(spans)
    return found.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``spans`` of every row of ``docs`` (``doc_id, text``).

    Texts are UTF-8 bytes, a null one is empty. A byte goes if a ``length``-byte string over it also starts at a smaller
    document, or earlier in the same one; overlaps count. ``spans`` are the maximal removed runs, flat. Rows that
    repeat an id count as documents of their own, in order of their texts, equal rows as one; rows without id
    come before all others.
    """
    rows = docs.select("doc_id", utf8().alias("bytes"))
    ids = rows.select("doc_id", F.sha2("bytes", 256).alias("text"))
    per_id = ids.groupBy("doc_id").agg((F.min("text") != F.max("text")).alias("differs"))
    if per_id.filter("differs OR doc_id IS NULL").isEmpty():
        numbered = rows.withColumn("doc", F.col("doc_id").cast("long"))
    else:
        numbered = _numbered(rows, ids)
    # Equal rows of one id are one document.
    once = numbered.select("doc", "bytes")
    if not ids.groupBy("doc_id", "text").count().filter("count > 1").isEmpty():
        once = materialize(once.groupBy("doc").agg(F.first("bytes").alias("bytes")), "documents")
    spans = materialize(repeated_spans(once, length, anchor), "spans")
    touched = numbered.join(broadcast_if_small(spans.select("doc"), BROADCAST_IDS), "doc", "left_semi").join(spans, "doc")
    result = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, flat in zip(batch.column("bytes").to_pylist(), batch.column("spans").to_pylist()):
                runs = _joined(_pairs(flat))
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out.append((len(text), sum(b - a for a, b in runs), runs, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([n for n, *_ in out], pa.int64()),
                pa.array([r for _, r, *_ in out], pa.int64()), pa.array([len(s) for *_, s, _ in out], pa.int64()),
                pa.array([h for *_, h in out], pa.string()),
                pa.array([[x for run in s for x in run] for *_, s, _ in out], pa.list_(pa.int32())),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    zero = F.lit(0).cast("long")
    clean = numbered.join(broadcast_if_small(spans.select("doc"), BROADCAST_IDS), "doc", "left_anti").select(
        "doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
        F.sha2("bytes", 256).alias("kept_sha256"), F.array().cast("array<int>").alias("spans"),
    )
    return touched.select("doc_id", "bytes", "spans").mapInArrow(cut, result).unionByName(clean)


def _numbered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Row numbers in order of id and text as document numbers, where ids alone do not tell documents apart."""
    order = ids.distinct().orderBy(F.asc_nulls_first("doc_id"), "text")
    parts = materialize(order.withColumn("part", F.spark_partition_id()).withColumn(
        "in_part", F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), "text"))
    ), "numbers")
    # One row for each sorted part.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    numbers = parts.join(offsets, "part").select(
        F.col("doc_id").alias("id"), "text", (F.col("before") + F.col("in_part")).cast("long").alias("doc")
    )
    keyed = rows.withColumn("text", F.sha2("bytes", 256))
    return keyed.join(
        numbers.withColumnRenamed("text", "other"),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text") == F.col("other")),
    ).select("doc_id", "bytes", "doc")
