"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Every window of 13 consecutive words of a test item is a pattern; an item with fewer words is one pattern. Patterns
and documents are normalised alike: A-Z lower-cased, words of letters, digits and characters beyond ASCII,
one blank between words. A text is scanned once. Matches are mapped back to words and to byte offsets of the text
as it was.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm.common import PLAIN_WORDS, gives_back, utf8
from shardloom.session import materialize

WINDOW = 13
# Pattern bytes of one automaton. More patterns are scanned part by part, each broadcast by itself.
PATTERN_BYTES = 16 << 20

_BUILT: dict[str, ahocorasick.Automaton] = {}


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pattern, item_ids``: distinct windows, with the sorted ids of the items that hold each.

    Items with null text, or without words, have no window. Windows of an item without id count like any other; they
    name no item.
    """

    @gives_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, ids = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("bytes").to_pylist()):
                words = text.translate(PLAIN_WORDS).split()
                if words:
                    n = max(len(words) - window, 0) + 1
                    patterns += [b" ".join(words[i : i + window]) for i in range(n)]
                    ids += [item] * n
            yield pa.RecordBatch.from_arrays(
                [pa.array(patterns, pa.binary()), pa.array(ids, pa.string())], names=["pattern", "item"]
            )

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), utf8().alias("bytes"))
    return (
        items.mapInArrow(cut, "pattern binary, item string").distinct()
        .groupBy("pattern").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    )


def _automaton(key: str, shared: Broadcast) -> ahocorasick.Automaton:
    """The automaton of a broadcast part, built once in each worker process, which holds one at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for pattern, items in shared.value:
            # Each byte stands as one character, so the automaton works on bytes.
            framed = f" {pattern.decode('latin-1')} "
            built.add_word(framed, (len(framed), pattern.count(b" ") + 1, items))
        if len(built):
            built.make_automaton()
        _BUILT[key] = built
    return _BUILT[key]


def _matches(text: bytes, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged runs of hit words, and the items found."""
    words = text.translate(PLAIN_WORDS).split()
    if not words or not len(automaton):
        return len(words), [], set()
    plain = f" {b' '.join(words).decode('latin-1')} "
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    blanks = None
    for end, (length, count, found) in automaton.iter(plain):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 0x20)
        first = int(np.searchsorted(blanks, end + 1 - length))
        items.update(found)
        runs.append((first, first + count))
    return len(words), merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _offsets(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as byte offsets of the text; normalising moves no byte before words are split."""
    if not runs:
        return []
    inside = np.frombuffer(text.translate(PLAIN_WORDS), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return [{"start": int(edges[2 * a]), "end": int(edges[2 * b - 1])} for a, b in runs]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = (),
    pattern_bytes: int = PATTERN_BYTES,
) -> DataFrame:
    """``doc_id``, the columns ``keep``, and what was found in each row's text.

    ``n_words, n_hit`` (words inside any occurrence), ``n_items, items_sha256`` (of the sorted ids, comma-joined),
    ``contaminated`` (``n_hit > 0 and 20 * n_hit >= n_words``) and ``spans`` (byte offsets of hit runs).
    A null or wordless text has no words and no hits. An empty benchmark hits nothing.
    Rows that repeat are judged each by itself.
    """
    patterns = materialize(windows(benchmark, window), "windows")
    total = patterns.agg(F.sum(F.length("pattern") + F.lit(64))).first()[0] or 0
    parts = max(1, -(-total // pattern_bytes))
    rows = docs.select(
        "doc_id", *keep, utf8().alias("__bytes"), F.array().cast("array<int>").alias("__runs"),
        F.array().cast("array<string>").alias("__items"),
    )
    for part in range(parts):
        mine = F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part
        held = [(bytes(r["pattern"]), r["item_ids"]) for r in patterns.filter(mine).toArrow().to_pylist()]
        rows = _scan(rows, docs.sparkSession.sparkContext.broadcast(held), part == parts - 1)
        if part < parts - 1:
            rows = materialize(rows, "scanned")
    return rows


def _scan(rows: DataFrame, shared: Broadcast, last: bool) -> DataFrame:
    """Add one part's matches; the last part works out the results."""
    kept = [f for f in rows.schema.fields if f.name not in ("__runs", "__items", *(["__bytes"] if last else []))]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += (
        ", n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "spans array<struct<start:int,end:int>>" if last else ", __runs array<int>, __items array<string>"
    )

    key = uuid.uuid4().hex

    @gives_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared)
        for batch in batches:
            found = []
            before = zip(batch.column("__runs").to_pylist(), batch.column("__items").to_pylist())
            for text, (flat, items) in zip(batch.column("__bytes").to_pylist(), before):
                n, runs, seen = _matches(text, automaton)
                runs = merged(runs + list(zip(flat[::2], flat[1::2]))) if flat else runs
                found.append((text, n, runs, sorted(seen.union(items))))
            columns = [batch.column(f.name) for f in kept]
            names = [f.name for f in kept]
            if last:
                hits = [sum(b - a for a, b in runs) for _, _, runs, _ in found]
                columns += [
                    pa.array([n for _, n, _, _ in found], pa.int64()), pa.array(hits, pa.int64()),
                    pa.array([len(items) for *_, items in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(items).encode()).hexdigest() for *_, items in found], pa.string()),
                    pa.array([h > 0 and 20 * h >= n for h, (_, n, _, _) in zip(hits, found)], pa.bool_()),
                    pa.array([_offsets(text, runs) for text, _, runs, _ in found],
                             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ]
                names += ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
            else:
                columns += [
                    pa.array([[x for run in runs for x in run] for _, _, runs, _ in found], pa.list_(pa.int32())),
                    pa.array([items for *_, items in found], pa.list_(pa.string())),
                ]
                names += ["__runs", "__items"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(scan, schema)
