"""One JSON array in one file, read by many tasks.

A file is cut into byte ranges. A first pass over them finds, for both cases, that a range begins inside a string or
outside, how it moves the nesting depth and how many elements begin in it. Running sums over one small row per range settle
which case holds, and which element is the first to begin there. A second pass cuts the elements: one belongs to the range in which the bracket or comma
before it lies, and its task reads on past the range until the element ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.session import materialize
from shardloom.sources.tar import locate, spread_count

RANGE_BYTES = 16 << 20
# Bytes read at once past a range, and at once backwards before one.
ON_BYTES, BACK_BYTES = 1 << 20, 4096
# Rows and bytes of elements that leave a task together.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20

_QUOTE, _BACKSLASH, _COMMA, _OPEN, _CLOSE = 0x22, 0x5C, 0x2C, 0x5B, 0x5D
# What a byte outside strings does to the depth; commas are marks too.
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]], _STEP[[0x5D, 0x7D]] = 1, -1
_MARK = _STEP != 0
_MARK[_COMMA] = True


class Malformed(ValueError):
    def __init__(self, url: str, what: str):
        super().__init__(f"malformed JSON array in {url}: {what}")


def _trailing(data: np.ndarray, before: int) -> int:
    """Backslashes at the end, ``before`` of them before the data."""
    other = np.flatnonzero(data[::-1] != _BACKSLASH)
    return int(other[0]) if len(other) else len(data) + before


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Places of the quotes that begin or end a string: an even number of backslashes stands before them."""
    places, slashes = np.flatnonzero(data == _QUOTE), np.flatnonzero(data == _BACKSLASH)
    ends = slashes[np.flatnonzero(np.diff(slashes, append=len(data) + 1) > 1)]
    begins = slashes[np.flatnonzero(np.diff(slashes, prepend=-2) > 1)]
    runs = ends - begins + 1 + np.where(begins == 0, before, 0)
    found = np.searchsorted(ends, places - 1)
    at = np.minimum(found, max(len(ends) - 1, 0))
    count = np.where(ends[at] == places - 1, runs[at], 0) if len(ends) else np.zeros(len(places), np.int64)
    count = np.where(places == 0, before, count)
    return places[count % 2 == 0]


@dataclass
class _Marks:
    """Brackets and commas outside strings, the depth behind each, and the state behind the data."""

    places: np.ndarray
    kinds: np.ndarray
    depths: np.ndarray
    inside: int
    depth: int
    slashes: int

    def begins(self, depth: int) -> np.ndarray:
        """Whether an element of an array at ``depth`` begins behind the mark."""
        return (self.depths == depth) & ((self.kinds == _COMMA) | (_STEP[self.kinds] > 0))

    def ends(self) -> np.ndarray:
        """Whether the top array's element, or the array itself, ends at the mark."""
        return (self.depths == 1) & (self.kinds == _COMMA) | (self.depths == 0)


def _marks(data: np.ndarray, slashes: int, inside: int, depth: int, quotes: np.ndarray | None = None) -> _Marks:
    quotes = _quotes(data, slashes) if quotes is None else quotes
    places = np.flatnonzero(_MARK[data])
    places = places[(np.searchsorted(quotes, places) + inside) % 2 == 0]
    kinds = data[places]
    depths = depth + np.cumsum(_STEP[kinds], dtype=np.int64)
    return _Marks(
        places, kinds, depths, (inside + len(quotes)) % 2, int(depths[-1]) if len(depths) else depth, _trailing(data, slashes)
    )


def _slashes_before(file: pa.NativeFile, start: int) -> int:
    found = 0
    while start > 0:
        low = max(0, start - BACK_BYTES)
        data = np.frombuffer(file.read_at(start - low, low), np.uint8)
        n = _trailing(data, 0)
        found += n
        if n < len(data):
            break
        start = low
    return found


def _ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    cuts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint")))
    return files.select("url", "length", cuts.alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, "length"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: parity of its quotes; by the state it begins in, its step in depth and its elements by depth."""
    schema = pa.schema([
        ("url", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("quotes", pa.int64()),
        ("outer", pa.int64()), ("inner", pa.int64()), ("outer_n", pa.map_(pa.int64(), pa.int64())), ("inner_n", pa.map_(pa.int64(), pa.int64())),
    ])
    for row in _rows(batches):
        store, path = locate(row["url"])
        with store.open_input_file(path) as file:
            data = np.frombuffer(file.read_at(row["end"] - row["start"], row["start"]), np.uint8)
            before = _slashes_before(file, row["start"])
        quotes = _quotes(data, before)
        out = {"quotes": len(quotes) % 2}
        for inside, name in enumerate(("outer", "inner")):
            marks = _marks(data, before, inside, 0, quotes)
            begun = marks.depths[(marks.kinds == _COMMA) | (_STEP[marks.kinds] > 0)]
            out |= {name: marks.depth, f"{name}_n": [(int(d), int(n)) for d, n in zip(*np.unique(begun, return_counts=True))]}
        yield pa.RecordBatch.from_pylist([row | out], schema)


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, int, str]] = []
    size = 0

    def out() -> pa.RecordBatch:
        urls, ids, texts = zip(*held) if held else ((), (), ())
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(urls, pa.string()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["url", "id", "json"]
        )

    for row in _rows(batches):
        store, path = locate(row["url"])
        with store.open_input_file(path) as file:
            for number, text in _cut(row, file):
                held.append((row["url"], number, text))
                size += len(text)
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield out()
                    size = 0
    yield out()


def _cut(row: dict, file: pa.NativeFile) -> Iterator[tuple[int, str]]:
    """Number and text of each element that begins in a range."""
    url, start, end = row["url"], row["start"], row["end"]
    raw = file.read_at(end - start, start)
    data = np.frombuffer(raw, np.uint8)
    marks = _marks(data, _slashes_before(file, start), row["inside"], row["depth"])
    _check(row, raw, marks)
    begins, ends = marks.begins(1), marks.ends()
    stops = marks.places[ends]
    for k, i in enumerate(np.flatnonzero(begins)):
        at = int(marks.places[i])
        j = int(np.searchsorted(stops, at, "right"))
        if j < len(stops):
            text, last = raw[at + 1 : stops[j]], data[stops[j]]
        else:
            text, last = _read_on(row, file, raw[at + 1 :], marks)
        if text.strip(b" \t\r\n"):
            yield row["first"] + k, text.decode("utf-8", "replace")
        elif marks.kinds[i] == _COMMA or last == _COMMA:
            raise Malformed(url, f"no element at {start + at}")


def _read_on(row: dict, file: pa.NativeFile, text: bytes, marks: _Marks) -> tuple[bytes, int]:
    """The rest of the element that a range ends in, and the byte that ends it."""
    parts, at = [text], row["end"]
    while at < row["length"]:
        raw = file.read_at(min(ON_BYTES, row["length"] - at), at)
        marks = _marks(np.frombuffer(raw, np.uint8), marks.slashes, marks.inside, marks.depth)
        stops = marks.places[marks.ends()]
        if len(stops):
            return b"".join([*parts, raw[: stops[0]]]), raw[stops[0]]
        parts.append(raw)
        at += len(raw)
    raise Malformed(row["url"], "it does not end")


def _check(row: dict, raw: bytes, marks: _Marks) -> None:
    """Only one array, and nothing but blanks around it."""
    url, edge = row["url"], row["start"]
    opened = row["first"] > 0
    blank_from = 0 if row["depth"] == 0 else None
    if row["depth"] < 0 or (marks.depths < 0).any():
        raise Malformed(url, f"a bracket too many after {edge}")
    for i in np.flatnonzero((marks.depths == 0) | (marks.depths == 1) & (_STEP[marks.kinds] > 0)):
        place, kind = int(marks.places[i]), marks.kinds[i]
        if blank_from is not None:
            if kind != _OPEN or opened or raw[blank_from:place].strip(b" \t\r\n"):
                raise Malformed(url, f"no array at {edge + place}")
            opened, blank_from = True, None
        elif kind == _CLOSE:
            blank_from = place + 1
        elif marks.depths[i] == 0:
            raise Malformed(url, f"the array ends otherwise at {edge + place}")
    if blank_from is not None and raw[blank_from:].strip(b" \t\r\n"):
        raise Malformed(url, f"more than an array at {edge + blank_from}")
    if row["end"] == row["length"] and (marks.inside or marks.depth or not opened):
        raise Malformed(url, "it does not end")


def array_elements(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``url, id, json``: the JSON text of each element of the array in each file at ``path``, numbered from 0 by file."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "length")
    ranges = materialize(_ranges(files, range_bytes), "ranges")
    tasks = spread_count(spark, ranges.count())
    kinds = (
        "url string, length bigint, start bigint, end bigint, quotes bigint, outer bigint, inner bigint, "
        "outer_n map<bigint,bigint>, inner_n map<bigint,bigint>"
    )
    # Dealt by their own place, so that a task that runs again finds the same ranges.
    found = materialize(ranges.repartition(tasks, "url", "start").mapInArrow(_summaries, kinds), "range-marks")
    before = Window.partitionBy("url").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)

    def so_far(c: Column) -> Column:
        return F.coalesce(F.sum(c).over(before), F.lit(0))

    placed = found.withColumn("inside", so_far(F.col("quotes")) % 2)
    placed = placed.withColumn("depth", so_far(F.when(F.col("inside") == 0, F.col("outer")).otherwise(F.col("inner"))))
    begun = F.try_element_at(F.when(F.col("inside") == 0, F.col("outer_n")).otherwise(F.col("inner_n")), 1 - F.col("depth"))
    placed = placed.withColumn("first", so_far(F.coalesce(begun, F.lit(0))))
    placed = placed.select("url", "length", "start", "end", "inside", "depth", "first")
    return placed.repartition(tasks, "url", "start").mapInArrow(_elements, "url string, id bigint, json string")
