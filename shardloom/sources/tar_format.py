"""Tar shards as a data source of Spark: ``spark.read.format("shards")`` and ``df.write.format("shards")``.

    register_shards(spark)
    spark.read.format("shards").schema("key string, json string").load(qualified(spark, folder))
    df.write.format("shards").mode("append").save(qualified(spark, folder))

**Reading.** A path names a folder of ``*.tar`` or one tar, as ``session.qualified`` gives it. A partition is a tar, or a part of a
large one between samples. The schema asked for decides what is opened: ``url, part, offset, key, source`` come from headers; any
other column is the member of that name, as bytes or as text (undecodable bytes dropped), null where a sample lacks it;
without a schema all members come as ``fields``. Members not asked for are passed over by seeking. Filters on ``url``
choose tars before any is opened, and filters on ``key`` choose samples by their headers, before a byte of them is read.
Options: ``split_bytes``, and ``on_error`` (``skip`` keeps what a damaged tar gives before the damage, ``fail`` stops).

**Streaming.** ``spark.readStream.format("shards").option("log", qualified(spark, folder))`` gives every sample of tars that are in the folder
or arrive there. A batch takes about ``batch_bytes``, and may end inside a tar. Each batch's parts of tars are an entry of the log, written before the
batch begins, and an offset counts entries; a stream that is started again goes on behind the last entry. Tars must be
complete when they appear under their name, and a log belongs to one stream. Tars are known by name: one that is put
there again under the name of one that was removed may be read again. Filters are not pushed down.

**Writing.** Each task writes tars of about ``split_bytes`` under a private folder; nothing of it is a tar of the output until the
driver commits, which moves them to ``<prefix>-<partition>-<number>.tar``. An aborted job leaves no tar. Rows are
``key`` and ``fields``, or ``key`` and a column for each member. A key that would not read back, or that
follows itself in a task, is an error. Mode ``append`` adds tars; ``overwrite`` removes the tars there, after the write succeeded.
"""

from __future__ import annotations

import io
import json
import posixpath
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StringType, StructType

from shardloom.session import ship_package
from shardloom.sources.tar import BATCH_BYTES, BATCH_ROWS, MEMBER, SAMPLE_SCHEMA, SPLIT_BYTES, _cuts, _Samples, _sources, locate

FORMAT = "shards"
HEADER_COLUMNS = ("url", "part", "offset", "key", "source")
_PRIVATE = "_writing"
# Bytes of tars in a batch of a stream, about.
BATCH_SPLITS_BYTES = 16 * SPLIT_BYTES
# Entries of a stream's log after which one names how far every tar has come.
SUMMARY_EVERY = 50


def register_shards(spark: SparkSession) -> None:
    """Make the format known to the session and let it push filters down."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shards)


@dataclass
class Split(InputPartition):
    url: str
    part: int
    start: int
    end: int
    source: str


@dataclass
class Written(WriterCommitMessage):
    """Private and final names of a task's tars."""

    tars: list[tuple[str, str]]


class Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SAMPLE_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return ShardStreamReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(dict(self.options), schema, overwrite)


def _tars(path: str) -> list[tuple[str, int]]:
    """URIs and sizes of the tars a path names, in order of their names."""
    store, root = locate(path)
    info = store.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no shards at {path}")
    found = [i for i in store.get_file_info(pafs.FileSelector(root)) if i.type == pafs.FileType.File and i.base_name.endswith(".tar")]
    return sorted((f"{path.rstrip('/')}/{i.base_name}", i.size) for i in found)


class ShardReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.on_error = options.get("on_error", "skip")
        if self.on_error not in ("skip", "fail"):
            raise ValueError(f"unknown on_error: {self.on_error}")
        for field in schema.fields:
            if field.name.lower() not in (*HEADER_COLUMNS, "fields") and not isinstance(field.dataType, (BinaryType, StringType)):
                raise ValueError(f"member {field.name} can be read as binary or string")
        self.urls: set[str] | None = None
        self.keys: set[str] | None = None
        self.beginnings: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take equality and membership on ``url`` and ``key``, and beginnings of ``key``; give back the rest."""
        for f in filters:
            column = f.attribute[0].lower() if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in ("url", "key"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                held = self.urls if column == "url" else self.keys
                values = values if held is None else values & held
                if column == "url":
                    self.urls = values
                else:
                    self.keys = values
            elif isinstance(f, StringStartsWith) and column == "key":
                self.beginnings.append(f.value)
            else:
                yield f

    def wanted(self, key: str) -> bool:
        return (self.keys is None or key in self.keys) and all(key.startswith(b) for b in self.beginnings)

    def partitions(self) -> list[Split]:
        tars = [(url, size) for url, size in _tars(self.path) if self.urls is None or url in self.urls]
        folder = (tars[0][0] if tars else self.path).rsplit("/", 1)[0]
        known = _sources(folder) if tars else {}
        splits = []
        for url, size in tars:
            cuts = [0] if size <= self.split_bytes else _cuts(url, size, self.split_bytes)
            source = known.get(url.rsplit("/", 1)[1], url)
            splits += [Split(url, i, a, b, source) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], size]))]
        return splits

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        # Names of columns and of members are matched in any letter case, as Spark matches columns.
        names = [(n, n.lower()) for n in self.schema.names]
        members = {low for _, low in names if low not in (*HEADER_COLUMNS, "fields")}
        text = {f.name for f in self.schema.fields if isinstance(f.dataType, StringType)}
        everything = any(low == "fields" for _, low in names)
        samples = _Samples(
            partition.url, partition.start, partition.end, None if everything else members, self.on_error == "fail",
            self.wanted if self.keys is not None or self.beginnings else None,
        )
        kind = to_arrow_schema(self.schema)
        held, size = [], 0
        for offset, key, found in samples:
            head = {"url": partition.url, "part": partition.part, "offset": offset, "key": key, "source": partition.source}
            row = {}
            for name, low in names:
                if low in head:
                    row[name] = head[low]
                elif low == "fields":
                    row[name] = list(found.items())
                else:
                    data = found.get(low)
                    row[name] = data.decode("utf-8", "ignore") if data is not None and name in text else data
            held.append(row)
            size += sum(map(len, found.values()))
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(held, kind)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, kind)


class ShardStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        if "log" not in options:
            raise ValueError("a stream of shards needs the option log, a folder of its own")
        self.shards = ShardReader(options, schema)
        self.log = options["log"].rstrip("/")
        locate(self.log)
        self.batch_bytes = int(options.get("batch_bytes", BATCH_SPLITS_BYTES))
        # Entries written, and the end and the number of parts of each tar that was begun.
        self.entries: int | None = None
        self.begun: dict[str, tuple[int, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"entries": None, "begun": {}}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"entries": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """Write the parts of the next batch to the log, if there are any, and count the entries."""
        if self.entries is None:
            self._recall()
        tars = _tars(self.shards.path)
        known: dict[str, str] | None = None
        parts, taken = [], 0
        for url, size in tars:
            at, number = self.begun.get(url, (0, 0))
            if at >= size:
                continue
            left = self.batch_bytes - taken
            if left <= 0:
                break
            if known is None:
                known = _sources(url.rsplit("/", 1)[0])
            step = min(self.shards.split_bytes, left)
            cuts = [at] if size - at <= step else _cuts(url, size, step, at, left)
            ends = cuts[1:] if cuts[-1] - at >= left else [*cuts[1:], size]
            source = known.get(url.rsplit("/", 1)[1], url)
            parts += [(url, number + i, a, b, source) for i, (a, b) in enumerate(zip(cuts, ends))]
            taken += ends[-1] - at
            self.begun[url] = (ends[-1], number + len(ends))
        if parts:
            entry: dict = {"parts": parts}
            if (self.entries + 1) % SUMMARY_EVERY == 0:
                there = {url for url, _ in tars}
                self.begun = {url: far for url, far in self.begun.items() if url in there}
                entry["begun"] = self.begun
            self._write(self.entries, entry)
            self.entries += 1
        return {"entries": self.entries}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return [Split(*part) for n in range(start["entries"], end["entries"]) for part in self._read(n)["parts"]]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.shards.read(partition)

    def _place(self, n: int) -> tuple[pafs.FileSystem, str]:
        store, root = locate(self.log)
        return store, posixpath.join(root, f"{n:012d}.json")

    def _recall(self) -> None:
        """How far the log has come: from the last summary, and the entries behind it."""
        store, root = locate(self.log)
        store.create_dir(root, recursive=True)
        names = {i.base_name for i in store.get_file_info(pafs.FileSelector(root))}
        n = 0
        while f"{n:012d}.json" in names:
            n += 1
        self.entries, self.begun = n, {}
        low = n // SUMMARY_EVERY * SUMMARY_EVERY
        if low:
            self.begun = {url: (at, number) for url, (at, number) in self._read(low - 1)["begun"].items()}
        for k in range(low, n):
            for url, number, _, to, _ in self._read(k)["parts"]:
                self.begun[url] = (to, number + 1)

    def _read(self, n: int) -> dict:
        store, path = self._place(n)
        with store.open_input_file(path) as file:
            return json.loads(file.read())

    def _write(self, n: int, entry: dict) -> None:
        """An entry is there as a whole or not at all."""
        store, path = self._place(n)
        private = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(private) as out:
            out.write(json.dumps(entry).encode())
        store.move(private, path)


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.prefix = options.get("prefix", f"part-{uuid.uuid4().hex[:8]}")
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        if "key" not in schema.names:
            raise ValueError("shards need a column key")
        self.members = [f.name for f in schema.fields if f.name not in (*HEADER_COLUMNS, "fields")]
        locate(self.path)
        self.job = f"{_PRIVATE}.{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        partition = TaskContext.get().partitionId()
        store, root = locate(self.path)
        folder = posixpath.join(root, self.job)
        store.create_dir(folder, recursive=True)
        done: list[tuple[str, str]] = []
        tar = raw = None
        size, last = 0, None
        for batch in batches:
            for row in batch.to_pylist():
                key = row["key"]
                checked_key(key)
                if key == last:
                    raise ValueError(f"sample key {key!r} follows itself")
                if tar is not None and size >= self.split_bytes:
                    tar.close()
                    raw.close()
                    tar = None
                if tar is None:
                    private = posixpath.join(folder, uuid.uuid4().hex)
                    done.append((private, f"{self.prefix}-{partition:05d}-{len(done):05d}.tar"))
                    raw = store.open_output_stream(private)
                    tar, size = tarfile.open(fileobj=raw, mode="w|", format=tarfile.GNU_FORMAT), 0
                present = dict(row.get("fields") or []) | {m: row[m] for m in self.members}
                for field, data in sorted((k, v) for k, v in present.items() if v is not None):
                    data = data.encode() if isinstance(data, str) else data
                    info = tarfile.TarInfo(f"{key}.{field}")
                    info.size, info.mode = len(data), 0o444
                    tar.addfile(info, io.BytesIO(data))
                    size += len(data) + 1024
                last = key
        if tar is not None:
            tar.close()
            raw.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = locate(self.path)
        old = [posixpath.join(root, url.rsplit("/", 1)[1]) for url, _ in self._there()] if self.overwrite else []
        for message in messages:
            for private, name in message.tars if message else ():
                final = posixpath.join(root, name)
                store.move(private, final)
                old = [path for path in old if path != final]
        for path in old:
            store.delete_file(path)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*locate(self.path))

    def _there(self) -> list[tuple[str, int]]:
        try:
            return _tars(self.path)
        except FileNotFoundError:
            return []

    def _clear(self, store: pafs.FileSystem, root: str) -> None:
        folder = posixpath.join(root, self.job)
        if store.get_file_info(folder).type == pafs.FileType.Directory:
            store.delete_dir(folder)


def checked_key(key: str | None) -> None:
    """Refuse a key that would not read back: null, dotted, empty or hidden."""
    base = posixpath.basename(key or "")
    if not base or not MEMBER.fullmatch(f"{key}.x") or "." in base or base.startswith("__") and base.endswith("__"):
        raise ValueError(f"sample key {key!r} cannot be written")


