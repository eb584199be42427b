"""Tar shards as a data source: pruning, filters, commit and abort."""

import os
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith
from pyspark.sql.types import StringType, StructField, StructType

from shardloom.session import qualified
from shardloom.sources.tar import read_shards, write_shards
from shardloom.sources.tar_format import ShardReader, ShardStreamReader, checked_key, register_shards


@pytest.fixture
def shards(spark, folder):
    register_shards(spark)
    rows = [(f"s{i % 3}.tar", f"k{i:03d}", {"json": b'{"n":%d}' % i, "jpg": b"\xff" * 5_000, "txt": "né".encode() + b"\xff"}) for i in range(60)]
    write_shards(spark.createDataFrame(rows, "url string, key string, fields map<string,binary>"), folder)
    return qualified(spark, folder)


def keys(df):
    return sorted(r["key"] for r in df.collect())


@pytest.mark.parametrize("split_bytes", [1 << 30, 20_000])
def test_equals_read_shards(spark, shards, split_bytes):
    got = spark.read.format("shards").option("split_bytes", split_bytes).load(shards)
    want = read_shards(spark, shards + "/*.tar", split_bytes=split_bytes)
    order = ["url", "offset", "part", "key", "source", "fields"]
    assert got.schema.names == want.schema.names
    assert sorted(map(str, got.select(order).collect())) == sorted(map(str, want.select(order).collect()))


def test_members_by_schema(spark, shards):
    got = spark.read.format("shards").schema("txt string, KEY string, JSON binary, png binary").load(shards)
    row = got.filter("KEY = 'k007'").select("txt", "JSON", "png").first()
    assert (row["txt"], bytes(row["JSON"]), row["png"]) == ("né", b'{"n":7}', None)


def test_only_wanted_members_are_opened(shards, monkeypatch):
    """Neither other members nor samples ruled out by key are read."""
    opened = []
    real = tarfile.TarFile.extractfile
    monkeypatch.setattr(tarfile.TarFile, "extractfile", lambda self, info: (opened.append(info.name), real(self, info))[1])
    schema = StructType([StructField("key", StringType()), StructField("json", StringType())])
    reader = ShardReader({"path": shards}, schema)
    kept = list(reader.pushFilters([In(("key",), ("k003", "k006", "k007")), StringStartsWith(("key",), "k00"), GreaterThan(("key",), "k"), EqualTo(("json",), "x")]))
    assert [type(f).__name__ for f in kept] == ["GreaterThan", "EqualTo"]
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["key"] for r in found) == ["k003", "k006", "k007"]
    assert sorted(opened) == ["k003.json", "k006.json", "k007.json"]


def test_tars_are_chosen_by_url(spark, shards):
    reader = ShardReader({"path": shards}, StructType([StructField("key", StringType())]))
    url = f"{shards}/s1.tar"
    assert list(reader.pushFilters([EqualTo(("url",), url)])) == []
    assert [p.url for p in reader.partitions()] == [url]
    got = spark.read.format("shards").schema("url string, key string").load(shards).filter(F.col("url") == url)
    assert keys(got) == [f"k{i:03d}" for i in range(60) if i % 3 == 1]
    assert keys(got.filter("key IN ('k001', 'k002') AND key <> 'k004'")) == ["k001"]


def test_damage(spark, shards):
    path = shards.removeprefix("file://").removeprefix("file:") + "/s0.tar"
    with open(path, "r+b") as f:
        f.truncate(30_000)
    read = spark.read.format("shards").schema("key string, jpg binary")
    assert 0 < read.load(shards + "/s0.tar").count() < 20
    with pytest.raises(Exception, match="unexpected end|damaged"):
        spark.read.format("shards").schema("key string, jpg binary").option("on_error", "fail").load(shards).count()
    with pytest.raises(Exception, match="unknown on_error"):
        spark.read.format("shards").option("on_error", "other").load(shards).count()
    with pytest.raises(Exception, match="no shards at"):
        spark.read.format("shards").load(shards + "/nothing").count()


def tars(folder):
    return sorted(n for n in os.listdir(folder) if n.endswith(".tar")) if os.path.isdir(folder) else []


def test_write_and_read_again(spark, folder):
    register_shards(spark)
    df = spark.createDataFrame([(f"a/k{i:03d}", f"text {i}", None if i % 4 else b"\x00" * 2_000) for i in range(100)], "key string, txt string, png binary")
    path = qualified(spark, folder)
    df.repartitionByRange(3, "key").write.format("shards").mode("append").option("split_bytes", 20_000).option("prefix", "x").save(path)
    assert len(tars(folder)) > 3 and not [n for n in os.listdir(folder) if n.startswith("_writing")]
    again = spark.read.format("shards").schema("key string, txt string, png binary").load(path)
    assert keys(again) == keys(df)
    assert {r["key"]: (r["txt"], r["png"]) for r in again.collect()} == {r["key"]: (r["txt"], r["png"]) for r in df.collect()}
    df.limit(2).coalesce(1).write.format("shards").mode("overwrite").save(path)
    assert keys(spark.read.format("shards").schema("key string").load(path)) == ["a/k000", "a/k001"]
    df.filter("false").write.format("shards").mode("append").save(path)
    assert len(tars(folder)) == 1


@pytest.mark.parametrize("bad", ["k.x", None, "__hidden__", "a/"])
def test_an_aborted_write_leaves_no_tar(spark, folder, bad):
    register_shards(spark)
    df = spark.createDataFrame([(f"k{i}", "t") for i in range(50)] + [(bad, "t")], "key string, txt string").repartition(4)
    with pytest.raises(Exception, match="cannot be written"):
        df.write.format("shards").mode("append").save(qualified(spark, folder))
    assert tars(folder) == [] and (not os.path.isdir(folder) or os.listdir(folder) == [])


def test_keys():
    for key in ("a", "a/b", "a.b/c", "_x"):
        checked_key(key)


def streamed(spark, shards, folder, log, offsets, batch_bytes):
    """One start of a stream, which takes a batch and is stopped."""
    register_shards(spark)
    read = spark.readStream.format("shards").schema("url string, offset bigint, key string, txt string, part int")
    samples = read.option("log", qualified(spark, log)).option("batch_bytes", batch_bytes).load(shards)
    run = samples.writeStream.format("parquet").option("checkpointLocation", offsets).trigger(availableNow=True).start(folder)
    run.awaitTermination()


def test_stream_gives_every_sample_once_after_restarts_inside_a_tar(spark, shards, tmp_path, monkeypatch):
    monkeypatch.setattr("shardloom.sources.tar_format.SUMMARY_EVERY", 2)
    out, log, offsets = (str(tmp_path / n) for n in ("out", "log", "offsets"))
    counts = []
    for _ in range(5):
        streamed(spark, shards, out, log, offsets, 110_000)
        counts.append(spark.read.parquet(out).count())
    # A batch is smaller than a tar; and batches of three tars are more than one.
    assert 0 < counts[0] < 20 and counts == sorted(counts)
    more = [("late.tar", f"n{i}", {"txt": b"x" * 2_000}) for i in range(30)]
    write_shards(spark.createDataFrame(more, "url string, key string, fields map<string,binary>"), str(tmp_path / "new"))
    os.rename(tmp_path / "new" / "late.tar", os.path.join(shards.removeprefix("file:"), "a-late.tar"))
    for _ in range(5):
        streamed(spark, shards, out, log, offsets, 110_000)
    got = spark.read.parquet(out)
    want = spark.read.format("shards").schema("url string, offset bigint, key string, txt string").load(shards)
    order = ["url", "offset", "key", "txt"]
    assert got.count() == want.count() == 90
    assert sorted(map(str, got.select(order).collect())) == sorted(map(str, want.select(order).collect()))
    assert got.select("url", "part").distinct().count() > 4


def test_stream_log(spark, shards, tmp_path, monkeypatch):
    """A reader that starts anew finds where the last one was, with and without a summary."""
    monkeypatch.setattr("shardloom.sources.tar_format.SUMMARY_EVERY", 3)
    schema = StructType([StructField("key", StringType())])
    options = {"path": shards, "log": qualified(spark, str(tmp_path / "log")), "batch_bytes": "30000"}
    found, last = [], 0
    while True:
        reader = ShardStreamReader(options, schema)
        end = reader.latestOffset()
        if end["entries"] == last:
            break
        assert end["entries"] == last + 1
        parts = reader.partitions({"entries": last}, end)
        assert sum(p.end - p.start for p in parts) < 60_000
        found += [(p.url, p.part, r["key"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        last = end["entries"]
    assert last > 6 and sorted(k for _, _, k in found) == [f"k{i:03d}" for i in range(60)]
    assert reader.latestOffset() == {"entries": last} and reader.partitions({"entries": last}, {"entries": last}) == []
    with pytest.raises(ValueError, match="log"):
        ShardStreamReader({"path": shards}, schema)
