"""Queries over tars give the same rows whether or not a source is split into several tars."""

import os
import time

import pytest

from shardloom.catalog import queries
from shardloom.operators import routing
from shardloom.plans import translation
from tests.conftest import rows

SF = "/root/testdata/sf0.001"
NAMES = ["shard_roundtrip", "training_batches_from_shards", "translate_shards", "stream_translate_shards"]


@pytest.mark.parametrize("name", NAMES)
def test_split_sources_change_no_result(spark, monkeypatch, name):
    run, store, made = queries.queries()[name], queries.stored_shards, []

    def small(*args):
        made.append(store(*args, part_bytes=20_000))
        return made[-1]

    whole = sorted(map(repr, rows(run(spark, SF))))
    monkeypatch.setattr(queries, "stored_shards", small)
    assert sorted(map(repr, rows(run(spark, SF)))) == whole
    assert any(f.endswith("-00001.tar") for f in os.listdir(made[0]))


def expected(docs):
    """Errors and samples as the SQL of the queries has them."""
    errors, samples, by = set(), set(), {}
    for i, source, text in docs:
        by.setdefault(source, []).append((f"{i:09d}", len(text)))
    names = ["cut short", "damaged header", "repeated member", "no tar"]
    for source, found in by.items():
        kind = int(source[3:]) % 5 if source[:3] == "src" else 4
        errors |= {(source, names[kind])} if kind < 4 else set()
        kept = sorted(found)[: 2 if kind < 2 else 0 if kind == 3 else None]
        samples |= {(source, *x) for x in kept}
    return sorted(errors), sorted(samples)


@pytest.mark.parametrize("part_bytes", [64 << 20, 4_000])
def test_damage_of_any_source_and_size(spark, tmp_path, monkeypatch, part_bytes):
    docs = [(i, f"src{i % 6}", "x" * (i * 37 % 900)) for i in range(120)]
    docs += [(1_000 + i, "src10", "few") for i in range(2)] + [(1_010, "src11", ""), (1_020, "src12", "f"), (1_030, "web", "no number")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    store, made = queries.damaged_shards, []

    def small(*args):
        made.append(store(*args, part_bytes=part_bytes))
        return made[-1]

    monkeypatch.setattr(queries, "damaged_shards", small)
    errors, samples = expected(docs)
    assert rows(queries.queries()["shard_errors"](spark, str(tmp_path)), "shard") == errors
    assert rows(queries.queries()["shards_with_errors"](spark, str(tmp_path)), "shard", "key") == samples
    assert (part_bytes == 4_000) == any(f.endswith("-00001.tar") for f in os.listdir(made[0][: -len("/*.tar")]))


def shuffled(spark):
    """Shuffle files with payload that are on the disk."""
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    paths = [os.path.join(d, f) for t in top for d, _, names in os.walk(t) for f in names if f.startswith("shuffle_") and f.endswith(".data")]
    return {p for p in paths if os.path.getsize(p) > 10_000}


def test_stored_shards_leave_no_copy_behind(spark):
    before, tables = shuffled(spark), set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    folder = queries.stored_shards(spark, SF)
    new = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - tables
    assert {n.rsplit("-", 1)[0] for n in new} == {"shards", "shard-sizes"}
    # Spark removes them on its own time.
    until = time.time() + 30
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert any(f.endswith(".tar") for f in os.listdir(folder))


def test_shards_are_used_up_in_rounds(spark, tmp_path, monkeypatch):
    sizes = [10, 10, 50, 5, 5, 10, 10, 0]
    for i, size in enumerate(sizes):
        (tmp_path / f"{i}.tar").write_bytes(b"x" * size)
    (tmp_path / "note.txt").write_text("no tar")
    monkeypatch.setattr(queries, "ROUND_BYTES", 25)
    seen = []
    for urls in queries.used_up(spark, str(tmp_path)):
        assert {os.path.basename(u) for u in urls} <= set(os.listdir(tmp_path))
        seen.append([int(os.path.basename(u)[:-4]) for u in urls])
    assert len(seen) == 4 - 1 and sorted(sum(seen, [])) == list(range(len(sizes)))
    assert sorted(os.listdir(tmp_path)) == sorted([*(f"{i}.tar" for i in seen[-1]), "note.txt"])


@pytest.mark.parametrize("name", ["shards_by_format", "translate_shards", "stream_translate_shards"])
def test_rounds_change_no_result(spark, monkeypatch, name):
    run, store, made = queries.queries()[name], queries.stored_shards, []

    def small(*args):
        made.append((folder := store(*args, part_bytes=20_000), sorted(f for f in os.listdir(folder) if f.endswith(".tar"))))
        return folder

    whole = sorted(map(repr, rows(run(spark, SF))))
    monkeypatch.setattr(queries, "ROUND_BYTES", 1)
    monkeypatch.setattr(queries, "ROUNDS", 5)
    monkeypatch.setattr(queries, "stored_shards", small)
    assert sorted(map(repr, rows(run(spark, SF)))) == whole
    (folder, tars), = made
    left = [f for f in os.listdir(folder) if f.endswith(".tar")]
    assert len(tars) > 20 and 0 < len(left) <= 2 * len(tars) // 5 and os.path.isdir(f"{folder}/_manifest")


def test_translation_removes_its_captions(spark, tmp_path, profile):
    source = queries.stored_shards(spark, SF)
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    made = translation.translate_shards(spark, f"{source}/*.tar", str(tmp_path / "out"), profile, routing.routes(spark), queries.stand_in_model)
    new = set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) - before
    assert made.count() and new and not any(n.startswith("captions") for n in new)
