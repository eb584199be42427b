import collections
import io
import json
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shardloom.catalog.queries import png
from shardloom.operators import routing
from shardloom.plans import training, translation
from shardloom.session import qualified
from shardloom.sources import images, json_array, lists, tables, tar
from shardloom.streaming.shards import stream_translate
from tests.conftest import rows

PNG = png((1, 2, 3))


def build(path, members):
    with tarfile.open(path, "w") as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def members(shard):
    """Four samples: complete, without json, without image, with jpg and png."""
    k = [f"{shard}{i}" for i in range(4)]
    js = lambda i: (f"{k[i]}.json", json.dumps({"caption": f"das ist ein Satz {k[i]}", "n": i}).encode())
    txt = lambda i: (f"{k[i]}.txt", f"text {k[i]}".encode())
    return [
        (f"{k[0]}.png", PNG), js(0), txt(0), (f"{k[1]}.png", PNG), txt(1), js(2), txt(2),
        (f"{k[3]}.JPG", b"jpeg"), (f"{k[3]}.png", PNG), js(3), txt(3),
    ]


@pytest.fixture
def shards(tmp_path):
    for name in "abc":
        build(tmp_path / f"{name}.tar", members(name))
    return tmp_path


def content(df):
    return {(os.path.basename(r.url), r.key): {k: bytes(v) for k, v in r.fields.items()} for r in df.collect()}


def expected(names="abc"):
    out = {}
    for s in names:
        for name, data in members(s):
            key, field = name.split(".")
            out.setdefault((f"{s}.tar", key), {})[field.lower()] = data
    return out


def test_read_shards(spark, shards):
    df = tar.read_shards(spark, f"{shards}/*.tar", on_error="fail")
    assert df.rdd.getNumPartitions() == 3
    assert content(df) == expected()
    typed = {r.key: r for r in tar.typed_samples(df).collect()}
    assert typed["a1"].json is None and typed["a2"].png is None and typed["a3"].jpg == b"jpeg" and typed["a0"].txt == "text a0"


def test_cut_shards_give_the_same_samples(spark, shards):
    for size in (1, 2000, 5000):
        df = tar.read_shards(spark, f"{shards}/*.tar", on_error="fail", split_bytes=size)
        assert df.count() == 12 and content(df) == expected()
    splits = tar.shard_splits(spark, f"{shards}/*.tar", 1)
    assert splits.count() == 12 and splits.filter("parts = 4").count() == 12


def test_wanted_fields_only(spark, shards):
    got = content(tar.read_shards(spark, f"{shards}/*.tar", fields=["json", "TXT"]))
    assert len(got) == 12 and all(set(v) <= {"json", "txt"} for v in got.values())


def test_empty_glob_fails(spark, shards):
    with pytest.raises(FileNotFoundError):
        tar.read_shards(spark, f"{shards}/*.nothing")
    with pytest.raises(ValueError):
        tar.read_shards(spark, f"{shards}/*.tar", on_error="other")


def test_broken_shards(spark, shards):
    data = (shards / "a.tar").read_bytes()
    (shards / "d.tar").write_bytes(data[: 512 * 9 + 100])
    (shards / "e.tar").write_bytes(b"no tar at all" * 100)
    build(shards / "f.tar", [("x.txt", b"1"), ("x.txt", b"2"), ("README", b"-"), ("__meta__.txt", b"-"), ("dir/y.b.txt", b"3")])
    got = content(tar.read_shards(spark, f"{shards}/*.tar"))
    assert {k: v for k, v in got.items() if k[0] in ("a.tar", "b.tar", "c.tar")} == expected()
    assert got[("f.tar", "x")] == {"txt": b"1"} and got[("f.tar", "dir/y")] == {"b.txt": b"3"}
    assert ("d.tar", "a0") in got and not [k for k in got if k[0] == "e.tar"]
    errors = {os.path.basename(r.url) for r in tar.shard_errors(spark, f"{shards}/*.tar").collect()}
    assert {"d.tar", "e.tar"} <= errors <= {"d.tar", "e.tar", "f.tar"}
    for name in "de":
        with pytest.raises(Exception, match="ReadError"):
            tar.read_shards(spark, f"{shards}/{name}.tar", on_error="fail").collect()
    with pytest.raises(Exception, match="duplicate member"):
        tar.read_shards(spark, f"{shards}/f.tar", on_error="fail").collect()


@pytest.mark.parametrize("split_bytes", [1 << 20, 1500])
def test_damaged_header_is_no_end(spark, shards, folder, profile, split_bytes):
    """A header that cannot be read stops the job, or ends its tar with an error that is counted."""
    data = bytearray((shards / "b.tar").read_bytes())
    third = tarfile.open(shards / "b.tar").getmembers()[5].offset
    data[third : third + 512] = b"\x7f" * 512
    (shards / "b.tar").write_bytes(data)
    with pytest.raises(Exception, match="damaged header"):
        tar.read_shards(spark, f"{shards}/b.tar", on_error="fail", split_bytes=split_bytes).collect()
    errors = tar.shard_errors(spark, f"{shards}/*.tar", split_bytes).collect()
    assert {os.path.basename(r.url) for r in errors} == {"b.tar"} and all("damaged header" in r.error for r in errors)
    kept = content(tar.read_shards(spark, f"{shards}/*.tar", split_bytes=split_bytes))
    assert {k for k in kept if k[0] == "b.tar"} == {("b.tar", "b0"), ("b.tar", "b1")}
    table = routing.routes(spark)
    with pytest.raises(Exception, match="damaged header"):
        translation.translate_shards(spark, f"{shards}/*.tar", folder, profile, table, german, split_bytes=split_bytes)
    manifest = translation.translate_shards(
        spark, f"{shards}/*.tar", folder + "-skip", profile, table, german, split_bytes=split_bytes, on_error="skip"
    )
    by_url = {os.path.basename(r.url): (r.n, r.e) for r in manifest.groupBy("url").agg(
        F.sum("n_samples").alias("n"), F.sum("n_errors").alias("e")).collect()}
    assert by_url["a.tar"] == by_url["c.tar"] == (4, 0) and by_url["b.tar"][0] == 2 and by_url["b.tar"][1] >= 1


def test_a_member_cut_short_starts_no_sample(spark, tmp_path):
    build(tmp_path / "a.tar", [("x.txt", b"1" * 600), ("y.txt", b"2" * 600)])
    data = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "a.tar").write_bytes(data[: 512 * 4 + 100])
    assert content(tar.read_shards(spark, f"{tmp_path}/a.tar")) == {("a.tar", "x"): {"txt": b"1" * 600}}


@pytest.mark.parametrize("keys", [["a.b"], [None], ["x", "x"], ["__x__"], ["d/"]])
def test_keys_that_would_not_read_back_are_refused(spark, folder, keys):
    df = spark.createDataFrame([("u", k, {"txt": b"1"}) for k in keys], "url string, key string, fields map<string,binary>")
    with pytest.raises(ValueError, match="sample key"):
        tar.write_shards(df, folder)


def test_paths_mean_the_same_to_driver_and_tasks(spark, shards, folder, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert qualified(spark, "/x/y").startswith("file:/") and qualified(spark, "/x/y").endswith("/x/y")
    assert tar.locate("file:///x/y")[1] == "/x/y"
    with pytest.raises(ValueError, match="without a scheme"):
        tar.locate("/x/y")
    conf.set("fs.viewfs.mounttable.m.link./in", f"file://{shards}")
    conf.set("fs.viewfs.mounttable.m.link./out", f"file://{tmp_path}")
    assert qualified(spark, "viewfs://m/out/o") == f"file:{tmp_path}/o"
    df = tar.read_shards(spark, f"{shards}/*.tar")
    tar.write_shards(df, "viewfs://m/out/o")
    assert tar.read_shards(spark, f"file:{tmp_path}/o/*.tar", on_error="fail").count() == 12


def test_training_batches_from_tars(spark, shards):
    train, val = training.training_batches(spark, f"{shards}/*.tar", ratio=0.5, batch_size=1)
    got = {r.key: bytes(r.image) for r in train.unionByName(val).collect()}
    assert got == {k: v.get("jpg") or v["png"] for (_, k), v in expected().items() if "png" in v or "jpg" in v}
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("part_bytes,files", [(1 << 20, 3), (2500, 9)])
def test_write_then_read_is_the_identity(spark, shards, folder, part_bytes, files):
    df = tar.read_shards(spark, f"{shards}/*.tar")
    manifest = tar.write_shards(df, folder, part_bytes)
    tars = [f for f in os.listdir(folder) if f.endswith(".tar")]
    assert 3 <= len(tars) <= files and not [f for f in os.listdir(folder) if f.startswith("_tmp")]
    assert manifest.agg(F.sum("n_samples")).first()[0] == 12
    back = content(tar.read_shards(spark, f"{folder}/*.tar", on_error="fail"))
    assert {k: v for (_, k), v in back.items()} == {k: v for (_, k), v in expected().items()}
    with pytest.raises(FileExistsError):
        tar.write_shards(df, folder)


def test_written_tars_are_reproducible(spark, shards, tmp_path):
    df = tar.read_shards(spark, f"{shards}/*.tar")
    out = [str(tmp_path / n) for n in ("one", "two")]
    tar.write_shards(df, out[0])
    tar.write_shards(df.repartition(5), out[1])
    for name in ("a.tar", "b.tar", "c.tar"):
        assert open(f"{out[0]}/{name}", "rb").read() == open(f"{out[1]}/{name}", "rb").read()


def test_clashing_names_fail(spark, folder):
    df = spark.createDataFrame([("x/0.tar", "k", {"txt": b"1"}), ("y/0.tar", "k", {"txt": b"2"})], "url string, key string, fields map<string,binary>")
    with pytest.raises(ValueError):
        tar.write_shards(df, folder)


def german(name):
    return lambda texts: [f"[{name}] {t}" for t in texts]


@pytest.mark.parametrize("split_bytes", [1 << 20, 2000])
def test_translate_shards(spark, shards, folder, profile, split_bytes):
    table = routing.routes(spark)
    translation.translate_shards(spark, f"{shards}/*.tar", folder, profile, table, german, split_bytes=split_bytes)
    back = {k: v for (_, k), v in content(tar.read_shards(spark, f"{folder}/*.tar", on_error="fail")).items()}
    assert set(back) == {k for _, k in expected()}
    for (_, key), fields in expected().items():
        assert {k: v for k, v in back[key].items() if k != "json"} == {k: v for k, v in fields.items() if k != "json"}
        new = json.loads(back[key]["json"]) if "json" in back[key] else {}
        old = json.loads(fields["json"]) if "json" in fields else {}
        cap = old.get("caption", fields["txt"].decode())
        if "caption_en" in new:
            assert new == {**old, "caption_en": new["caption_en"]} and new["caption_en"].endswith(cap)
        else:
            assert new == old
    assert any("caption_en" in json.loads(v["json"]) for v in back.values() if "json" in v)


def test_stream_translates_each_shard_once(spark, tmp_path, profile):
    source, out, offsets = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "offsets")
    source.mkdir()
    table = routing.routes(spark)
    run = lambda: stream_translate(spark, str(source), out, offsets, profile, table, german).awaitTermination()
    build(source / "a.tar", members("a"))
    run()
    build(source / "b.tar", members("b"))
    build(source / "c.tar", members("c"))
    run()
    run()
    got = content(tar.read_shards(spark, f"{out}/batch=*/*.tar", on_error="fail"))
    assert sorted(got) == sorted(expected())


def test_line_list(spark, tmp_path):
    raw = "  one \r\n\r\n   \ntwo\n\t　three \r\nfour"
    (tmp_path / "l.txt").write_bytes(raw.encode())
    got = rows(lists.read_line_list(spark, str(tmp_path / "l.txt"), "i", "v"), "i")
    assert got == [(0, "one"), (1, "two"), (2, "three"), (3, "four")]


def test_line_list_over_many_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "  " for i in range(5000)]
    for part in range(3):
        (tmp_path / f"p{part}.txt").write_text("\n".join(lines[part::1][:1] if part < 2 else lines[2:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = lists.read_line_list(spark, str(tmp_path), "i", "v")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = rows(df, "i")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == list(enumerate(x.strip() for x in lines if x.strip()))


def test_json_array(spark, tmp_path):
    data = [" a ", "", "日\n", "\"q\""]
    (tmp_path / "c.json").write_text(json.dumps(data))
    assert rows(lists.read_json_array(spark, str(tmp_path / "c.json")), "caption_id") == list(enumerate(data))


ELEMENTS = ["", "plain", '"', "\\", '\\"', "\\\\", "[,]{}", 'a"],["b', "日本\n", None, "\\" * 9 + '"' * 3, "x" * 50, 7, 1.5, True, ["n", {"k": "],"}]]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 20])
def test_json_array_in_ranges_of_any_size(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(json_array, "ON_BYTES", 5)
    monkeypatch.setattr(json_array, "BACK_BYTES", 2)
    for name, data, indent in (("a", ELEMENTS, None), ("b", ELEMENTS[::-1] * 2, 1), ("c", [], None), ("d", [[]], None)):
        (tmp_path / f"{name}.json").write_text(" \n" + json.dumps(data, indent=indent, ensure_ascii=name == "b") + "\n ")
    (tmp_path / "e.json").write_text("")
    got = collections.defaultdict(list)
    found = json_array.array_elements(spark, str(tmp_path), size)
    for r in found.orderBy("url", "id").collect():
        assert r.id == len(got[r.url[-6]])
        got[r.url[-6]].append(json.loads(r.json))
    assert got == {"a": ELEMENTS, "b": ELEMENTS[::-1] * 2, "d": [[]]}


@pytest.mark.parametrize("text", [
    " ", '["a","b"', '["a"]]', '["a"] "b"', '"a"', '{"a": 1}', '["a",]', '[,"a"]', '["a",,"b"]', '["a"}', '["a"]["b"]', '["a" "b"]', '["a', '[["a"]', 'x["a"]',
])
def test_json_array_must_be_one(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed"):
        lists.read_json_array(spark, str(tmp_path / "c.json"), range_bytes=2).collect()
    with pytest.raises(Exception, match="(?i)malformed"):
        lists.read_json_array(spark, str(tmp_path / "c.json")).collect()


def test_images(spark, tmp_path):
    (tmp_path / "good.png").write_bytes(PNG)
    (tmp_path / "junk.png").write_bytes(b"junk")
    listed = lists.image_paths(
        spark.createDataFrame([(0, "junk.png"), (1, "missing.png"), (2, "good.png")], "image_id bigint, path string"), str(tmp_path)
    )
    got = images.read_images(spark, listed, str(tmp_path)).select("image_id", "image.height", "image.width", "image.nChannels")
    assert rows(got) == [(2, 2, 3, 3)]
    assert [r[0] for r in rows(images.unreadable_images(spark, listed, str(tmp_path)), "image_id")] == [0, 1]


def test_images_in_folders_are_read_in_few_tasks(spark, tmp_path):
    names = [f"{i % 7}/{i}.png" for i in range(40 * images.TASK_PARTS)]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(PNG)
    listed = lists.image_paths(spark.createDataFrame(list(enumerate(names)), "image_id bigint, path string"), str(tmp_path))
    got = images.read_images(spark, listed, str(tmp_path))
    assert got.count() == len(names) and images.unreadable_images(spark, listed, str(tmp_path)).isEmpty()
    found = images._decoded(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= max(4 * spark.sparkContext.defaultParallelism, 2)


def test_profile_and_export(spark, folder):
    df = spark.createDataFrame([("k2", None, b"2"), ("k1", "one", b"1"), ("k3", "three", b"3")], "key string, caption string, image binary")
    assert rows(tables.profile_dataset(df, "key", "caption")) == [(3, 1, "one")]
    got = rows(tables.export_samples(df, "key", F.col("image"), F.col("caption"), 2), "name")
    assert got == [("sample_00000.jpg", b"1", "one"), ("sample_00001.jpg", b"2", None)]
    tables.export_metadata(df, folder)
    assert spark.read.parquet(folder).count() == 3


def test_changes_of_a_shard_reach_the_copy_in_order_and_one_at_a_time(spark, shards, folder):
    """Null and unknown changes change nothing; of the splits none is left out. No table of changes is gathered for a split."""
    splits = tar.shard_splits(spark, f"{shards}/*.tar")
    read = tar.read_splits(splits, ("json",))
    place = read.select("url", "part", "offset", "key").withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("offset")))
    json = F.when(F.col("n") % 2 == 0, F.concat(F.lit('{"k": "'), "key", F.lit('"}')))
    new = place.select("url", "part", "offset", json.alias("json"))
    lost = new.limit(1).select(F.lit("file:/none.tar").alias("url"), "part", "offset", F.lit("{}").alias("json"))
    manifest = tar.rewrite_shards(splits, new.unionByName(lost).unionByName(new.withColumn("offset", F.col("offset") + 1)), folder)
    assert manifest.count() == splits.count()
    plan = manifest._jdf.queryExecution().toString()
    got = {r.key: bytes(r.fields["json"]).decode() if "json" in r.fields else None for r in tar.read_shards(spark, f"{folder}/*.tar", ("json",)).collect()}
    before = {r.key: bytes(r.fields["json"]).decode() if "json" in r.fields else None for r in read.collect()}
    want = {r.key: f'{{"k": "{r.key}"}}' if r.n % 2 == 0 else before[r.key] for r in place.collect()}
    assert got == want and "FlatMapCoGroups" not in plan


def test_a_copy_reads_changes_as_it_goes(tmp_path):
    """When a sample is written, no change behind the next one has been taken yet."""
    with tarfile.open(tmp_path / "a.tar", "w") as out:
        for i in range(5):
            info = tarfile.TarInfo(f"{i}.json")
            info.size = 2
            out.addfile(info, io.BytesIO(b"{}"))
    url, taken, written = f"file:{tmp_path}/a.tar", [], []
    places = [at for at, _, _ in tar._Samples(url, 0, 1 << 30, None, True)]

    def rows():
        yield {"url": url, "part": 0, "parts": 1, "start": 0, "end": 1 << 30, "source": url, "offset": -1, "json": None}
        for at in places:
            taken.append(at)
            yield {"url": url, "part": 0, "parts": None, "offset": at, "json": f"[{at}]"}

    class Watched(tar.TarOut):
        def add(self, key, fields):
            written.append((len(taken), dict(fields)["json"].decode()))

    kept, tar.TarOut = tar.TarOut, Watched
    try:
        assert len(list(tar._copy_split(rows(), f"file:{tmp_path}", True))) == 1
    finally:
        tar.TarOut = kept
    assert written == [(min(i + 2, 5), f"[{at}]") for i, at in enumerate(places)]


def test_images_are_listed_a_bounded_number_at_a_time(spark, tmp_path, monkeypatch):
    names = [f"{i % 3}/{i:03d}.png" for i in range(60)] + ["top.png", "a b.png", "c[1]{x}*.png", ".hidden.png", "_x/y.png", "k=1/z.png", "junk.png"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"junk" if name == "junk.png" else PNG)
    more = ["missing.png", "top.png", "a%20b.png", "c%5B1%5D%7Bx%7D*.png", "0", "1/../top.png", "1//001.png"]
    paths = [*[f"{tmp_path}/{n}" for n in [*names, *more]], f"file://{tmp_path}/1/001.png", None, "/elsewhere.png"]
    frame = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, image_id int")
    read, given = images._decoded, []
    at_once = frame.join(read(spark, str(tmp_path)), images._plain(F.col("path")) == F.col("__at"))
    good = rows(at_once.select("image_id", "path", "image.width"), "image_id")
    assert {p.rsplit("/", 1)[1] for _, p, _ in good} >= {"a%20b.png", "c%5B1%5D%7Bx%7D*.png", "z.png", "top.png"} and len(good) == 66
    monkeypatch.setattr(images, "_decoded", lambda s, places: given.append(places) or read(s, places))
    parts = [rows(p.select("image_id", "path", "image.width")) for p in images.image_parts(spark, frame, str(tmp_path), files_at_once=10)]
    assert sorted(r for part in parts for r in part) == good and len(parts) > 5
    whole = images.read_images(spark, frame, str(tmp_path), image=F.col("image").dropFields("data"), files_at_once=10)
    assert rows(whole.select("image_id", "path", "image.width"), "image_id") == good and "data" not in whole.schema["image"].dataType.names
    bad = images.unreadable_images(spark, frame, str(tmp_path), files_at_once=10)
    assert sorted(r.image_id for r in bad.collect()) == sorted(set(range(len(paths))) - {i for i, _, _ in good})
    assert all(isinstance(x, list) and len(x) <= 10 for x in given)
    none = images.read_images(spark, frame.filter("path LIKE '%missing.png'"), str(tmp_path))
    assert none.count() == 0 and none.schema["image"].dataType == at_once.schema["image"].dataType
