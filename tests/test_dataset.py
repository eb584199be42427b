import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.catalog.inputs import derive_samples
from shardloom.functions.tokens import encoded_column
from shardloom.operators import dataset
from shardloom.operators.translate import translate
from shardloom.plans import evaluation, submission, training
from shardloom.streaming.losses import stream_ema
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def test_split_is_disjoint_and_complete(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    train, val = dataset.split_train_val(df)
    assert train.intersect(val).count() == 0
    assert df.exceptAll(train.unionAll(val)).count() == 0 and train.count() + val.count() == 2000
    assert 0.93 < train.count() / 2000 < 0.97
    named = dict(rows(dataset.with_split(df).groupBy("split").count()))
    assert named == {"train": train.count(), "val": val.count()}


@pytest.mark.parametrize("ratio", [0.0, 1.0, -1, 2])
def test_ratio_is_checked(spark, ratio):
    with pytest.raises(ValueError):
        dataset.split_train_val(spark.range(1), "id", ratio)
    with pytest.raises(ValueError):
        dataset.with_split(spark.range(1), "id", ratio)


def test_trainable(spark):
    df = spark.createDataFrame([(1, b"x", "c"), (2, None, "c"), (3, b"", "c"), (4, b"x", ""), (5, b"x", None)], "i int, image binary, caption string")
    assert [r[0] for r in rows(dataset.trainable(df))] == [1]


def test_shuffle_is_reproducible(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("key"))
    order = lambda d, seed: [r.key for r in dataset.shuffle(d, seed=seed, partitions=1).collect()]
    first = order(df, 1)
    assert first == order(df.repartition(7), 1) and first != order(df, 2) and sorted(first) == sorted(str(i) for i in range(500))


@pytest.mark.parametrize("buckets", [1, 8, 256])
def test_batches_follow_the_digest(spark, buckets):
    data = [("hot", f"k{i}") for i in range(100)] + [("cold", f"k{i}") for i in range(7)] + [(None, "k")] + [("dup", "same")] * 9
    df = spark.createDataFrame(data, "url string, key string").repartition(3)
    out = rows(dataset.assign_batches(df, 8, seed=5, buckets=buckets).select("url", "key", "batch", "row_in_batch"))
    groups = defaultdict(list)
    for url, key, batch, row in out:
        groups[url].append((batch * 8 + row, key))
    for url, got in groups.items():
        keys = sorted((k for u, k in data if u == url), key=lambda k: hashlib.md5(f"5:{k}".encode()).hexdigest())
        assert [k for _, k in sorted(got)] == keys and [p for p, _ in sorted(got)] == list(range(len(keys)))
    kept = dataset.assign_batches(df, 8, drop_last=True, buckets=buckets).groupBy("url").count()
    assert dict(rows(kept)) == {"hot": 96, "dup": 8}


def test_training_batches(spark):
    samples = derive_samples(spark, SF)
    train, val = training.batches_from_samples(samples, batch_size=4)
    sizes = rows(train.groupBy("url", "batch").agg(F.count("*"), F.count_distinct(F.size("padded")), F.max(F.size("padded"))))
    assert sizes and all(n == 4 and widths == 1 and w <= 64 for _, _, n, widths, w in sizes)
    usable = training.sample_pairs(dataset.split_train_val(samples)[1]).count()
    assert val.count() == usable


def test_evaluate_drops_the_partial_batch_for_training_only(spark):
    rng = np.random.default_rng(0)
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, v array<double>")
    a, b = rng.normal(size=(10, 3)), rng.normal(size=(10, 3))
    images = frame(a).withColumn("batch", F.floor(F.col("id") / 4).cast("bigint"))
    out = evaluation.evaluate(3, (images, frame(b)), (images, frame(b)), 4, 5.0, -1.0)
    row = out.first().asDict()
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    loss = []
    for s in (slice(0, 4), slice(4, 8), slice(8, 10)):
        x = 5 * unit(a[s]) @ unit(b[s]).T - 1
        loss.append(np.mean(np.maximum(x, 0) - x * np.eye(len(x)) + np.log1p(np.exp(-np.abs(x)))))
    assert row["epoch"] == 3 and row["train_loss"] == pytest.approx(np.mean(loss[:2])) and row["val_loss"] == pytest.approx(np.mean(loss))
    assert row["i2t_R_at_1"] <= row["i2t_R_at_5"] <= row["i2t_R_at_10"] == 1.0
    stops, report = evaluation.summarize_run(out.withColumn("run", F.lit("r")))
    assert rows(stops) == [("r", None)] and report.count() == 11


def test_submission_from_lists_keeps_ids_of_unreadable_images(spark):
    images = spark.createDataFrame([(0, b"ab"), (2, b"b")], "image_id bigint, image binary")
    captions = spark.createDataFrame([(0, "a"), (1, "b"), (2, "ab")], "caption_id bigint, caption string")
    count = lambda x: [x.count("a"), x.count("b")] if isinstance(x, str) else [x.count(b"a"), x.count(b"b")]
    load = lambda: lambda values: np.array([count(v) for v in values], dtype=float)
    got = submission.submission_from_lists(images, captions, load, load, 4, k=2)
    assert rows(got, "image_id") == [(0, "0-2"), (1, ""), (2, "1-2"), (3, "")]


def test_stream_ema_survives_restarts_and_old_steps(spark, tmp_path):
    path, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    schema = "run string, step bigint, loss double"

    def feed(data):
        spark.createDataFrame(data, schema).write.mode("append").parquet(path)
        stream_ema(spark.readStream.schema(schema).parquet(path), out, offsets).awaitTermination()

    feed([("a", 1, 2.0), ("a", 0, 1.0), ("b", 0, 7.0)])
    feed([("a", 2, 3.0), ("a", 1, 50.0)])
    feed([("b", 0, 9.0)])
    got = {(r.run, r.step): r.ema for r in spark.read.parquet(out).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("a", 2), ("b", 0)}
    assert got[("a", 2)] == pytest.approx(1.29) and got[("b", 0)] == 7.0


def test_stream_ema_goes_on_like_the_stored_history(spark, tmp_path):
    """One run with all rows in batches of many stretches; repeated steps, a null run and a batch of old steps only."""
    path, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    schema = "run string, step bigint, loss double"
    data = [("a", i, float(i * 7 % 13)) for i in range(20_000)] + [(None, i, float(i)) for i in range(50)]
    for lo, hi in ((0, 9_000), (9_000, 20_000), (5_000, 6_000)):
        part = [r for r in data if lo <= r[1] < hi]
        spark.createDataFrame(part + part[:100], schema).write.mode("append").parquet(path)
        stream_ema(spark.readStream.schema(schema).parquet(path), out, offsets).awaitTermination()
    got = {(r.run, r.step): r.ema for r in spark.read.parquet(out).collect()}
    assert len(got) == spark.read.parquet(out).count() == len(data)
    smooth = {}
    for run, step, x in data:
        smooth[run] = 0.9 * smooth[run] + 0.1 * x if run in smooth else x
        assert got[(run, step)] == pytest.approx(smooth[run], rel=1e-9)


def replayed(ids, shard, size, seed):
    """The buffer as it runs, row by row."""
    digest = lambda *what: hashlib.md5(":".join([str(seed), shard, *map(str, what)]).encode()).hexdigest()
    slots, out = [], []
    for i, row in enumerate(ids):
        if i < size:
            slots.append(row)
        else:
            k = int(digest(i)[:8], 16) % size
            out.append(slots[k])
            slots[k] = row
    return out + [slots[k] for k in sorted(range(len(slots)), key=lambda k: digest("end", k))]


@pytest.mark.parametrize("size,parts", [(1, 1), (10, 3), (100, 2), (5_000, 4)])
def test_buffer_shuffle_equals_the_buffer(spark, size, parts):
    shards = {"a": 700, "b": 100, "c": 1, None: 37}
    data = [(s, 3 * i) for s, n in shards.items() for i in range(n)]
    df = spark.createDataFrame(data, "url string, place bigint").repartition(parts)
    got = dataset.buffer_shuffle(df, ["place"], F.floor(F.col("place") / 64), size, seed=5).collect()
    assert len(got) == len(data)
    for shard, n in shards.items():
        rows_of = sorted((r.position, r.place) for r in got if r.url == shard)
        assert [p for p, _ in rows_of] == list(range(n))
        assert [x for _, x in rows_of] == replayed([3 * i for i in range(n)], shard or "", size, 5)
    assert len({r.shard_order for r in got}) == 4
    empty = dataset.buffer_shuffle(df.limit(0), ["place"], F.col("place"), size)
    assert empty.count() == 0


def test_tokens_are_cut_and_padded_to_a_fixed_length(spark):
    def load():
        def tokenize(texts):
            found = [list(re.finditer(r"\S+", t)) for t in texts]
            return [([len(m[0]) for m in ms], [m.end() for m in ms]) for ms in found]

        return tokenize

    df = spark.createDataFrame([(0, "a bb  ccc dddd "), (1, "é  "), (2, ""), (3, None)], "id bigint, t string")
    got = rows(df.select("id", encoded_column(load, 3, -1)(F.col("t")).alias("x")).select("id", "x.*"), "id")
    assert got == [
        (0, [1, 2, 3], [1, 1, 1], 4, "a bb  ccc"), (1, [1, -1, -1], [1, 0, 0], 1, "é  "), (2, [-1] * 3, [0] * 3, 0, ""), (3, None, None, None, None)
    ]
    # A model is given what the cap leaves, and identity rows stay whole.
    routed = spark.createDataFrame(
        [(0, "a b c d", True, "m", False), (1, "a b c d", True, "", True), (2, "x", False, "m", False)],
        "id bigint, text string, valid boolean, model string, is_identity boolean",
    )
    done = translate(routed, lambda name: lambda texts: [t.upper() for t in texts], cap=(load, 2))
    assert [r.translation for r in done.orderBy("id").collect()] == ["A B", "a b c d", ""]


def test_tokens_of_a_large_batch_are_held_slice_by_slice(spark):
    """A tokenizer never holds the tokens of a whole Arrow batch; slices give what one call would."""

    def load():
        def run(texts):
            assert sum(map(len, texts)) <= 1 << 18 or len(texts) == 1
            return [([len(w) for w in t.split(" ")], [i + 1 for i in range(len(t.split(" ")))]) for t in texts]

        return run

    text = F.when(F.col("id") % 50 == 7, F.lit(None)).otherwise(F.repeat(F.lit("ab c "), (F.col("id") % 400 + 100).cast("int")))
    df = spark.range(600).select("id", text.alias("t")).coalesce(1)
    got = rows(df.select("id", encoded_column(load, 4, -1)(F.col("t")).alias("x")).select("id", "x.ids", "x.mask", "x.n_tokens", "x.kept"), "id")
    for i, ids, mask, n, kept in got:
        if i % 50 == 7:
            assert ids is mask is n is kept is None
        else:
            assert (ids, mask, n, kept) == ([2, 1, 2, 1], [1] * 4, 2 * (i % 400 + 100) + 1, "ab c")
