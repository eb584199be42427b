import itertools
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import metrics, predict, similarity
from tests.conftest import rows

FORMS = [{}, {"resident_bytes": 0}, {"resident_bytes": 0, "lane_bytes": 200}]


def frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id bigint, v array<double>").repartition(parts)


def sims(a, b):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]
    return np.round(unit(np.asarray(a, float)) @ unit(np.asarray(b, float)).T, 9)


def brute_ranks(a, b):
    s, n = sims(a, b), len(a)
    better = lambda row, i: 1 + sum(row[j] > row[i] or (row[j] == row[i] and j < i) for j in range(n) if j != i)
    return [(i, better(s[i], i), better(s[:, i], i)) for i in range(n)]


def cases():
    rng = np.random.default_rng(3)
    eye = np.eye(4)
    return {
        "identity": (eye, eye), "reversed": (eye, eye[::-1]), "ties": (np.ones((5, 3)), np.ones((5, 3))),
        "zero": (np.vstack([eye[:3], np.zeros(4)]), eye), "one": (np.ones((1, 2)), np.ones((1, 2))),
        "random": (rng.normal(size=(61, 7)), rng.normal(size=(61, 7))),
        "copies": (np.repeat(rng.normal(size=(4, 3)), 6, axis=0), np.repeat(rng.normal(size=(4, 3)), 6, axis=0)),
    }


@pytest.mark.parametrize("name,form", list(itertools.product(cases(), range(3))))
def test_ranks_against_brute_force(spark, name, form):
    a, b = cases()[name]
    got = rows(metrics.retrieval_ranks(frame(spark, a), frame(spark, b), **FORMS[form]), "id")
    assert got == brute_ranks(a, b)


@pytest.mark.parametrize("name,form", list(itertools.product(cases(), range(3))))
def test_topk_against_brute_force(spark, name, form):
    a, b = cases()[name]
    k, s = 3, sims(a, b)
    got = rows(similarity.topk(frame(spark, a), frame(spark, b), k, **FORMS[form]), "image_id", "rank")
    want = []
    for i, row in enumerate(s):
        order = sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]
        want += [(i, r + 1, j, row[j]) for r, j in enumerate(order)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_tiles_do_not_change_topk(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (30, 4)).astype(float), rng.integers(0, 3, (200, 4)).astype(float)
    ids = np.arange(200)
    want = similarity.block_topk(a, b, ids, 5)
    for size in (7, 25, 64):
        monkeypatch.setattr(similarity.tiles, "__defaults__", (size,))
        got = similarity.block_topk(a, b, ids, 5)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_top1_is_first_of_topk(spark):
    a, b = cases()["random"]
    top = predict.predict_topk(frame(spark, a), frame(spark, b), 5)
    first = rows(top.filter("rank = 1").select("image_id", "caption_id"), "image_id")
    assert first == rows(predict.predict_top1(frame(spark, a), frame(spark, b)).select("image_id", "caption_id"), "image_id")


def test_metrics_and_lower_median(spark):
    df = spark.createDataFrame([(0, 1, 4), (1, 2, 1), (2, 8, 1), (3, 20, 1)], "id bigint, i2t_rank bigint, t2i_rank bigint")
    m = metrics.retrieval_metrics(df).first().asDict()
    assert m["i2t_MedR"] == 2.0 and m["t2i_MedR"] == 1.0
    assert m["i2t_R_at_1"] == 0.25 and m["i2t_R_at_5"] == 0.5 and m["i2t_R_at_10"] == 0.75
    assert math.isclose(m["i2t_MRR"], (1 + 1 / 2 + 1 / 8 + 1 / 20) / 4)


def brute_loss(a, b, scale, bias):
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    x = scale * unit(a) @ unit(b).T + bias
    y = np.eye(len(a))
    both = [np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))) for z in (x, x.T)]
    assert math.isclose(*both)
    return sum(both) / 2


@pytest.mark.parametrize("lane_rows", [4096, 5])
def test_batch_loss_in_both_directions(spark, lane_rows):
    a, b = cases()["random"]
    images = frame(spark, a).withColumn("batch", F.floor(F.col("id") / 16).cast("bigint"))
    got = rows(metrics.batch_loss(images, frame(spark, b), 10.0, -10.0, lane_rows), "batch")
    for batch, loss, n in got:
        part = slice(16 * batch, 16 * batch + 16)
        assert n == len(a[part]) and math.isclose(loss, brute_loss(a[part], b[part], 10.0, -10.0), rel_tol=1e-9)
    assert len(got) == 4


def test_mean_loss_of_nothing(spark):
    assert tuple(metrics.mean_loss(spark.createDataFrame([], "batch bigint, loss double")).first()) == (0.0, 0)


def test_alignment(spark):
    a, b = cases()["random"]
    s, n = sims(a, b) * math.exp(1.5), 61
    diag, off = metrics.alignment_check(frame(spark, a), frame(spark, b), 1.5).first()
    assert math.isclose(diag, np.trace(s) / n, abs_tol=1e-6)
    assert math.isclose(off, (s.sum() - np.trace(s)) / (n * (n - 1)), abs_tol=1e-6)
    one = frame(spark, np.ones((1, 2)))
    assert metrics.alignment_check(one, one).first().off is None


def test_vector_audit(spark):
    df = spark.createDataFrame(
        [("x.Lora_A.w", [3.0, 4.0]), ("x.LORA_DOWN", [0.0, 0.0]), ("x.weight", [1.0])], "name string, features array<float>"
    )
    audit = metrics.vector_audit(df)
    assert rows(audit, "name") == [("x.LORA_DOWN", 0.0, True), ("x.Lora_A.w", 5.0, False)]
    assert tuple(metrics.audit_summary(audit).first()) == (2, 1)


def test_large_side_never_crosses_without_a_key(spark):
    a, b = cases()["random"]
    df = similarity.topk(frame(spark, a), frame(spark, b), 3, resident_bytes=0)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_odd_vectors_are_left_out_or_refused(spark):
    import pyarrow as pa
    import pytest

    from shardloom.operators.similarity import topk, unit_rows

    with pytest.raises(ValueError, match="null"):
        unit_rows(pa.array([[1.0, 0.0], None]))
    with pytest.raises(ValueError, match="lengths"):
        unit_rows(pa.array([[1.0, 0.0], [1.0], [1.0]]))
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 1.0])], "id bigint, v array<double>")
    got = {(r.image_id, r.caption_id) for r in topk(df, df, 1).collect()}
    assert got == {(0, 0), (2, 2)} == {(r.image_id, r.caption_id) for r in topk(df, df, 1, resident_bytes=0).collect()}


@pytest.mark.parametrize("bits", [1, 3, 14])
@pytest.mark.parametrize("values", [[5], [1, 1, 1], [4, None, 2, 9], [0, 7, 7, 8, 8, 100], [None], [], [2**40, 3, 2**41, 2**40 + 1]])
def test_lower_medians(spark, values, bits):
    df = spark.createDataFrame([(v, None if v is None else 2 * v) for v in values], "a long, b long")
    known = sorted(v for v in values if v is not None)
    want = known[(len(known) - 1) // 2] if known else None
    assert metrics.lower_medians(df, ["a", "b"], bits) == {"a": want, "b": None if want is None else 2 * want}


def test_medians_of_many_ranks(spark):
    """A million distinct ranks, one side reversed and one skewed: three passes of few counts each."""
    n = 1_000_001
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("i2t_rank"), F.when(F.col("id") % 3 == 0, F.col("id") + 1).otherwise(1).alias("t2i_rank"))
    assert metrics.lower_medians(df, ["i2t_rank", "t2i_rank"], 8) == {"i2t_rank": (n + 1) // 2, "t2i_rank": 1}
    row = metrics.retrieval_metrics(df).first()
    assert row["i2t_MedR"] == (n + 1) // 2 and row["t2i_MedR"] == 1.0


def test_topk_holds_one_tile_of_scores():
    """Memory does not grow with the images of a block."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(12_000, 3)), rng.normal(size=(3_000, 3))
    tracemalloc.start()
    similarity.block_topk(a, b, np.arange(3_000), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_ranks_hold_one_tile_of_scores():
    rng = np.random.default_rng(4)
    a, b, p = rng.normal(size=(4_096, 3)), rng.normal(size=(4_096, 3)), rng.normal(size=4_096)
    tracemalloc.start()
    similarity.block_better(a, np.arange(4_096), p, b, np.arange(4_096), p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_topk_of_ties_sorts_a_row_once(monkeypatch):
    """A later text that ties with the k-th best changes nothing, so its tile is not sorted."""
    sorted_rows, best = [], similarity.best_k

    def counted(ids, scores, k):
        sorted_rows.append(len(scores))
        return best(ids, scores, k)

    monkeypatch.setattr(similarity, "best_k", counted)
    a, b = np.tile([[0.6, 0.8]], (300, 1)), np.tile([[0.6, 0.8], [0.8, 0.6]], (10_000, 1))
    ids, scores = similarity.block_topk(a, b, np.arange(20_000), 3)
    assert (ids == [0, 2, 4]).all() and (scores == 1).all()
    assert sum(sorted_rows) == 300


def test_topk_sees_a_better_text_in_a_late_tile_and_nan():
    a, b = np.array([[1.0, 0.0], [0.0, 1.0]]), np.tile([[0.6, 0.8]], (9_000, 1))
    b[8_000], b[100] = [1.0, 0.0], [np.nan, 0.0]
    ids, scores = similarity.block_topk(a, b, np.arange(9_000), 2)
    assert ids.tolist() == [[8_000, 0], [0, 1]] and scores.tolist() == [[1.0, 0.6], [0.8, 0.8]]
    ids, scores = similarity.block_topk(a[:0], b, np.arange(9_000), 2)
    assert ids.shape == scores.shape == (0, 2)


def test_few_stored_images_use_every_core(spark):
    """Small vectors lie in one file, but their products with all texts are not one task's work."""
    rng = np.random.default_rng(5)
    found = similarity.topk(frame(spark, rng.normal(size=(40, 3)), 1), frame(spark, rng.normal(size=(40, 3)), 1), 3)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
