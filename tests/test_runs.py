import math

import pytest
from pyspark.sql import functions as F

from shardloom.operators import runs
from shardloom.operators.ordering import number_rows
from tests.conftest import rows

NAN = float("nan")
HISTORIES = {
    "falling": [5.0, 4.0, 3.0, 2.0], "equal": [3.0] * 7, "nan": [3.0, NAN, 2.0, NAN, NAN, NAN],
    "tie": [4.0, 2.0, 3.0, 2.0, 3.0, 3.0], "one": [1.0], "null": [2.0, None, 1.0, None, None],
    "zigzag": [float(abs((i * 37) % 11 - 5)) + 10 / (i + 1) for i in range(40)],
}


def stopping(losses, patience, best=math.inf):
    out, count, stop = [], 0, None
    for epoch, x in enumerate(losses):
        if x is not None and not math.isnan(x) and x < best:
            best, count = x, 0
        else:
            count += 1
        if stop is None and count >= patience:
            stop = epoch
        out.append((epoch, best, count))
    return out, stop


def history(spark):
    data = [(r, i, x) for r, xs in HISTORIES.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(data, "run string, epoch int, val_loss double").repartition(3)


@pytest.mark.parametrize("chunk,best", [(4096, None), (3, None), (1, None), (3, 2.5)])
def test_early_stopping_equals_the_loop(spark, chunk, best):
    got = runs.early_stopping(history(spark), 3, initial_best=best, chunk=chunk)
    table = {}
    for run, epoch, _, low, bad, stop in rows(got, "run", "epoch"):
        table.setdefault(run, []).append((epoch, low, bad, stop))
    assert set(table) == set(HISTORIES)
    for run, losses in HISTORIES.items():
        want, stop = stopping(losses, 3, math.inf if best is None else best)
        assert [t[:3] for t in table[run]] == want
        assert {t[3] for t in table[run]} == {stop}


def test_empty_history(spark):
    none = history(spark).filter("false")
    assert rows(runs.early_stopping(none)) == [] and rows(runs.best_epoch(none)) == []
    assert rows(runs.metric_report(runs.best_epoch(none))) == []


def test_best_epoch_first_wins(spark):
    got = {r: (e, v) for r, e, v in rows(runs.best_epoch(history(spark)))}
    assert got["tie"] == (1, 2.0) and got["nan"] == (2, 2.0) and got["equal"] == (0, 3.0) and got["null"] == (2, 1.0)


def test_metric_report_reads_nan_for_what_is_missing(spark):
    df = spark.createDataFrame([("r", 3, 0.5, 0.25)], "run string, epoch int, val_loss double, `i2t_R_at_1` double")
    got = {m: v for _, _, m, v in rows(runs.metric_report(df))}
    assert got["val_loss"] == 0.5 and got["i2t_R@1"] == 0.25 and math.isnan(got["t2i_MedR"]) and len(got) == 11


@pytest.mark.parametrize("chunk,alpha", [(4096, 0.1), (4, 0.1), (1, 0.1), (7, 0.5), (4096, 0.999)])
def test_ema_equals_the_loop(spark, chunk, alpha):
    series = {"a": [float((i * 7) % 13) for i in range(50)], "b": [2.0], "c": [1.0, 2.0, 3.0]}
    data = [(r, i, x) for r, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(data, "run string, step bigint, loss double").repartition(4)
    got = {}
    for run, step, ema in rows(runs.ema(df, "run", "step", "loss", alpha, chunk=chunk).select("run", "step", "ema"), "run", "step"):
        got.setdefault(run, []).append(ema)
    for run, xs in series.items():
        want = [xs[0]]
        for x in xs[1:]:
            want.append((1 - alpha) * want[-1] + alpha * x)
        assert got[run] == pytest.approx(want, rel=1e-9)
    if alpha == 0.1:
        assert got["c"][-1] == pytest.approx(1.29)


def test_every_nth(spark):
    df = spark.range(200).withColumnRenamed("id", "step")
    assert [r[0] for r in rows(runs.every_nth(df, n=50), "step")] == [49, 99, 149, 199]
    assert [r[0] for r in rows(runs.every_nth(df, n=50, max_steps=100), "step")] == [49, 99]


def test_manifest_and_retention(spark):
    names = ["epoch1", "epoch10", "epoch2", "epoch", "epoch3b", "best", "epoch007", "xepoch4"]
    df = spark.createDataFrame([("r", f"/c/{n}") for n in names] + [(None, "/d/epoch5/")], "run string, path string")
    found = runs.epoch_manifest(df)
    assert sorted(r.epoch for r in found.collect()) == [1, 2, 5, 7, 10]
    keep = lambda mode, e=None: {r.epoch for r in runs.retention_plan(found, mode, e).filter("keep").collect()}
    assert keep("all") == set() and keep("epoch", 7) == {1, 2, 5, 10} and keep("keep_latest") == {5, 10}
    assert keep("epoch", 99) == {1, 2, 5, 7, 10}
    with pytest.raises(ValueError):
        runs.retention_plan(found, "other")
    with pytest.raises(ValueError):
        runs.retention_plan(found, "epoch")


def test_numbering_with_null_groups_and_hot_group(spark):
    data = [("hot" if i % 3 else (None if i % 2 else "cold"), i) for i in range(300)]
    df = spark.createDataFrame(data, "g string, x bigint").repartition(5)
    got = rows(number_rows(df, ["g"], ["x"], F.floor(F.col("x") / 10), "no", "n").select("g", "x", "no", "n"))
    for group in ("hot", "cold", None):
        want = sorted(x for g, x in data if g == group)
        assert sorted((x, no, n) for g, x, no, n in got if g == group) == [(x, i + 1, len(want)) for i, x in enumerate(want)]
