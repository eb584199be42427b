"""Histories of training runs: early stopping, best epoch, smoothed loss, retention."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.operators.ordering import group_key, join_null_safe
from shardloom.session import materialize

# Fixed value: epochs without improvement before training stops.
PATIENCE = 5

# Weight of the newest loss, and the step distance of log lines.
EMA_ALPHA = 0.1
LOG_EVERY = 50

# Report lines of the best epoch, in print order.
REPORT = (
    ("val_loss", "val_loss"),
    ("i2t_MRR", "i2t_MRR"), ("t2i_MRR", "t2i_MRR"),
    ("i2t_MedR", "i2t_MedR"), ("t2i_MedR", "t2i_MedR"),
    ("i2t_R@1", "i2t_R_at_1"), ("t2i_R@1", "t2i_R_at_1"),
    ("i2t_R@5", "i2t_R_at_5"), ("t2i_R@5", "t2i_R_at_5"),
    ("i2t_R@10", "i2t_R_at_10"), ("t2i_R@10", "t2i_R_at_10"),
)

# Rows of one run that a task handles together; longer runs are cut and carried over.
CHUNK = 4096


def _chunk(by: str, order: str, size: int) -> Column:
    """A run's key together with the piece of it that ``order`` falls into."""
    piece = F.floor(F.col(order) / F.lit(size)).cast("bigint")
    return group_key(F.col(by).alias("run"), piece.alias("piece"))


def early_stopping(
    stats: DataFrame,
    patience: int = PATIENCE,
    by: str = "run",
    epoch: str = "epoch",
    loss: str = "val_loss",
    initial_best: float | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """History plus ``best_loss``, ``bad_epochs`` and ``stop_epoch``.

    ``bad_epochs`` counts the rows since the loss last fell below the best one before it;
    an equal, null or NaN loss is no improvement. ``stop_epoch`` is the first epoch at
    which the count reaches ``patience``. A long run is scanned in chunks of consecutive
    epochs; chunk summaries carry the best loss and its position onwards. The history is worked out once
    and stored, as rows, summaries and stops all come from it.
    """
    start = F.lit(float("inf") if initial_best is None else float(initial_best))
    value = F.when(~F.isnan(loss), F.col(loss))
    rows = stats.withColumn("__chunk", _chunk(by, epoch, chunk)).withColumn("__v", value)
    inside = Window.partitionBy("__chunk").orderBy(epoch)
    rows = materialize(rows.withColumn("__p", F.row_number().over(inside)).withColumn(
        "__low", F.min("__v").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ), "history")

    before = (
        Window.partitionBy("__chunk.run").orderBy("__chunk.piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    summary = rows.groupBy("__chunk").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("__v").alias("__min"),
        F.min(F.when(F.col("__v").isNotNull(), F.struct("__v", "__p")))["__p"].alias("__at"),
    )
    summary = summary.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn(
        "__best", F.least(start, F.coalesce(F.min("__min").over(before), start))
    )
    last = F.when(F.col("__min") < F.col("__best"), F.col("__offset") + F.col("__at"))
    summary = summary.withColumn("__last", last).withColumn(
        "__carry", F.coalesce(F.max("__last").over(before), F.lit(0))
    )

    joined = rows.join(summary.select("__chunk", "__offset", "__best", "__carry"), "__chunk")
    prior = F.least(F.col("__best"), F.coalesce("__low", start))
    pos = F.col("__offset") + F.col("__p")
    hit = F.when(F.col("__v") < prior, pos)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = joined.withColumn("best_loss", F.least(prior, F.coalesce("__v", prior))).withColumn(
        "bad_epochs", (pos - F.coalesce(F.max(hit).over(upto), F.col("__carry"))).cast("bigint")
    )
    scanned = materialize(
        scanned.drop("__chunk", "__v", "__p", "__low", "__offset", "__best", "__carry"), "scanned"
    )
    stops = scanned.groupBy(by).agg(
        F.min(F.when(F.col("bad_epochs") >= patience, F.col(epoch))).alias("stop_epoch")
    )
    return join_null_safe(scanned, stops, [by])


def stop_epochs(scanned: DataFrame, by: str = "run") -> DataFrame:
    """One row per run: stop epoch, or null when patience never ran out."""
    return scanned.groupBy(by).agg(F.max("stop_epoch").alias("stop_epoch"))


def best_epoch(stats: DataFrame, by: str = "run", epoch: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """The whole row with the first minimum of the loss, one per run."""
    known = stats.filter(F.col(loss).isNotNull())
    row = F.struct(*[c for c in stats.columns if c != by])
    return known.groupBy(by).agg(F.min_by(row, F.struct(loss, epoch)).alias("r")).select(by, "r.*")


def metric_report(best: DataFrame, by: str = "run", epoch: str = "epoch") -> DataFrame:
    """``run, epoch, metric, value`` lines; a metric the history lacks reads NaN."""
    nan = F.lit(float("nan"))
    wide = best.select(
        by, epoch,
        *[
            (F.coalesce(F.col(c).cast("double"), nan) if c in best.columns else nan).alias(name)
            for name, c in REPORT
        ],
    )
    return wide.unpivot([by, epoch], [f"`{name}`" for name, _ in REPORT], "metric", "value")


def epoch_stats(epoch: int, train_loss: DataFrame, val_loss: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One wide row from one-row results, joined on the epoch number."""
    number = F.lit(epoch).alias("epoch")
    out = train_loss.select(number, F.col("mean_loss").alias("train_loss")).join(
        val_loss.select(number, F.col("mean_loss").alias("val_loss")), "epoch"
    )
    return out if metrics is None else out.join(metrics.select(number, "*"), "epoch")


def ema(
    df: DataFrame, by: str, order: str, value: str, alpha: float = EMA_ALPHA, name: str = "ema",
    chunk: int = CHUNK, start: DataFrame | None = None,
) -> DataFrame:
    """Running smoothed value per step: the first as it is, then ``(1-a)*old + a*new``.

    ``start`` (``by, smooth``, a row per run) holds what runs had come to before; these go on from there.

    Inside a chunk the recurrence is a weighted running sum. The chunk length keeps the
    weights far from overflow. Chunk ends are chained on a table with one row per chunk. A null value
    is an error, as no smoothed value follows from it.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie in (0, 1)")
    w = 1.0 - alpha
    size = max(1, min(chunk, int(460.0 / -math.log(w))))
    inside = Window.partitionBy("__chunk").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    decay = F.pow(F.lit(w), F.col("__p").cast("double"))
    df = df.withColumn(value, F.coalesce(value, F.raise_error(F.lit(f"null in {value}")).cast(df.schema[value].dataType)))
    rows = (
        df.withColumn("__chunk", _chunk(by, order, size))
        .withColumn("__p", F.row_number().over(inside))
        .withColumn("__inc", decay * F.sum(F.lit(alpha) * F.col(value) / decay).over(upto))
    )
    ends = rows.groupBy("__chunk").agg(
        F.max("__p").alias("n"),
        F.max_by("__inc", "__p").alias("inc"),
        F.min_by(F.col(value).cast("double"), "__p").alias("first"),
    )

    ends = ends.select("__chunk.run", "__chunk.piece", "n", "inc", "first")
    if start is None:
        ends = ends.withColumns({"smooth": F.lit(0.0), "on": F.lit(False)})
    else:
        earlier = start.select(F.col(by).alias("run"), F.col("smooth").cast("double").alias("smooth"), F.lit(True).alias("on"))
        ends = join_null_safe(ends, earlier, ["run"], "left").withColumn("on", F.coalesce("on", F.lit(False)))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        carry, out = float(pdf["smooth" if pdf["on"].iloc[0] else "first"].iloc[0]), []
        for n, inc in zip(pdf["n"], pdf["inc"]):
            out.append(carry)
            carry = w**n * carry + inc
        return pdf[["run", "piece"]].assign(__carry=out)

    key_type = df.schema[by].dataType.simpleString()
    carried = ends.groupBy("run").applyInPandas(chain, f"run {key_type}, piece bigint, __carry double")
    carried = carried.select(group_key("run", "piece").alias("__chunk"), "__carry")
    return (
        rows.join(carried, "__chunk")
        .withColumn(name, decay * F.col("__carry") + F.col("__inc"))
        .drop("__chunk", "__p", "__inc", "__carry")
    )


def every_nth(df: DataFrame, step: str = "step", n: int = LOG_EVERY, max_steps: int | None = None) -> DataFrame:
    """Rows whose 1-based step number is a multiple of ``n``; ``step`` counts from 0."""
    kept = df.filter((F.col(step) + 1) % n == 0)
    return kept if max_steps is None else kept.filter(F.col(step) < max_steps)


def epoch_manifest(paths: DataFrame, path: str = "path") -> DataFrame:
    """Entries named ``epoch<digits>`` with their number as ``epoch``."""
    base = F.element_at(F.split(F.rtrim(F.col(path), F.lit("/")), "/"), -1)
    digits = F.regexp_extract(base, "^epoch([0-9]+)$", 1)
    return paths.withColumn("epoch", F.nullif(digits, F.lit("")).cast("bigint")).filter(
        F.col("epoch").isNotNull()
    )


def retention_plan(manifest: DataFrame, mode: str = "all", epoch: int | None = None, by: str = "run") -> DataFrame:
    """Manifest plus ``keep``. Nothing is deleted."""
    if mode == "all":
        return manifest.withColumn("keep", F.lit(False))
    if mode == "epoch":
        if epoch is None:
            raise ValueError("mode 'epoch' needs an epoch number")
        return manifest.withColumn("keep", F.col("epoch") != epoch)
    if mode == "keep_latest":
        latest = manifest.groupBy(by).agg(F.max("epoch").alias("__latest"))
        return (
            join_null_safe(manifest, latest, [by])
            .withColumn("keep", F.col("epoch") == F.col("__latest"))
            .drop("__latest")
        )
    raise ValueError(f"unknown retention mode: {mode}")
