"""Epoch evaluation and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.operators.metrics import batch_loss, loss_of_pairs, mean_loss, ranks_of_pairs, retrieval_metrics
from shardloom.operators.runs import PATIENCE, best_epoch, early_stopping, epoch_stats, metric_report, stop_epochs
from shardloom.operators.similarity import joined_pairs
from shardloom.session import materialize


def drop_incomplete(images: DataFrame, size: int) -> DataFrame:
    """Rows of full batches only; the training loss leaves the last partial batch out."""
    full = images.groupBy("batch").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == size)
    return images.join(full.select("batch"), "batch", "left_semi")


def evaluate(
    epoch: int, train: tuple[DataFrame, DataFrame], val: tuple[DataFrame, DataFrame],
    batch_size: int, scale: float, bias: float = 0.0, retrieval: bool = True,
) -> DataFrame:
    """One statistics row. Each side is ``(images id, batch, v)`` and ``(texts id, v)``.

    The validation sides are joined once, for the loss and for the ranks.
    """
    train_loss = mean_loss(batch_loss(drop_incomplete(train[0], batch_size), train[1], scale, bias))
    pairs = materialize(joined_pairs(val[0].select("id", "batch", "v"), val[1]), "pairs")
    val_loss = mean_loss(loss_of_pairs(pairs, scale, bias))
    metrics = retrieval_metrics(ranks_of_pairs(pairs)) if retrieval else None
    return epoch_stats(epoch, train_loss, val_loss, metrics)


def summarize_run(stats: DataFrame, patience: int = PATIENCE, by: str = "run") -> tuple[DataFrame, DataFrame]:
    """Stop epoch per run, and the metric report of its best epoch."""
    return stop_epochs(early_stopping(stats, patience, by), by), metric_report(best_epoch(stats, by), by)
