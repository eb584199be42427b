"""Retrieval quality, contrastive loss and embedding checks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.vectors import bce_logits, l2_norm, l2_normalize, logits
from shardloom.operators.similarity import (
    better_counts, better_counts_of, block_sums, joined_pairs, paired_score, scored_pairs,
)
from shardloom.session import materialize

# Recall cut-offs reported after an epoch.
RECALL_KS = (1, 5, 10)

# Bits of a rank that one pass of the median settles.
DIGIT_BITS = 14

# Name parts of the adapter weights that are audited.
ADAPTER_TAGS = ("lora_a", "lora_b", "lora_up", "lora_down")


def retrieval_ranks(images: DataFrame, texts: DataFrame, **sizes) -> DataFrame:
    """1-based rank of the true match in both directions; ties go to the lowest id."""
    return _ranks(better_counts(images, texts, **sizes))


def ranks_of_pairs(pairs: DataFrame) -> DataFrame:
    """``retrieval_ranks`` of stored pairs ``id, iv, tv``."""
    return _ranks(better_counts_of(scored_pairs(pairs)))


def _ranks(counts: DataFrame) -> DataFrame:
    return counts.select("id", (F.col("i2t") + 1).alias("i2t_rank"), (F.col("t2i") + 1).alias("t2i_rank"))


def lower_medians(df: DataFrame, columns: list[str], bits: int = DIGIT_BITS) -> dict[str, int | None]:
    """The lower median of each column of whole numbers from 0 on; nulls are passed over, None if there is nothing else.

    Selection by digits: a pass counts, for all columns at once, the next digit of the values that begin as the median
    does, which settles that digit. A pass gives at most ``2 ** bits`` counts a column, however many values there
    are, and nothing is sorted. ``df`` is read once for each digit, so it should be stored.
    """
    first = df.agg(*[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(columns) for f in (F.count, F.max)]).first()
    left = {i: (first[f"count{i}"] + 1) // 2 for i in range(len(columns)) if first[f"count{i}"]}
    begins = dict.fromkeys(left, 0)
    shift = -(-max((first[f"max{i}"].bit_length() for i in left), default=0) // bits) * bits
    while left and shift:
        shift -= bits
        digits = F.array(*[
            F.when(
                F.shiftright(F.col(columns[i]), shift + bits) == begins[i],
                F.struct(F.lit(i).alias("column"), F.shiftright(F.col(columns[i]), shift).bitwiseAND(F.lit((1 << bits) - 1)).alias("digit")),
            )
            for i in left
        ])
        counts = df.select(F.explode(F.filter(digits, lambda d: d.isNotNull())).alias("d")).groupBy("d.column", "d.digit").count()
        by_column: dict[int, list[tuple[int, int]]] = {i: [] for i in left}
        for row in counts.collect():
            by_column[row["column"]].append((row["digit"], row["count"]))
        for i, found in by_column.items():
            for digit, n in sorted(found):
                if left[i] <= n:
                    begins[i] = begins[i] << bits | digit
                    break
                left[i] -= n
    return {c: begins.get(i) for i, c in enumerate(columns)}


def retrieval_metrics(ranks: DataFrame, ks: tuple[int, ...] = RECALL_KS) -> DataFrame:
    """One row of recall, mean reciprocal rank and lower median rank per direction.

    The ranks are stored first, as the medians read them once for each digit.
    """
    ranks = materialize(ranks.select("i2t_rank", "t2i_rank"), "ranks")
    medians = lower_medians(ranks, ["i2t_rank", "t2i_rank"])
    aggs = []
    for side in ("i2t", "t2i"):
        rank = F.col(f"{side}_rank")
        aggs += [F.avg((rank <= k).cast("double")).alias(f"{side}_R_at_{k}") for k in ks]
        aggs.append(F.avg(F.lit(1.0) / rank).alias(f"{side}_MRR"))
        aggs.append(F.lit(medians[f"{side}_rank"]).cast("double").alias(f"{side}_MedR"))
    return ranks.agg(*aggs)


def pair_loss(images: DataFrame, texts: DataFrame, logit_scale: float = 0.0, bias: float = 0.0) -> DataFrame:
    """``id, loss``: what the true pair itself adds to the loss, as a per-sample diagnosis; no pairs of others are formed."""
    score = logits(F.col("score"), logit_scale, bias)
    return paired_score(images, texts).select("id", bce_logits(score, F.lit(1.0)).alias("loss"))


def batch_loss(images: DataFrame, texts: DataFrame, scale: float, bias: float = 0.0,
               lane_rows: int = 4096) -> DataFrame:
    """``batch, loss, n``: mean binary cross entropy over all pairs of each batch.

    ``images`` is ``(id, batch, v)``, ``texts`` is ``(id, v)``. The labels are symmetric,
    so both directions have the same mean and one is enough. The sides are joined once.
    """
    paired = materialize(joined_pairs(images.select("id", "batch", "v"), texts), "pairs")
    return loss_of_pairs(paired, scale, bias, lane_rows)


def loss_of_pairs(paired: DataFrame, scale: float, bias: float = 0.0, lane_rows: int = 4096) -> DataFrame:
    """``batch_loss`` of stored pairs ``id, batch, iv, tv``, which are read three times."""

    def kernel(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray) -> float:
        x = scale * (a @ b.T) + bias
        y = (ia[:, None] == ib[None, :]).astype(np.float64)
        return float((np.maximum(x, 0.0) - x * y + np.log1p(np.exp(-np.abs(x)))).sum())

    return block_sums(paired, "batch", kernel, lane_rows).select(
        "batch",
        (F.col("total") / F.col("n_pairs")).alias("loss"),
        F.round(F.sqrt(F.col("n_pairs").cast("double"))).cast("bigint").alias("n"),
    )


def mean_loss(losses: DataFrame) -> DataFrame:
    """Unweighted mean of batch losses, 0.0 when there is no batch."""
    return losses.agg(
        F.coalesce(F.avg("loss"), F.lit(0.0)).alias("mean_loss"), F.count(F.lit(1)).alias("n_batches")
    )


def alignment_check(images: DataFrame, texts: DataFrame, logit_scale: float = 0.0) -> DataFrame:
    """Mean scaled similarity of true pairs and of all other pairs.

    The sum over all pairs equals the product of the two summed vectors, so no pair is
    formed: one pass sums each dimension, and the rest works on one row per dimension.
    """
    pairs = images.select("id", l2_normalize(F.col("v")).alias("iv")).join(
        texts.select("id", l2_normalize(F.col("v")).alias("tv")), "id"
    )
    per_dim = (
        pairs.select(F.posexplode(F.arrays_zip("iv", "tv")).alias("dim", "x"))
        .groupBy("dim")
        .agg(
            F.sum("x.iv").alias("si"),
            F.sum("x.tv").alias("st"),
            F.sum(F.col("x.iv") * F.col("x.tv")).alias("sd"),
            F.count(F.lit(1)).alias("n"),
        )
    )
    scale = F.lit(math.exp(logit_scale))
    n = F.max("n").cast("double")
    diag, total = F.sum("sd") * scale, F.sum(F.col("si") * F.col("st")) * scale
    return per_dim.agg(
        (diag / n).alias("diag"),
        F.when(n >= 2, (total - diag) / (n * (n - 1))).alias("off"),
    )


def vector_audit(df: DataFrame, tags: tuple[str, ...] = ADAPTER_TAGS) -> DataFrame:
    """``name, norm, is_zero`` of the vectors whose name holds any tag, in any letter case."""
    lowered = F.lower("name")
    hit = F.lit(False)
    for tag in tags:
        hit = hit | lowered.contains(tag.lower())
    return df.filter(hit).select(
        "name", l2_norm(F.col("features")).alias("norm")
    ).withColumn("is_zero", F.col("norm") == 0)


def audit_summary(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("n_vectors"), F.count_if("is_zero").alias("n_zero")
    )
