"""Deterministic key hashing for the train/validation split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the split score has six decimals.
SCORE_MOD = 1_000_000


def split_score(key: Column) -> Column:
    """``int(md5(key), 16) mod 10**6 / 10**6`` without big integers.

    The 128-bit digest is folded in four 32-bit steps; a missing key counts as ``''``.
    """
    digest = F.md5(F.coalesce(key, F.lit("")).cast("binary"))
    step = (1 << 32) % SCORE_MOD
    acc = F.lit(0).cast("bigint")
    for i in range(4):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        acc = (acc * F.lit(step) + word) % F.lit(SCORE_MOD)
    return acc / F.lit(float(SCORE_MOD))
