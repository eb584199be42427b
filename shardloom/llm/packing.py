"""Length buckets with the least padding, and batches of a token budget inside each bucket.

Documents longer than the context are cut into whole contexts and a rest, so piece lengths run from 1 to the
context. The histogram of all piece lengths is one small grouped count. Dynamic programming over it finds the bucket
boundaries with the least total padding. A batch takes pieces of one bucket, padded to its boundary, up to
the budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.operators.ordering import number_rows
from shardloom.session import materialize

CONTEXT, BUCKETS, TOKEN_BUDGET = 4096, 16, 65_536
# Pieces that one task numbers at a time, about.
SLOT_ROWS = 20_000


def word_tokens(text: str = "text") -> Column:
    """Tokens of a document counted as words between blanks, and one for its end. A null text has the end only."""
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")) + 1).cast("bigint")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` length ranges with the least padding, the longest length last.

    ``lengths`` are distinct and ascending. The cost of a range is its end times its pieces, less their
    tokens. Costs of ranges obey the quadrangle inequality, so the best last cut never moves back as
    the end grows, and each layer is solved by halving. Of equally good cuts the shortest is taken.
    """
    n = len(lengths)
    if not n:
        return []
    pieces = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    cost = lengths.astype(np.int64) * pieces[1:]  # one range up to each end, tokens left out as they are the same
    cuts: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        after, cut = cost.copy(), np.full(n, -1, np.int64)  # -1: no further range is any better
        spans = [(1, n - 1, 0, n - 2)]
        while spans:
            lo, hi, first, last = spans.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            tries = np.arange(first, min(mid - 1, last) + 1)
            value = cost[tries] + lengths[mid] * (pieces[mid + 1] - pieces[tries + 1])
            best = int(np.argmin(value))
            if value[best] < after[mid]:
                after[mid], cut[mid] = value[best], tries[best]
            spans += [(lo, mid - 1, first, int(tries[best])), (mid + 1, hi, int(tries[best]), last)]
        cuts.append(cut)
        cost = after
    ends, at = [n - 1], n - 1
    for cut in reversed(cuts):
        if cut[at] >= 0:
            at = int(cut[at])
            ends.append(at)
    return [int(lengths[i]) for i in reversed(ends)]


def pieces(docs: DataFrame, tokens: Column, context: int = CONTEXT) -> DataFrame:
    """``doc_id, piece, start, n_tokens``: each document as whole contexts and a rest."""
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / context)))
    start = F.col("piece") * context
    return (
        docs.select("doc_id", F.greatest(tokens, F.lit(1)).alias("total")).select("doc_id", "total", cut.alias("piece"))
        .select(
            "doc_id", "piece", start.alias("start"),
            F.least(F.lit(context).cast("bigint"), F.col("total") - start).alias("n_tokens"),
        )
    )


def pack(
    docs: DataFrame, tokens: Column | None = None, context: int = CONTEXT, buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """``doc_id, piece, start, n_tokens, bucket, batch, slot, padding`` of every piece of every row.

    ``bucket`` is the padded length of the piece's bucket, ``batch`` numbers the batches of a bucket from 0 and
    ``slot`` the pieces of a batch from 0. A batch of bucket ``b`` has ``max(1, budget // b)`` pieces; only the
    last of each bucket may have fewer. Pieces follow a hash of document and piece, so a batch mixes
    sources. Rows that repeat an id and a piece number are packed each; which comes first among equal ones is
    immaterial, as they have the same length, or else follows the length. No rows give no batches.
    """
    cut = materialize(pieces(docs, word_tokens() if tokens is None else tokens, context), "pieces")
    histogram = cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("n_tokens")
    ends = best_boundaries(histogram["n_tokens"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets)
    total = int(histogram["n"].sum())
    # The smallest boundary that holds the piece; the boundaries are as few as the buckets.
    bucket = F.lit(ends[-1] if ends else 1)
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col("n_tokens") <= end, end).otherwise(bucket)
    slots = max(1, -(-total // SLOT_ROWS))
    keyed = cut.withColumn("bucket", bucket.cast("bigint")).withColumn("__order", F.xxhash64("doc_id", "piece"))
    # Slots cut the hash order, so they grow with it.
    high = F.shiftright("__order", 33) + F.lit(1 << 30)
    slot = F.floor(high * F.lit(slots) / F.lit(float(1 << 31))).cast("bigint")
    numbered = number_rows(keyed, ["bucket"], ["__order", "doc_id", "piece", "n_tokens"], slot)
    place, size = F.col("row_no") - 1, F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    return numbered.select(
        "doc_id", "piece", "start", "n_tokens", "bucket",
        F.floor(place / size).cast("bigint").alias("batch"), (place % size).cast("bigint").alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"),
    )
