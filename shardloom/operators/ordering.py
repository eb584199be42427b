"""Positions and running values inside a group without gathering the group in one task.

A plain window over ``partition by run`` puts a whole run into one task. Here the order
is first cut into buckets that grow with it. Each bucket is numbered by itself, and the
bucket totals, a small table, carry the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_key(*columns: Column | str) -> Column:
    """One struct for a composite key. Structs compare with nulls equal, so no group is lost."""
    return F.struct(*columns)


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hint: str | None = None
) -> DataFrame:
    """Equi-join that also matches null keys and keeps one copy of them."""
    others = [c for c in right.columns if c not in keys]
    keyed = right.select(group_key(*keys).alias("__key"), *others)
    if hint:
        keyed = keyed.hint(hint)
    return left.withColumn("__key", group_key(*keys)).join(keyed, "__key", how).drop("__key")


def number_rows(
    df: DataFrame, by: list[str], order: list, bucket: Column, name: str = "row_no", total: str | None = None
) -> DataFrame:
    """1-based position in each group by ``order``, and the group size as ``total`` if named.

    ``bucket`` must never decrease along the order, and should cut a large group into
    pieces that one task can sort. The numbering and the join share one exchange.
    """
    keyed = df.withColumn("__piece", group_key(*by, bucket.alias("__bucket")))
    groups = [F.col("__piece")[c] for c in by]
    before = (
        Window.partitionBy(*groups).orderBy(F.col("__piece")["__bucket"])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        keyed.groupBy("__piece")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            "__piece",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
            *([F.sum("__n").over(Window.partitionBy(*groups)).alias(total)] if total else []),
        )
    )
    inside = Window.partitionBy("__piece").orderBy(*order)
    return (
        keyed.withColumn("__pos", F.row_number().over(inside))
        .join(offsets, "__piece")
        .withColumn(name, (F.col("__offset") + F.col("__pos")).cast("bigint"))
        .drop("__piece", "__offset", "__pos")
    )


def hash_buckets(digest: Column, buckets: int) -> Column:
    """Bucket of a hex digest that grows with the digest, for ``number_rows`` by hash order."""
    head = F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")
    return F.floor(head * F.lit(buckets) / F.lit(float(16**7))).cast("bigint")
