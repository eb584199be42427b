"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.session import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` of every id that a link names; the component is its smallest id.

    Alternates the large-star and small-star steps of the published map-reduce algorithm: every node
    links its larger (then its smaller) neighbours to the smallest id it knows. Each round is one
    grouped minimum and one join, written to the shared folder, so a lost executor costs one
    round at the most and the lineage stays short. The number of rounds grows with the logarithm of the
    number of nodes. Empty links give an empty table; links with a null id or from an id to itself
    say nothing.
    """
    pairs = links.select(
        F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")
    ).filter("u <> v")
    now = materialize(pairs.distinct(), "links")
    while True:
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        small = materialize(_star(large, larger=False), "links")
        if _same(now, small):
            break
        now = small
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots).distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each neighbour of ``u`` that is larger (or not larger) than ``u`` to the smallest id around ``u``.

    The minima are written first. The join then has an exchange of its own on both sides, so
    adaptive execution can split the rows of a ``u`` with very many neighbours.
    """
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = materialize(least, "least")
    joined = edges.join(least, "u")
    if larger:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    others = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.filter("m <> u").select("u", F.col("m").alias("v"))
    return others.unionByName(own).distinct()


def _same(x: DataFrame, y: DataFrame) -> bool:
    """Whether two tables of distinct links are equal, by count and by two sums of hashes."""
    def digest(df: DataFrame):
        return df.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
            F.sum(F.hash("u", "v").cast("bigint")),
        ).first()

    return digest(x) == digest(y)
