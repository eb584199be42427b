"""Coverage of English captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.captions import english_caption

# Fixed value: examples shown by the coverage report.
EXAMPLES = 10


def caption_coverage(df: DataFrame, json: str = "json", by: str | None = None) -> DataFrame:
    """``total, has_caption_en, ratio``; no ratio for an empty set."""
    flagged = df.withColumn("__hit", english_caption(F.col(json)).isNotNull())
    groups = [by] if by else []
    return flagged.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("__hit").alias("has_caption_en")
    ).withColumn(
        "ratio", F.round(F.col("has_caption_en") / F.nullif(F.col("total"), F.lit(0)), 3)
    )


def translated_examples(df: DataFrame, json: str = "json", n: int = EXAMPLES) -> DataFrame:
    """The first ``n`` samples by url and key that carry an English caption."""
    return (
        df.select("url", "key", english_caption(F.col(json)).alias("caption_en"))
        .filter(F.col("caption_en").isNotNull())
        .orderBy("url", "key")
        .limit(n)
    )
