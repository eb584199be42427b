"""Language to translation model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.language import MIN_EN_PROB
from shardloom.session import broadcast_if_small

# Language codes that have a route; Portuguese uses the default model.
ROUTED = ("zh", "ja", "ru", "es", "fr", "de", "ar", "it", "pt", "ko")
DEFAULT_ROUTED = ("pt",)

# Fixed value: captions per model call.
MICRO_BATCH = 64


def routes(spark: SparkSession, names: dict[str, str] | None = None, default: str = "m_default") -> DataFrame:
    """``lang, model`` with one row per routed language."""
    names = names or {g: default if g in DEFAULT_ROUTED else f"m_{g}" for g in ROUTED}
    return spark.createDataFrame(sorted(names.items()), "lang string, model string")


# Languages of a route table that may be broadcast.
MAX_ROUTES = 10_000


def fold_code(lang: Column) -> Column:
    """Chinese variants share one code."""
    return F.when(lang.startswith("zh"), F.lit("zh")).otherwise(lang)


def route_model(df: DataFrame, table: DataFrame, default: str = "m_default") -> DataFrame:
    """Add ``model`` and ``is_identity`` to ``lang, prob``.

    Confident English stays as it is and has the empty model name. A language that the table lists
    twice goes to its first model by name, so no row is multiplied. The table is broadcast up to a
    counted number of languages.
    """
    identity = (F.col("lang") == "en") & (F.col("prob") >= MIN_EN_PROB)
    lookup = table.groupBy(F.col("lang").alias("__code")).agg(F.min("model").alias("__model"))
    joined = df.withColumn("__fold", fold_code(F.col("lang"))).join(
        broadcast_if_small(lookup, MAX_ROUTES), F.col("__fold") == F.col("__code"), "left"
    )
    return (
        joined.withColumn("is_identity", F.coalesce(identity, F.lit(False)))
        .withColumn("model", F.when(F.col("is_identity"), "").otherwise(F.coalesce("__model", F.lit(default))))
        .drop("__fold", "__code", "__model")
    )


def route_groups(routed: DataFrame, batch: int = MICRO_BATCH) -> DataFrame:
    """``model, n, n_batches`` of the captions that need a model."""
    return (
        routed.filter(~F.col("is_identity"))
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_batches", F.ceil(F.col("n") / batch).cast("bigint"))
    )
