"""Pair and submission CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.predict import inside_shape


def write_pairs_csv(coo: DataFrame, path: str) -> None:
    """Non-zero cells as ``row,col`` lines in row-major order across the part files."""
    (
        coo.filter(F.col("value") != 0)
        .select(F.col("image_id").alias("row"), F.col("class_id").alias("col"))
        .orderBy("row", "col")
        .write.csv(path, header=True)
    )


def read_pairs_csv(spark: SparkSession, path: str, num_images: int, num_classes: int) -> DataFrame:
    """Cells with value 1; an id outside the shape fails the job."""
    pairs = spark.read.csv(path, schema="row bigint, col bigint", header=True, mode="FAILFAST")
    cells = pairs.select(F.col("row").alias("image_id"), F.col("col").alias("class_id"))
    return inside_shape(cells, num_images, num_classes).withColumn("value", F.lit(1))


def write_submission(df: DataFrame, path: str) -> None:
    df.select("image_id", "class_ids").orderBy("image_id").write.csv(path, header=True, emptyValue='""')


def read_submission(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Class ids stay text, so ``12`` never turns into a number, and an empty list stays ``''``."""
    df = spark.read.csv(path, schema=f"image_id {id_type}, class_ids string", header=True)
    return df.withColumn("class_ids", F.coalesce("class_ids", F.lit("")))
