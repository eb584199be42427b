"""Running loss carried across micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardloom.operators.ordering import join_null_safe
from shardloom.operators.runs import EMA_ALPHA, ema


def stream_ema(
    steps: DataFrame, out_path: str, checkpoint: str, by: str = "run", order: str = "step", value: str = "loss",
    alpha: float = EMA_ALPHA,
) -> StreamingQuery:
    """Smooth a stream of steps into the Parquet table ``by, order, ema``, one folder ``batch=N`` per micro-batch.

    A stretch of steps is a map ``x -> a*x + b`` of the value before it. The steps of a batch are cut into stretches that
    tasks work out on their own, and only the stretches are chained, so a batch may hold any number of steps of one run. Carried over are
    the last step and value of each run, a table beside the checkpoint: batch N reads that of batch N-1 and writes
    the other of two, so a batch that is run again gives the same. A step that is not newer than the run's last one is dropped; so is a
    step without number; of a step that repeats inside a batch the smaller value counts. A null value is an error.
    """
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    state = f"`{by}` {kinds[by]}, `{order}` {kinds[order]}, ema double"
    work = f"{checkpoint.rstrip('/')}-ema"

    def handle(part: DataFrame, batch: int) -> None:
        spark = part.sparkSession

        def stored(path: str, schema=state) -> DataFrame:
            return spark.read.schema(schema).parquet(path)

        last = stored(f"{work}/state-{(batch - 1) % 2}") if batch else spark.createDataFrame([], state)
        new = part.filter(F.col(order).isNotNull()).groupBy(by, order).agg(F.min(value).alias(value))
        met = join_null_safe(new, last.select(by, F.col(order).alias("__last")), [by], "left")
        fresh = met.filter(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).select(by, order, value)
        fresh.write.mode("overwrite").parquet(f"{work}/steps")
        fresh = stored(f"{work}/steps", fresh.schema)
        done = ema(fresh, by, order, value, alpha, start=last.select(by, F.col("ema").alias("smooth")))
        done.select(by, order, "ema").write.mode("overwrite").parquet(f"{out_path}/batch={batch}")
        both = last.unionByName(stored(f"{out_path}/batch={batch}"))
        now = both.groupBy(by).agg(F.max(order).alias(order), F.max_by("ema", order).alias("ema"))
        now.write.mode("overwrite").parquet(f"{work}/state-{batch % 2}")

    return (
        steps.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
