"""Token-bucket state as a stream: one row of state per (key, model)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.batching import bucket_state


def bucket_state_table(requests: DataFrame, folder: str) -> DataFrame:
    """Run a request stream to its end and return the state it leaves.

    The batch aggregation is its own streaming form: every value is a latest-wins
    maximum, so arrival order does not matter and state is bounded by the number
    of configured buckets. Each micro-batch writes one full version; a repeated
    batch overwrites its own.
    """
    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/epoch={epoch}")

    bucket_state(requests).writeStream.outputMode("complete").foreachBatch(publish) \
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    versions = requests.sparkSession.read.parquet(f"{folder}/table")
    last = versions.agg(F.max("epoch")).scalar()
    return versions.where(F.col("epoch") == last).drop("epoch")
