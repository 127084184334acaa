"""The registry as streams: upserts by micro-batch, and the latest state of each key with event-time bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, key: list[str], order: str, fields: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Fold a stream of updates into a table of Parquet snapshots: a value that isn't empty replaces the one before.

    A batch is folded first, so the merge joins one row per key. Snapshot n is written once batch n is done, beside the one before; a batch that is
    repeated after a failure starts from the same snapshot and gives the same one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = registry.fold_values(batch, key, order, fields)
        if number == 0:
            out = new
        else:
            out = registry.upsert(batch.sparkSession.read.parquet(f"{path}/snapshot={number - 1}"), new, key)
        out.write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    writer = updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def state_counts(updates: DataFrame, time: str, state: str, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """How many updates of each state fall in each window; windows close when the watermark passes them."""
    return updates.withWatermark(time, delay).groupBy(F.window(time, window), state).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), state, "n")


def first_of_key(updates: DataFrame, time: str, key: list[str], delay: str = "1 day") -> DataFrame:
    """The first update of each key within the watermark: repeated deliveries fall out."""
    return updates.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)
