"""Published prefix as a stream: windows may finish in any order.

``prefix_table`` keeps it with built-in functions only, in a table with a row per video. ``prefix_stream`` gives
every growth as a row to any sink; it pays for that with several calls of Python's state server per window.
"""
from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .keyed import KeyedTable


class _Prefix(StatefulProcessor):
    """Keeps what waits beyond a gap; everything up to the gap has been published, and a whole video is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "no BIGINT")
        self.waiting = handle.getMapState("waiting", "no BIGINT", "until_ms BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = self.next.get()[0] if self.next.exists() else 0
        last = None
        for batch in rows:
            if "windows" in batch and batch["windows"].notna().any():
                last = int(batch["windows"].max())
            for no, until in zip(batch["window_no"], batch["until_ms"]):
                if no >= due:
                    self.waiting.updateValue((int(no),), (int(until),))
        ready = None
        while self.waiting.containsKey((due,)):
            ready = self.waiting.getValue((due,))[0]
            self.waiting.removeKey((due,))
            due += 1
        if last is not None and due >= last:
            self.next.clear()
            self.waiting.clear()
        elif ready is not None:
            self.next.update((due,))
        if ready is not None:
            yield pd.DataFrame({"vid": [key[0]], "ready_ms": [ready]})

    def close(self) -> None:
        pass


@contextmanager
def state_on_disk(spark: SparkSession):
    """The state store that ``prefix_stream`` needs, for streams started inside; the session's own is set again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def prefix_stream(finished: DataFrame) -> DataFrame:
    """(vid, ready_ms) each time a video's watchable part grows. finished: vid, window_no, until_ms.

    With a column ``windows``, the number of windows of the video, its state ends with the batch that completes
    it; a window that comes again after that may be published again, so a reader takes the largest ready_ms.
    A repeated window changes nothing before. Needs the RocksDB state store (``state_on_disk``), which also
    keeps the state off the heap.
    """
    vid = finished.schema["vid"].dataType.simpleString()
    return finished.groupBy("vid").transformWithStateInPandas(
        _Prefix(), outputStructType=f"vid {vid}, ready_ms BIGINT", outputMode="Append", timeMode="None")


class PrefixTable(KeyedTable):
    """Per video: ``due``, the first window that is missing, ``ready_ms``, and ``waiting``, what has finished beyond it.

    A row says that all windows before ``due`` have finished, so of rows of one video the largest ``due`` and
    ``ready_ms`` hold, and what waits is put together. A video's row is bounded by the windows that wait for a gap.
    """

    def _winners(self, rows: DataFrame) -> DataFrame:
        both = rows.groupBy("vid").agg(F.max("due").alias("due"), F.max("ready_ms").alias("ready_ms"),
                                       F.array_sort(F.flatten(F.collect_list("waiting"))).alias("waiting"))
        start = F.struct(F.col("due").alias("due"), F.col("ready_ms").alias("ready_ms"))

        def step(acc, w):  # in order of their number; a repeated window is before what is due by then
            return F.when(w["no"] > acc["due"], acc).otherwise(F.struct(
                F.greatest(acc["due"], w["no"] + 1).alias("due"), F.greatest(acc["ready_ms"], w["until_ms"]).alias("ready_ms")))
        moved = both.select("vid", "waiting", F.aggregate("waiting", start, step).alias("_at"))
        return moved.select("vid", F.col("_at.due").alias("due"), F.col("_at.ready_ms").alias("ready_ms"),
                            F.array_distinct(F.filter("waiting", lambda w: w["no"] >= F.col("_at.due"))).alias("waiting"))


def prefix_table(finished: DataFrame, folder: str, *, buckets: int = 16) -> DataFrame:
    """(vid, ready_ms) of every video with a published part, after all the stream has now.

    finished: vid, window_no, until_ms. Windows may come in any order and again.
    """
    vid = finished.schema["vid"].dataType.simpleString()
    schema = StructType.fromDDL(f"vid {vid}, due BIGINT, ready_ms BIGINT, waiting ARRAY<STRUCT<no: BIGINT, until_ms: BIGINT>>")
    one = F.array(F.struct(F.col("window_no").cast("bigint").alias("no"), F.col("until_ms").cast("bigint").alias("until_ms")))
    rows = finished.select("vid", F.lit(0).cast("bigint").alias("due"), F.lit(None).cast("bigint").alias("ready_ms"), one.alias("waiting"))
    table = PrefixTable(finished.sparkSession, f"{folder}/table", schema, ("vid",), (), buckets=buckets)
    return table.run(rows, f"{folder}/state").where("ready_ms IS NOT NULL").select("vid", "ready_ms")
