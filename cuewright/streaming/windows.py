"""Growing dubbing windows: 45 s, 90 s, 180 s, then 300 s each."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..operators.batching import batch_no

_EDGES = (45_000, 135_000, 315_000)


def window_no(ms: Column) -> Column:
    """Which window a moment falls in; a closed form of the doubling rule."""
    tail = F.floor((ms - _EDGES[2]) / K.WINDOW_CAP_MS) + 3
    return F.when(ms < _EDGES[0], 0).when(ms < _EDGES[1], 1).when(ms < _EDGES[2], 2).otherwise(tail).cast("bigint")


def window_end(no: Column) -> Column:
    return F.when(no == 0, _EDGES[0]).when(no == 1, _EDGES[1]).when(no == 2, _EDGES[2]) \
        .otherwise(F.lit(_EDGES[2]) + (no - 2) * K.WINDOW_CAP_MS).cast("bigint")


def growing_windows(videos: DataFrame) -> DataFrame:
    """(vid, window_no, from_ms, until_ms); the last window ends with the video."""
    last = window_no(F.col("duration_ms") - 1)
    no = F.col("window_no")
    return videos.where("duration_ms > 0").withColumn("window_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(
        "vid", "window_no", F.when(no == 0, 0).otherwise(window_end(no - 1)).cast("bigint").alias("from_ms"),
        F.least(window_end(no), "duration_ms").alias("until_ms"))


def assign_windows(lines: DataFrame) -> DataFrame:
    """Window of each line by its start; NULL for lines at or past the end of the video."""
    return lines.withColumn("window_no", F.when(F.col("start_ms") < F.col("total_ms"), window_no(F.col("start_ms"))))


def window_batches(lines: DataFrame) -> DataFrame:
    """Batches each window has to translate: those no earlier window needed already."""
    return assign_windows(lines).where("window_no IS NOT NULL") \
        .groupBy("vid", batch_no().alias("batch")).agg(F.min("window_no").alias("window_no"))


def hls_segments(videos: DataFrame, step_ms: int = K.SEGMENT_MS) -> DataFrame:
    """Six-second segment index of every video."""
    n = F.ceil(F.col("duration_ms") / step_ms).cast("bigint")
    seg = F.col("segment")
    return videos.where("duration_ms > 0").withColumn("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))).select(
        "vid", "segment", (seg * step_ms).alias("from_ms"), F.least((seg + 1) * step_ms, "duration_ms").alias("until_ms"))


def ready_prefix(windows: DataFrame) -> DataFrame:
    """How far each video is watchable: only windows finished without a gap count.

    windows: vid, window_no, until_ms, done.
    """
    gaps = windows.groupBy("vid").agg(F.min(F.when(~F.col("done"), F.col("window_no"))).alias("_gap"))
    before = F.col("_gap").isNull() | (F.col("window_no") < F.col("_gap"))
    return windows.join(gaps, "vid").groupBy("vid").agg(
        F.coalesce(F.max(F.when(before, F.col("until_ms"))), F.lit(0).cast("bigint")).alias("ready_ms"),
        F.max("until_ms").alias("duration_ms"), F.every("done").alias("complete"))


def stream_status(prefix: DataFrame) -> DataFrame:
    """{seconds, duration, done} with what a player may do with it."""
    return prefix.select("vid", F.col("ready_ms").alias("ready_ms"), "duration_ms", F.col("complete").alias("done"),
                         (F.col("ready_ms") > 0).alias("playable"), (F.col("ready_ms") >= 5_000).alias("offered"))


def accumulate_stats(windows: DataFrame) -> DataFrame:
    """Totals over the windows of a video; the peak rate is a maximum, the rest are sums."""
    sums = ("lines", "compressed", "crowded", "clipped", "fixed")
    return windows.groupBy("vid").agg(*[F.sum(c).alias(c) for c in sums if c in windows.columns],
                                      F.max("max_rate_milli").alias("max_rate_milli"))


def clamp_percent(value: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(value))).cast("bigint")


def stage_progress(stage: Column, done: Column, total: Column) -> Column:
    """Progress bar of a stage: its base plus its share, clamped to 0..100."""
    share = done / F.greatest(total, F.lit(1))
    return clamp_percent(F.when(stage == "transcribe", share * 30 + 10).when(stage == "speech", share * 20 + 72)
                         .otherwise(share * 50 + 45))
