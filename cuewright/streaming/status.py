"""What a player may do with each video, kept in a table while windows finish."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import prefix_table
from .windows import stream_status


def status_table(finished: DataFrame, videos: DataFrame, folder: str, *, buckets: int = 16) -> DataFrame:
    """A status row for every row of ``videos`` (vid, duration_ms) after all the stream has now.

    finished: vid, window_no, until_ms. A video with nothing published is at 0; it is done when its whole
    duration is published. The published prefix only grows, so the largest one of a video is the last.
    """
    latest = prefix_table(finished, folder, buckets=buckets)
    known = videos.join(latest, "vid", "left")
    at = F.coalesce("ready_ms", F.lit(0).cast("bigint"))
    return stream_status(known.select("vid", at.alias("ready_ms"), "duration_ms", (at >= F.col("duration_ms")).alias("complete")))
