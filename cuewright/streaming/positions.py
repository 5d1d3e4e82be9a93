"""Viewing positions as a stream; the last report of each viewer wins."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.library import latest_position
from .keyed import KeyedTable


def latest_position_table(positions: DataFrame, folder: str, *, buckets: int = 16) -> DataFrame:
    """Run the stream to its end into a table with a row per viewer, however many batches there were."""
    table = KeyedTable(positions.sparkSession, f"{folder}/table", positions.schema, ("vid",), ("ts_s", "event_id"), buckets=buckets)
    return latest_position(table.run(positions, f"{folder}/state"))
