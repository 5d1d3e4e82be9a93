"""Places of rows within their key by sample sort.

Rows are range partitioned by key and order, so a key of any size spreads over tasks and nothing is
assumed about gaps or ties in the order. Each task numbers the runs of its sorted rows; only the
first and last run of a task can belong to a key that goes on next door, so the prefix sums run
over two rows a task.
"""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _changes(columns: list[pa.Array], last: tuple | None) -> np.ndarray:
    """Whether each row's key differs from the row before; ``last``: the key before the batch."""
    n = len(columns[0])
    changed = np.zeros(n, bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        same = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.fill_null(pc.equal(a, b), False),
                          pc.and_(pc.is_null(a), pc.is_null(b)))
        changed[1:] |= ~np.asarray(same)
    changed[0] = last is None or last != tuple(c[0].as_py() for c in columns)
    return changed


def _number(keys: tuple[str, ...], name: str):
    def run(batches):
        part, last, before, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k) for k in keys]
            changed = _changes(columns, last)
            starts = np.flatnonzero(changed)
            at = np.arange(n) - np.r_[0, starts][np.cumsum(changed)]
            head = np.cumsum(changed) == 0
            at[head] += before
            opening = np.zeros(n, bool)
            if first:  # the task's first run: all rows up to its second key
                second = starts[1] if last is None and len(starts) > 1 else starts[0] if last is not None and len(starts) else n
                opening[:second] = True
                first = second == n
            before, last = int(at[-1]) + 1, tuple(c[n - 1].as_py() for c in columns)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at), pa.array(opening)],
                [*batch.schema.names, "_part", name, "_opening"])
    return run


def ranked(df: DataFrame, name: str, order: tuple[str | Column, ...], *, keys: tuple[str, ...] = ("vid",),
           keep: Callable[[DataFrame], DataFrame], partitions: int | None = None) -> DataFrame:
    """Add ``name``, the place 0..n-1 of every row within its key by ``order``.

    Rows that tie in ``order`` get different places, in no particular order; a NULL key is a key.
    ``keep`` writes the sorted rows once (a checkpoint or a table), as they are read twice.
    """
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    spread = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = keep(spread.sortWithinPartitions(*by).mapInArrow(
        _number(keys, name), f"{schema}, _part int, `{name}` bigint, _opening boolean"))
    # first and last run of every task: two rows a task, whatever the table's size
    key = F.struct(*[F.col(k) for k in keys])
    ends = rows.groupBy("_part").agg(
        F.min_by(key, F.struct(~F.col("_opening"), F.col(name))).alias("head"), F.sum(F.col("_opening").cast("bigint")).alias("opened"),
        F.count(F.lit(1)).alias("rows"), F.max(F.struct(*by, name)).alias("tail"))
    runs = ends.select("_part", "head", F.col("opened").alias("n"), F.lit(True).alias("opens")).unionAll(
        ends.where("opened < rows").select("_part", F.struct(*[F.col(f"tail.{k}").alias(k) for k in keys]),
                                           F.col(f"tail.{name}") + 1, F.lit(False)))
    w = Window.partitionBy("head").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.withColumn("base", F.sum("n").over(w)).where("opens AND base > 0").select("_part", "base")
    # at most one row of twelve bytes a task: a bounded broadcast
    out = rows.join(F.broadcast(bases), "_part", "left")
    place = F.col(name) + F.when(F.col("_opening"), F.coalesce("base", F.lit(0))).otherwise(0)
    return out.withColumn(name, place).drop("_part", "_opening", "base")
