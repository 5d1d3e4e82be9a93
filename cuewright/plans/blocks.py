"""Ordered work inside one key without ever putting a whole key in one task.

Lines of a video are ordered and neighbours matter, so the obvious plan is a
window partitioned by the video. One video holding a third of all rows would
then be one task. Everything here cuts a key into blocks of ``size`` positions:

* ``neighbours``   lead/lag style windows; rows next to a block edge are copied
                   into the adjacent block, so each block is complete by itself.
* ``running``      running sums and maxima by block totals; the totals go
                   through the same split again, so no window holds more than
                   ``size`` rows per level.
* ``dense_rank_ms`` positions 0..n-1 from times.

Shuffles hash on (key, block): hot keys spread out, and the rows move once.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 4096


def _floor_div(col: Column, size: int) -> Column:
    return F.floor(col / F.lit(size)).cast("bigint")


def neighbours(df: DataFrame, build: Callable[[WindowSpec], dict[str, Column]], *,
               keys: tuple[str, ...] = ("vid",), pos: str = "id",
               before: int = 1, after: int = 1, size: int = BLOCK) -> DataFrame:
    """Add columns computed over a window that looks ``before``/``after`` rows away.

    ``pos`` must be dense within the key (``renumber`` makes it so); a window
    given to ``build`` is partitioned by (key, block) and ordered by ``pos``.
    """
    spread, own, w = in_blocks(df, keys=keys, pos=pos, before=before, after=after, size=size)
    return spread.withColumns(build(w)).where(F.col("_blk") == own).drop("_blk")


def in_blocks(df: DataFrame, *, keys: tuple[str, ...] = ("vid",), pos: str = "id",
              before: int = 1, after: int = 1, size: int = BLOCK) -> tuple[DataFrame, Column, WindowSpec]:
    """Rows with ``_blk``, those next to an edge in both blocks; the row's own block; the block's window.

    Windows by it, and groupings by key and ``_blk`` after it, share one exchange.
    """
    own = _floor_div(F.col(pos), size)
    offset = F.col(pos) - own * size
    homes = F.array_compact(F.array(
        own,
        F.when((offset < after) & (own > 0), own - 1),
        F.when(offset >= size - before, own + 1)))
    return df.withColumn("_blk", F.explode(homes)), own, Window.partitionBy(*keys, "_blk").orderBy(pos)


def running(df: DataFrame, totals: dict[str, tuple[str, Column]], *,
            keys: tuple[str, ...] = ("vid",), order: tuple[str, ...] = ("id",),
            bucket: Column | None = None, size: int = BLOCK, levels: int = 2) -> DataFrame:
    """Add running totals of everything *before* each row.

    ``totals`` maps a new column to ('sum' | 'max', value). ``bucket`` must grow
    with ``order``; by default it is the first order column divided by ``size``.
    A sum over nothing is 0, a maximum over nothing is NULL.
    """
    blk = f"_blk{levels}"
    bucket = _floor_div(F.col(order[0]), size) if bucket is None else bucket.cast("bigint")
    values = {f"_v_{name}": value for name, (_, value) in totals.items()}
    rows = df.withColumns({blk: bucket, **values})
    kind = {name: how for name, (how, _) in totals.items()}
    agg = {"sum": F.sum, "max": F.max}

    blocks = rows.groupBy(*keys, blk).agg(
        *[agg[how](f"_v_{name}").alias(name) for name, how in kind.items()])
    if levels > 1:
        before_block = running(
            blocks, {f"_o_{n}": (how, F.col(n)) for n, how in kind.items()},
            keys=keys, order=(blk,), size=size, levels=levels - 1)
    else:
        w = Window.partitionBy(*keys).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
        before_block = blocks.withColumns(
            {f"_o_{n}": agg[how](n).over(w) for n, how in kind.items()})
    before_block = before_block.select(*keys, blk, *[f"_o_{n}" for n in kind])

    w = Window.partitionBy(*keys, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_l_{n}": agg[how](f"_v_{n}").over(w) for n, how in kind.items()})
    joined = local.join(before_block, [*keys, blk])
    out = {}
    for n, how in kind.items():
        if how == "sum":
            out[n] = (F.coalesce(F.col(f"_l_{n}"), F.lit(0))
                      + F.coalesce(F.col(f"_o_{n}"), F.lit(0)))
        else:
            out[n] = F.greatest(F.col(f"_l_{n}"), F.col(f"_o_{n}"))
    extra = [blk] + [f"{p}{n}" for n in kind for p in ("_l_", "_o_", "_v_")]
    return joined.withColumns(out).drop(*extra)


def positions(df: DataFrame, name: str, order: tuple[str, ...], *,
              keys: tuple[str, ...] = ("vid",), bucket: Column | None = None,
              size: int = BLOCK) -> DataFrame:
    """Position 0..n-1 of every row in its key by ``order`` (must be a total order)."""
    return running(df, {name: ("sum", F.lit(1).cast("bigint"))},
                   keys=keys, order=order, bucket=bucket, size=size)
