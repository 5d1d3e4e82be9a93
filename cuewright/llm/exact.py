"""Exact dedup with a cuckoo-filter index of live digests.

The index is one table cut into shards by digest. Each shard has a cuckoo filter (one row with
its cells) and the bucketed content behind it (one row per live digest: keeper and number of
copies). A digest the filter does not know is new for certain; a hit is verified against the
content. A filter that overflows is rebuilt twice as large from the shard's stored digests, and
the table is cut into more shards when they grow past their size.
"""
from __future__ import annotations

from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_VID, Scratch, any_ids, transcripts

SLOTS, KICKS = 4, 400
STATE = "shard bigint, digest binary, vid bigint, copies bigint, cells binary"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may sit in either of two buckets."""

    def __init__(self, buckets: int = 64, cells: bytes | None = None):
        self.cells = array("H", cells if cells is not None else bytes(2 * SLOTS * buckets))
        self.mask = len(self.cells) // SLOTS - 1

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[:2], "big") or 1
        i = int.from_bytes(digest[2:8], "big") & self.mask
        return fp, i, self._other(i, fp)

    def _other(self, i: int, fp: int) -> int:
        return i ^ ((fp * 0x5BD1E995) >> 3 & self.mask)

    def _bucket(self, i: int) -> array:
        return self.cells[SLOTS * i:SLOTS * i + SLOTS]

    def __contains__(self, digest: bytes) -> bool:
        fp, i, j = self._places(digest)
        return fp in self._bucket(i) or fp in self._bucket(j)

    def _put(self, i: int, fp: int) -> bool:
        bucket = self._bucket(i)
        if 0 not in bucket:
            return False
        self.cells[SLOTS * i + bucket.index(0)] = fp
        return True

    def insert(self, digest: bytes) -> bool:
        """False on overflow: the filter must then be rebuilt from the stored digests."""
        fp, i, j = self._places(digest)
        if self._put(i, fp) or self._put(j, fp):
            return True
        for kick in range(KICKS):
            at = SLOTS * j + kick % SLOTS
            fp, self.cells[at] = self.cells[at], fp
            j = self._other(j, fp)
            if self._put(j, fp):
                return True
        return False

    def delete(self, digest: bytes) -> None:
        fp, i, j = self._places(digest)
        for k in (i, j):
            bucket = self._bucket(k)
            if fp in bucket:
                self.cells[SLOTS * k + bucket.index(fp)] = 0
                return

    @classmethod
    def of(cls, digests, buckets: int) -> CuckooFilter:
        """A filter of these digests; doubled until they fit."""
        while True:
            new = cls(buckets)
            if all(new.insert(d) for d in digests):
                return new
            buckets *= 2


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with every run of [\\x20\\x09-\\x0D] as one space; equal texts, equal digests."""
    return F.unhex(F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ").cast("binary"), 256))


def _fold(batches):
    """Sum equal digests within an Arrow batch, before anything is shuffled."""
    for pdf in batches:
        yield pdf.groupby("digest", as_index=False, sort=False).agg({"vid": "min", "copies": "sum"})


def _absorb(key, state: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """One shard: apply the changes (positive copies arrive, negative ones leave)."""
    entries = state[state["cells"].isna()]
    content = {d: [v, n] for d, v, n in zip(entries["digest"], entries["vid"], entries["copies"], strict=True)}
    cells = state["cells"].dropna()
    index = CuckooFilter(cells=cells.iloc[0]) if len(cells) else CuckooFilter.of(content, 64)
    ordered = changes.sort_values("copies", ascending=False, kind="stable")
    for digest, vid, n in zip(ordered["digest"], ordered["vid"], ordered["copies"], strict=True):
        entry = content.get(digest) if digest in index else None  # a hit is verified; a miss needs no look
        if entry is None:
            if n > 0:
                content[digest] = [vid, n]
                if not index.insert(digest):
                    index = CuckooFilter.of(content, 2 * (index.mask + 1))
        elif n > 0:
            entry[0], entry[1] = min(entry[0], vid), entry[1] + n
        else:
            entry[1] += n
            if entry[1] <= 0:
                del content[digest]
                index.delete(digest)
            elif vid <= entry[0]:
                entry[0] = -1  # the keeper has left: named anew from the live rows
    out = pd.DataFrame({"shard": int(key[0]), "digest": list(content), "vid": [int(v) for v, _ in content.values()],
                        "copies": [int(n) for _, n in content.values()], "cells": None})
    filter_row = pd.DataFrame({"shard": [int(key[0])], "digest": [None], "vid": [0], "copies": [0],
                               "cells": [index.cells.tobytes()]})
    return pd.concat([out.astype({"cells": object}), filter_row], ignore_index=True)


class DigestIndex:
    """Live digests of transcripts; each change is one pass over the shards it is dealt to.

    ``rows``: DataFrame of STATE (None: empty). ``shard_rows``: digests a shard should hold.
    """

    def __init__(self, scratch: Scratch, rows: DataFrame | None = None, *, shards: int = 1, shard_rows: int = 20_000):
        self.scratch, self.shards, self.shard_rows, self.version = scratch, shards, shard_rows, 0
        self.rows = rows if rows is not None else scratch.spark.createDataFrame([], STATE)

    def entries(self) -> DataFrame:
        return self.rows.where(F.col("cells").isNull()).select("digest", "vid", "copies")

    def _apply(self, digests: DataFrame, sign: int) -> None:
        expected = digests.count() * (sign > 0) + self.rows.count()
        shards = max(self.shards, -(-expected // self.shard_rows))
        deal = F.pmod(F.xxhash64("digest"), F.lit(shards))
        state = self.rows
        if shards != self.shards:  # cut anew: the filters are rebuilt from the stored digests
            state, self.shards = state.where(F.col("cells").isNull()).withColumn("shard", deal), shards
        changes = digests.select("digest", F.coalesce("vid", F.lit(NO_VID)).alias("vid"), F.lit(sign).cast("bigint").alias("copies"))
        changes = changes.mapInPandas(_fold, "digest binary, vid bigint, copies bigint").withColumn("shard", deal)
        out = state.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(_absorb, STATE)
        self.version += 1
        self.rows = self.scratch.keep(out, f"index-{self.version}")

    def insert(self, digests: DataFrame) -> None:
        """Add rows of (vid, digest)."""
        self._apply(digests, 1)

    def delete(self, digests: DataFrame, live: DataFrame) -> None:
        """Take rows of (vid, digest) out again; ``live``: the rows that stay, to name new keepers.

        Rows that were never inserted are ignored, unless other copies of their digest are live.
        """
        self._apply(digests, -1)
        orphans = self.rows.where("cells IS NULL AND vid = -1").select("digest")
        heirs = live.join(orphans, "digest", "left_semi").groupBy("digest").agg(F.min("vid").alias("_heir"))
        named = self.rows.join(heirs, "digest", "left").withColumn("vid", F.when(
            F.col("cells").isNull() & (F.col("vid") == -1), F.coalesce("_heir", F.lit(NO_VID))).otherwise(F.col("vid")))
        self.version += 1
        self.rows = self.scratch.keep(named.select("shard", "digest", "vid", "copies", "cells"), f"index-{self.version}")


@any_ids("vid", "keep_vid")
def exact_copies(rows: DataFrame, scratch: Scratch, index: DigestIndex | None = None) -> DataFrame:
    """Per transcript: ``vid, digest, keep_vid, copies, kept``; the smallest vid of equal texts stays.

    A NULL text is empty, and empty texts are copies of each other. A NULL vid counts as a copy and
    stays only where no other row has the text (``keep_vid`` NULL). Repeated rows with one vid are
    copies of each other and share its fate. An empty table gives no rows. ``index``: an index that
    other rows went into before; these rows are added to it.
    """
    digests = scratch.keep(transcripts(rows).select("vid", digest_of(F.col("text")).alias("digest")), "digests")
    index = index or DigestIndex(scratch)
    index.insert(digests)
    found = digests.join(index.entries().withColumnRenamed("vid", "keeper"), "digest")
    keep = F.when(F.col("keeper") != NO_VID, F.col("keeper"))
    return found.select("vid", "digest", keep.alias("keep_vid"), "copies", F.col("vid").eqNullSafe(keep).alias("kept"))
