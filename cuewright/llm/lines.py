"""Line dedup over levelled sorted runs of line hashes.

A run is a table sorted by line hash: the hash, the number of transcripts of its batch that hold
the line, and the keeper, set only by the batch that saw the line first. A new batch is
merge-anti-joined with the runs (lines none of them has are new), its own run is added, and when
a level has ``fanout`` runs they are merged into one of the next level.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_VID, Scratch, any_ids, transcripts

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDGE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def line_key(line: Column) -> Column:
    """The line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def line_hash(key: Column) -> Column:
    """128 bits, so that different lines do not meet."""
    return F.unhex(F.md5(key.cast("binary")))


class LineRuns:
    """``runs``: (level, DataFrame of hash, docs, keeper), newest last."""

    def __init__(self, scratch: Scratch, fanout: int = 2):
        self.scratch, self.fanout, self.runs, self.made = scratch, fanout, [], 0

    def _write(self, level: int, run: DataFrame) -> None:
        self.made += 1
        self.runs.append((level, self.scratch.keep(run.sortWithinPartitions("hash"), f"run-{self.made}"), f"run-{self.made}"))

    def merged(self) -> DataFrame:
        """One row per line hash over all runs: (hash, docs, keeper)."""
        every = reduce(DataFrame.unionByName, [run for _, run, _ in self.runs])
        return every.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """``batch``: (hash, docs, last), one row per line hash of the batch.

        A line that some run has already keeps its keeper; batches must come in falling order of
        vid if the largest vid is to keep a line.
        """
        own = batch.select("hash", "docs", F.col("last").alias("keeper"))
        if self.runs:
            seen = reduce(DataFrame.unionByName, [run.where("keeper IS NOT NULL").select("hash") for _, run, _ in self.runs])
            fresh = own.join(seen, "hash", "left_anti")
            again = own.join(seen, "hash", "left_semi").withColumn("keeper", F.lit(None).cast("bigint"))
            own = fresh.unionByName(again)
        self._write(0, own)
        level = 0
        while len(same := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self._compact(same, level + 1)
            level += 1

    def _compact(self, runs: list, level: int) -> None:
        rest = [r for r in self.runs if r not in runs]
        self.runs = runs
        one = self.merged()
        self.runs = rest
        self._write(level, one)
        for _, _, name in runs:
            self.scratch.drop(name)


@any_ids("vid")
def dedup_lines(rows: DataFrame, scratch: Scratch, *, min_chars: int = 40, min_docs: int = 5,
                batches: int = 3, fanout: int = 2) -> DataFrame:
    """Per transcript: ``vid, text, n_lines, n_dropped``; repeated long lines stay in one transcript.

    Lines split at \\n (a NULL or empty text is one empty line). A line whose key has at least
    ``min_chars`` code points and is in at least ``min_docs`` transcripts is dropped except in the
    largest vid that holds it, where all its occurrences stay. Repeated rows are transcripts of
    their own, and all rows with the largest vid keep the line. A NULL vid ranks below every other.
    An empty table gives no rows.
    """
    docs = transcripts(rows)
    split = F.split("text", "\n", -1)
    keys = F.transform(split, line_key)
    long_keys = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    rank = F.coalesce("vid", F.lit(-NO_VID))
    cuts = docs.where("vid IS NOT NULL").approxQuantile("vid", [1 - (i + 1) / batches for i in range(batches - 1)], 0.01) \
        if batches > 1 else []
    batch = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):  # the largest vids come first
        batch = F.when(rank > int(cuts[i]), i).otherwise(batch)
    held = docs.select(rank.alias("vid"), batch.cast("int").alias("batch"), F.explode(long_keys).alias("key")) \
        .select("batch", line_hash(F.col("key")).alias("hash"), "vid")
    held = scratch.keep(held.groupBy("hash", "batch").agg(F.count(F.lit(1)).alias("docs"), F.max("vid").alias("last")),
                        "held", "batch")
    runs = LineRuns(scratch, fanout)
    for i in range(len(cuts) + 1):
        runs.add(held.where(F.col("batch") == i))
    common = scratch.keep(runs.merged().where(F.col("docs") >= min_docs).select("hash", "keeper"), "common")

    docs = docs.withColumn("mark", F.xxhash64("text"))  # rows of one vid with other texts stay apart
    numbered = docs.select("vid", "mark", F.posexplode(keys).alias("pos", "key")).where(F.length("key") >= min_chars) \
        .select("vid", "mark", "pos", line_hash(F.col("key")).alias("hash"))
    lost = numbered.join(common, "hash").where(F.coalesce("vid", F.lit(-NO_VID)) < F.col("keeper")) \
        .groupBy(F.col("vid").alias("of"), F.col("mark").alias("at")).agg(F.collect_set("pos").alias("lost"))
    out = docs.join(lost, F.col("vid").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("at")), "left").select("vid", "text", "lost")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("lost"))
    text = F.when(F.col("lost").isNull(), F.col("text")) \
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    n_lines = F.size(split).cast("bigint")
    dropped = F.when(F.col("lost").isNull(), 0).otherwise(n_lines - F.size(kept)).cast("bigint")
    return out.select("vid", text.alias("text"), n_lines.alias("n_lines"), dropped.alias("n_dropped"))
