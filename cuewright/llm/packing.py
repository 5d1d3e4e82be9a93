"""Packing transcripts into training sequences: concatenate and cut.

First pass: every task encodes its transcripts once, numbers the ids within its partition and
writes them. Between the passes the partition totals, one row per task, get their prefix sums.
Second pass: partition offset plus offset within the partition is a transcript's place in the one
long stream, which is cut into fixed windows; a transcript across a cut gives one piece per window.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, any_ids, transcripts
from .shingles import slices
from .tokens import memory

ID_BYTES = 4


def _encoder(path: str, end_id: int):
    end = end_id.to_bytes(ID_BYTES, "little")

    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        words = memory(path)
        for batch in batches:
            for piece in slices(batch, 512, 1_000_000):
                ids = [x + end for x in words.encode(piece.column("text").to_pylist())]
                sizes = [len(x) // ID_BYTES for x in ids]
                starts = []
                for n in sizes:
                    starts.append(before)
                    before += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), piece.column("vid"), pa.array(starts, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["part", "vid", "before", "n", "tokens"])
    return run


@any_ids("vid")
def pack(rows: DataFrame, scratch: Scratch, *, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Per piece: ``vid, start, length, tokens, doc_tokens, sequence_id, offset, opens, closes``.

    ``tokens`` holds the ids as little-endian unsigned 32-bit; ``opens``/``closes`` mark the
    boundary records, that is the transcript's first and last piece. Every sequence is full but the
    last one. ``tokenizer``: file for the tokenizers library, one that drops white space; ids are
    taken without special tokens, and ``end_id`` ends each transcript. A NULL or empty text is that
    one id. A NULL vid is passed on, repeated rows are packed each, an empty table gives no rows.
    The order of the stream is that of the partitions as they were written, so it is fixed from
    then on, whichever executor reads it again.
    """
    encoded = scratch.keep(transcripts(rows).mapInArrow(_encoder(tokenizer, end_id), "part int, vid bigint, before bigint, n bigint, tokens binary"),
                           "tokens")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row of two numbers per task of the first pass, 16 bytes each: a bounded broadcast
    bases = F.broadcast(totals.select("part", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base")))
    placed = encoded.join(bases, "part").select("vid", "n", "tokens", (F.col("base") + F.col("before")).alias("at"))
    window = F.explode(F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n") - 1) / length)))
    cut = placed.select("vid", "n", "tokens", "at", window.alias("sequence_id"))
    first = F.greatest(F.col("at"), F.col("sequence_id") * length)
    last = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * length)
    out = cut.select("vid", "n", "tokens", "sequence_id", (first - F.col("sequence_id") * length).alias("offset"),
                     (first - F.col("at")).alias("start"), (last - first).alias("length"))
    piece = F.substring("tokens", (F.col("start") * ID_BYTES + 1).cast("int"), (F.col("length") * ID_BYTES).cast("int"))
    return out.select("vid", "start", "length", piece.alias("tokens"), F.col("n").alias("doc_tokens"), "sequence_id", "offset",
                      (F.col("start") == 0).alias("opens"), (F.col("start") + F.col("length") == F.col("n")).alias("closes"))
