"""Near-dedup of transcripts: consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all shingles. Tasks send the shingles of a block of transcripts, packed
   by hash range, to the range's group, which counts them and sends one byte per shingle back.
2. Each transcript's shingles are weighted by tf * idf and sampled by improved consistent weighted
   sampling: in every band one sample per bin of shingles. A band's samples together are its key.
3. Transcripts that share a band are candidates, unless the weight that each shares with any
   transcript at all is too small for the pair (see ``_reach``). Leaders of a band's group are
   compared with the group's members of other classes, with ever more leaders, until no pair of
   classes in a group is left uncompared; classes are the connected components of pairs verified by
   weighted Jaccard.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_VID, Scratch, any_ids, components, transcripts
from .shingles import counted, mix, slices

BANDS, BINS = 14, 5          # by the formula, finds a pair at 0.8 with probability 0.996, at 0.85 with 0.9997
RANGE_SHINGLES = 2**21       # shingles of one hash range, counted by one task
IDF_RANGE = 0.25             # how far the rarest shingle outweighs one that is everywhere
STEPS = 8                    # a frequency is kept as 8 * log2, rounded


def _send(bits: int):
    """Blocks of shingles, packed by hash range; a block's own row lists its transcripts."""
    schema = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("body", pa.binary()), ("vids", pa.list_(pa.int64())), ("marks", pa.list_(pa.int64()))])

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                block += 1
                found = counted(part.column("text").to_pylist())
                every = np.concatenate([h for h, _ in found])
                doc = np.repeat(np.arange(len(found), dtype="<u2"), [len(h) for h, _ in found])
                order = np.argsort(every, kind="stable")
                every, doc = every[order], doc[order]
                home = (every >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(every), np.int64)
                rest = ((every >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
                cuts = np.flatnonzero(np.diff(home)) + 1
                rows = [{"range": int(home[a]), "block": block, "body": rest[a:b].tobytes() + doc[a:b].tobytes(), "vids": None, "marks": None}
                        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(every)], strict=True) if b > a]
                rows.append({"range": block % (1 << bits), "block": block, "body": None, "vids": part.column("vid").to_pylist(), "marks": part.column("mark").to_pylist()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return run


def _count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One hash range: in how many transcripts each shingle is."""
    bodies = pdf["body"].tolist()
    sizes = [len(b) // 6 if b is not None else 0 for b in bodies]
    rest = np.concatenate([np.frombuffer(b, "<u4", n) for b, n in zip(bodies, sizes, strict=True) if n] or [np.zeros(0, "<u4")])
    order = np.argsort(rest, kind="stable")
    ordered = rest[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(rest) else np.zeros(0, int)
    times = np.diff(np.r_[first, len(rest)])
    level = np.empty(len(rest), np.uint8)
    level[order] = np.repeat(np.rint(STEPS * np.log2(np.maximum(times, 1))), times).astype(np.uint8)
    out, at = [], 0
    for b, n in zip(bodies, sizes, strict=True):
        out.append(b[4 * n:] + level[at:at + n].tobytes() if n else b)
        at += n
    return pdf.assign(body=out)


def _return(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: the levels of each transcript's shingles, in the order of their hashes."""
    head = pdf[pdf["vids"].notna()].iloc[0]
    bodies = [b for b in pdf[pdf["vids"].isna()].sort_values("range")["body"]]
    doc = np.concatenate([np.frombuffer(b, "<u2", len(b) // 3) for b in bodies] or [np.zeros(0, "<u2")])
    level = np.concatenate([np.frombuffer(b, np.uint8, len(b) // 3, 2 * (len(b) // 3)) for b in bodies] or [np.zeros(0, np.uint8)])
    level = level[np.argsort(doc, kind="stable")]
    ends = np.cumsum(np.bincount(doc, minlength=len(head["vids"])))
    parts = [x.tobytes() for x in np.split(level, ends[:-1])]
    return pd.DataFrame({"vid": head["vids"], "mark": head["marks"], "levels": parts})


def _weights(times: np.ndarray, levels: bytes, total: int) -> np.ndarray:
    """tf * idf; the idf runs from 1 for a shingle that is everywhere towards 1 + IDF_RANGE for one seen once.

    A wide range would rate the few edits of a text far above what it shares with a large group of
    copies, and so split groups whose plain Jaccard similarity is well above the threshold.
    """
    frequency = np.exp2(np.frombuffer(levels, np.uint8) / STEPS)
    return (times * (1 + IDF_RANGE * np.log1p(total / frequency) / math.log1p(total))).astype(np.float32)


def band_keys(found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """[transcript, band] keys of transcripts given as (shingle hashes, weights)."""
    sizes = np.array([len(h) for h, _ in found])
    doc = np.repeat(np.arange(len(found)), sizes)
    every = np.concatenate([h for h, _ in found])
    log_w = np.log(np.concatenate([w for _, w in found]).astype(np.float32))
    whole, whole_w = every, log_w
    narrow = np.uint16 if len(found) * BINS < 2**16 else np.int64  # which sorts by radix
    keys = np.empty((len(found), BANDS), np.uint64)
    unit = np.float32(2.0**-24)
    mask = np.uint64(0xFFFFFF)
    for band in range(BANDS):
        # other bins in every band: a bin of a short text may hold only what its partner lacks
        cell = (doc * BINS + (mix(whole ^ np.uint64((band + 1) * 0x5851F42D4C957F2D % 2**64)) % np.uint64(BINS)).astype(np.int64)).astype(narrow)
        order = np.argsort(cell, kind="stable")
        every, log_w, cell = whole[order], whole_w[order], cell[order]
        present, starts = np.unique(cell, return_index=True)
        a = mix(every + np.uint64((band * 2 + 1) * 0x9E3779B97F4A7C15 % 2**64))
        b = mix(a + np.uint64(0x2545F4914F6CDD1D))
        u = [((x >> np.uint64(s)) & mask).astype(np.float32) * unit + unit / 2 for x, s in ((a, 0), (a, 24), (b, 0), (b, 24))]
        beta = ((a >> np.uint64(48)) ^ (b >> np.uint64(48))).astype(np.float32) * np.float32(2.0**-16)
        r = -np.log(u[0] * u[1])                                    # gamma(2, 1)
        t = np.floor(log_w / r + beta)
        log_a = np.log(-np.log(u[2] * u[3])) - r * (t - beta + 1)   # of c / (y e^r), with ln y = r (t - beta)
        bits = log_a.astype(np.float32).view(np.uint32)
        sortable = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        name = mix(every + t.astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF)
        least = np.minimum.reduceat((sortable << np.uint64(32)) | name, starts) & np.uint64(0xFFFFFFFF)
        sample = np.zeros(len(found) * BINS, np.uint64)
        sample[present] = least + np.uint64(1)
        sample = sample.reshape(-1, BINS)
        key = np.full(len(found), band, np.uint64)
        for k in range(BINS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sample[:, k])
        keys[:, band] = key
    return keys


def _vector(h: np.ndarray, w: np.ndarray) -> bytes:
    return h.astype("<u4").tobytes() + w.astype("<f4").tobytes()


def _sign(total: int):
    schema = pa.schema([("vid", pa.int64()), ("mark", pa.int64()), ("node", pa.int64()), ("size", pa.float64()),
                        ("common", pa.float64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 128, 500_000):
                rows = [(v, m, h, _weights(n, x, total), np.frombuffer(x, np.uint8) > 0) for v, m, x, (h, n) in zip(
                    part.column("vid").to_pylist(), part.column("mark").to_pylist(), part.column("levels").to_pylist(),
                    counted(part.column("text").to_pylist()), strict=True) if len(h)]
                if not rows:
                    continue
                keys = band_keys([(h, w) for _, _, h, w, _ in rows]).view(np.int64)
                # transcripts with equal vectors are one node
                node = [int((mix(h) * (w.view(np.uint32).astype(np.uint64) * np.uint64(2) + np.uint64(1))).sum().view(np.int64)) for _, _, h, w, _ in rows]
                size = [float(w.sum(dtype=np.float64)) for _, _, _, w, _ in rows]
                common = [float(w[twice].sum(dtype=np.float64)) for _, _, _, w, twice in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                                  pa.array(node, pa.int64()), pa.array(size, pa.float64()), pa.array(common, pa.float64()),
                                                  pa.array(keys.tolist(), pa.list_(pa.int64()))], schema=schema)
    return run


def _bodies(total: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = counted(part.column("text").to_pylist())
                bodies = [_vector(h, _weights(n, x, total)) for x, (h, n) in zip(part.column("levels").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(bodies, pa.binary())], ["node", "body"])
    return run


def _similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two packed vectors."""
    n, m = len(a) // 8, len(b) // 8
    x, y = np.frombuffer(a, "<u4", n), np.frombuffer(b, "<u4", m)
    v, w = (np.frombuffer(s, "<f4", k, 4 * k).astype(np.float64) for s, k in ((a, n), (b, m)))
    _, i, j = np.intersect1d(x, y, return_indices=True)
    both = np.minimum(v[i], w[j]).sum()
    return both / (v.sum() + w.sum() - both)


def _verify(threshold: float):
    def run(batches):
        for pdf in batches:
            sim = [_similarity(x, y) for x, y in zip(pdf["x"], pdf["y"], strict=True)]
            yield pdf[["class", "led"]][np.array(sim) >= threshold]
    return run


def _reach(threshold: float):
    """The largest weight a text can have that this one, of weight ``size``, is linked with.

    Two texts share at most ``common``, the weight of those shingles that are in more than one
    transcript. Their similarity reaches t only if they share at least t / (1 + t) of their joint
    weight, so the other one weighs at most (1 + t) / t * common - size. Of two linked texts the
    heavier is within the lighter one's reach, so the lighter one reaches its own weight: a text
    that doesn't need not lead a group. Exact but for rounding, which the factor leaves room for.
    """
    return (1 + threshold) / threshold * F.col("common") * (1 + 1e-9) - F.col("size")


def shingle_levels(docs: DataFrame, scratch: Scratch) -> tuple[int, DataFrame]:
    """Number of ``docs`` (vid, mark, text), and per (vid, mark) one byte for each of its shingles, in the order of their hashes."""
    total, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    bits = max(0, math.ceil(math.log2(max(1, (size or 0) / 6 / RANGE_SHINGLES))))
    sent = docs.mapInArrow(_send(bits), "range bigint, block bigint, body binary, vids array<bigint>, marks array<bigint>")
    packed = "range bigint, block bigint, body binary, vids array<bigint>, marks array<bigint>"
    levels = sent.groupBy("range").applyInPandas(_count, packed) \
        .groupBy("block").applyInPandas(_return, "vid bigint, mark bigint, levels binary")
    levels = scratch.keep(levels, "levels")
    return total, levels.groupBy("vid", "mark").agg(F.any_value("levels").alias("levels"))


@any_ids("vid", "class_vid")
def near_classes(rows: DataFrame, scratch: Scratch, *, threshold: float = 0.8, max_leaders: int | None = None) -> DataFrame:
    """Per transcript: ``vid, class_vid, class_size, kept``; the smallest vid of a class stays.

    Two transcripts are linked if the weighted Jaccard similarity of their five-word shingles, tf *
    idf over all transcripts, is at least ``threshold``; a class is what links connect. A transcript
    of fewer than five words has one shingle, one without words (NULL, empty) is a class of its own.
    A NULL vid counts in its class and stays only where no other row is in it (``class_vid`` NULL).
    Repeated rows are in one class and share its fate; an empty table gives no rows.

    By default every pair of classes in a band's group is compared in the end, which costs the
    square of the number of texts that stay unlinked in a group. ``max_leaders`` ends it earlier, at
    so many leaders a group; links between two texts that both lead no group may then be missed.
    """
    docs = transcripts(rows).select(F.coalesce("vid", F.lit(NO_VID)).alias("vid"), F.xxhash64("text").alias("mark"), "text")
    total, levels = shingle_levels(docs, scratch)
    full = scratch.keep(docs.join(levels, ["vid", "mark"]), "full")
    signed = scratch.keep(full.mapInArrow(_sign(total), "vid bigint, mark bigint, node bigint, size double, common double, keys array<bigint>"), "signed")

    nodes = signed.groupBy("node").agg(F.min(F.struct("vid", "mark", "size", "common", "keys")).alias("r")) \
        .select("node", "r.*").withColumn("reach", _reach(threshold))
    nodes = scratch.keep(nodes, "nodes")
    # a partner weighs at least threshold times as much
    members = nodes.where(F.col("reach") >= threshold * F.col("size")).select("node", F.posexplode("keys").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.keep(members.join(shared, "key"), "members")
    # who shares its keys with most others leads: the text that the others are edits of
    rank = members.groupBy("node").agg(F.sum("n").alias("rank"))
    rank = scratch.keep(rank.join(nodes.select("node", "size", "reach", "keys"), "node"), "rank")
    wanted = nodes.select("node", "vid", "mark").join(members.select("node").distinct(), "node")
    bodies = scratch.keep(full.dropDuplicates(["vid", "mark"]).join(wanted, ["vid", "mark"]).select("node", "text", "levels")
                          .mapInArrow(_bodies(total), "node bigint, body binary"), "bodies")
    scratch.drop("full")

    classes = rank.select("node", F.col("node").alias("class"))
    led, leaders, turn = 0, 1, 0
    while True:
        turn += 1
        inside = members.join(classes, "node")
        mixed = inside.groupBy("key").agg((F.min("class") != F.max("class")).alias("mixed")).where("mixed")
        inside = inside.join(mixed.select("key"), "key").join(rank, "node")
        able = inside.where("reach >= size")
        most = able.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if most is None:
            break
        # members of a key never change, nor does their order: leaders up to `led` have been compared already
        w = Window.partitionBy("key").orderBy(F.desc("rank"), "node")
        lead = able.select("key", F.col("node").alias("leader"), F.col("class").alias("led"), F.col("keys").alias("lkeys"),
                           F.col("size").alias("lsize"), F.col("reach").alias("lreach"), F.col("rank").alias("lrank"), F.row_number().over(w).alias("r")) \
            .where((F.col("r") <= leaders) & (F.col("r") > led)).drop("r")
        met = F.arrays_overlap(F.slice("keys", F.lit(1), F.col("band")), F.slice("lkeys", F.lit(1), F.col("band")))  # in a band before
        near = (F.col("size") <= F.col("lreach")) & (F.col("lsize") <= F.col("reach"))
        ahead = (F.col("reach") >= F.col("size")) & ((F.col("rank") > F.col("lrank")) | ((F.col("rank") == F.col("lrank")) & (F.col("node") < F.col("leader"))))
        pairs = inside.join(lead, (inside["key"] == lead["key"]) & (F.col("class") != F.col("led")) & near & ~ahead & ~met) \
            .select(F.col("node").alias("a"), F.col("leader").alias("b"), "class", "led")  # each pair once, by the one that leads first
        pairs = scratch.keep(pairs, f"pairs-{turn}")
        both = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a") \
            .join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
        linked = scratch.keep(both.mapInPandas(_verify(threshold), "class bigint, led bigint"), f"links-{turn}")
        if linked.take(1):  # they join classes, so only classes are looked at
            found = components(linked.select(F.col("class").alias("a"), F.col("led").alias("b")), scratch, f"joined-{turn}")
            classes = scratch.keep(classes.join(found, F.col("class") == F.col("id"), "left")
                                   .select("node", F.coalesce("component", "class").alias("class")), f"classes-{turn}")
        if leaders >= most or max_leaders is not None and leaders >= max_leaders:
            break
        led, leaders = leaders, leaders * 8
    named = signed.select("vid", "mark", "node").join(classes, "node", "left").select("vid", "mark", F.coalesce("class", "node").alias("class"))
    heads = named.groupBy("class").agg(F.min("vid").alias("head"), F.count(F.lit(1)).alias("size"))
    named = named.join(heads, "class").select("vid", "head", "size")
    alone = docs.where(~F.col("text").rlike(r"[^\x00-\x20]")).select("vid", F.col("vid").alias("head"), F.lit(1).cast("bigint").alias("size"))
    out = named.unionByName(alone)
    real = lambda c: F.when(F.col(c) != NO_VID, F.col(c))
    return out.select(real("vid").alias("vid"), real("head").alias("class_vid"), F.col("size").alias("class_size"), (F.col("vid") == F.col("head")).alias("kept"))
