"""Sampled audio as blocks: (vid, block, samples), ``size`` samples a block.

Work is keyed by (vid, block), so no task ever holds a whole track. Blocks of a
track are dense from 0 and full, but for the last one.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..plans.blocks import neighbours, positions, running
from ..session import settle

VOICED = 1e-5
PEAK = 0.995
_DOUBLES = "array<double>"


def _abs(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.abs(x))


def _floor_div(a: Column, b: Column | int) -> Column:
    return F.floor(a / (F.lit(b) if isinstance(b, int) else b)).cast("bigint")


# ---- mixing ---------------------------------------------------------------------
def mix_timeline(clips: DataFrame, size: int = K.SAMPLE_RATE, tracks: DataFrame | None = None) -> DataFrame:
    """Add clips (vid, start_sample, samples) at exact offsets; spill goes to the next block.

    A negative start counts as 0. Every block of a track is there, silent ones too: up to the last
    clip's end, or, where ``tracks`` gives (vid, length), up to that length; what lies beyond goes.
    The clips over a block are counted first and dealt to one shard for every 32 of them; shards are
    summed as arrays, then the shards of a block, whatever the depth.
    """
    clips = clips.where(F.size("samples") > 0).select("vid", F.greatest(F.col("start_sample"), F.lit(0)).cast("bigint").alias("start_sample"), "samples")
    end = F.col("start_sample") + F.size("samples")
    if tracks is None:
        lengths = clips.groupBy("vid").agg(F.max(end).alias("length"))
    else:
        lengths = tracks.select("vid", F.col("length").cast("bigint").alias("length"))
    every = lengths.where("length > 0").select("vid", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), _floor_div(F.col("length") - 1, size))).alias("block"))
    blocks = F.sequence(_floor_div(F.col("start_sample"), size), _floor_div(end - 1, size))
    spread = clips.select("vid", "start_sample", "samples", F.explode(blocks).alias("block"))
    shift = F.col("start_sample") - F.col("block") * size
    lead = F.greatest(F.lit(0).cast("bigint"), shift).cast("int")
    skip = F.greatest(F.lit(0).cast("bigint"), -shift).cast("int")
    piece = F.slice("samples", skip + 1, F.least(F.lit(size) - lead, F.size("samples") - skip)).cast(_DOUBLES)
    pad = F.concat(F.array_repeat(F.lit(0.0), lead), piece, F.array_repeat(F.lit(0.0), F.lit(size) - lead - F.size(piece)))
    depth = clips.select("vid", F.explode(blocks).alias("block")).groupBy("vid", "block").agg(F.ceil(F.count("*") / 32).cast("int").alias("shards"))
    dealt = spread.join(depth, ["vid", "block"]).select(
        "vid", "block", pad.alias("pad"), F.pmod(F.xxhash64("start_sample", "samples"), F.col("shards")).alias("shard"))

    def total(column):
        return F.aggregate(F.collect_list(column), F.array_repeat(F.lit(0.0), size), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    sums = dealt.groupBy("vid", "block", "shard").agg(total("pad").alias("part")).groupBy("vid", "block").agg(total("part").alias("sum"))
    out = every.join(sums, ["vid", "block"], "left")
    filled = F.coalesce("sum", F.array_repeat(F.lit(0.0), size))
    if tracks is not None:  # silence after the track's end
        filled = F.transform(filled, lambda x, i: F.when(F.col("block") * size + i < F.col("length"), x).otherwise(0.0))
    return out.select("vid", "block", filled.alias("samples"))


def peak_limit(signal: DataFrame) -> DataFrame:
    """Scale a track down to a 0.995 peak, only if it exceeds that."""
    peaks = signal.groupBy("vid").agg(F.max(F.array_max(_abs(F.col("samples")))).alias("_p")).where(F.col("_p") > PEAK)
    return signal.join(peaks, "vid", "left").withColumn("samples", F.when(
        F.col("_p").isNotNull(), F.transform("samples", lambda x: x * (F.lit(PEAK) / F.col("_p")))).otherwise(F.col("samples"))).drop("_p")


def fade(clips: DataFrame, ms: float = 8.0, rate: int = K.SAMPLE_RATE) -> DataFrame:
    """Linear ramps in and out; at most half the clip each."""
    length = F.size("samples")
    n = F.least(F.lit(int(rate * ms / 1000)), F.floor(length / 2).cast("int"))
    step = F.greatest(n - 1, F.lit(1))
    faded = F.transform("samples", lambda x, i: x * F.when(i < n, i / step).otherwise(1.0)
                        * F.when(i >= length - n, (length - 1 - i) / step).otherwise(1.0))
    return clips.withColumn("samples", F.when(n > 0, faded).otherwise(F.col("samples").cast(_DOUBLES)))


def fit_clip(clips: DataFrame, rate: int = K.SAMPLE_RATE) -> DataFrame:
    """Cut clips at limit_ms (NULL: no limit), with a long fade on the cut ones."""
    keep = F.floor(F.col("limit_ms") * rate / 1000).cast("int")
    over = F.coalesce((F.col("limit_ms") > 0) & (F.size("samples") > keep), F.lit(False))
    cut = clips.withColumn("_over", over).withColumn(
        "samples", F.when(F.col("_over"), F.slice("samples", F.lit(1), keep)).otherwise(F.col("samples")))
    return fade(cut.where("_over"), 55.0, rate).unionByName(fade(cut.where("NOT _over"), 8.0, rate)).drop("_over")


# ---- levels ------------------------------------------------------------------------
def energy_frames(signal: DataFrame, frame: int = 480, size: int = K.SAMPLE_RATE) -> DataFrame:
    """Mean absolute level per 20 ms frame; frames divide a block, so no shuffle."""
    if size % frame:
        raise ValueError("a block must hold a whole number of frames")
    per = size // frame
    whole = F.floor(F.size("samples") / frame).cast("int")
    level = lambda k: F.aggregate(F.slice("samples", k * frame + 1, F.lit(frame)), F.lit(0.0), lambda a, x: a + F.abs(x).cast("double")) / frame
    rows = signal.where(whole > 0).select("vid", "block", F.posexplode(F.transform(F.sequence(F.lit(0), whole - 1), level)).alias("k", "energy"))
    return rows.select("vid", (F.col("block") * per + F.col("k")).alias("frame"), "energy")


def _with_context(signal: DataFrame, reach: int) -> DataFrame:
    """Adds ``ctx``: the block with ``reach`` samples of its neighbours, and ``off``, where it starts in it."""
    seen = neighbours(signal, lambda w: {"_b": F.lag("samples").over(w), "_a": F.lead("samples").over(w)}, pos="block", size=256)
    none = F.array().cast(_DOUBLES)
    before = F.coalesce(F.slice("_b", F.greatest(F.lit(1), F.size("_b") - reach + 1), F.lit(reach)).cast(_DOUBLES), none)
    after = F.coalesce(F.slice("_a", F.lit(1), F.lit(reach)).cast(_DOUBLES), none)
    return seen.withColumn("off", F.size(before)).withColumn("ctx", F.concat(before, F.col("samples").cast(_DOUBLES), after)).drop("_b", "_a")


def _by_block(one):
    """``one(levels of the context, start, samples)`` for each block, written into one flat Arrow buffer a batch.

    Blocks are views of the batch's own buffer and are worked on one after the other: a worker holds a batch
    and its result, no object per block and no second copy.
    """
    @F.arrow_udf(_DOUBLES)
    def run(ctx: pa.Array, off: pa.Array, n: pa.Array) -> pa.Array:
        at, x = np.asarray(ctx.offsets), ctx.values.to_numpy(zero_copy_only=False)
        many = np.maximum(np.asarray(n), 0)  # a block without samples has none, a missing one neither
        ends = np.r_[0, np.cumsum(many)]
        out = np.empty(ends[-1])
        for k, o in enumerate(np.asarray(off).tolist()):
            if many[k]:
                out[ends[k]:ends[k + 1]] = one(np.abs(x[at[k]:at[k + 1]]), o, many[k])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))

    return run


def moving_env(signal: DataFrame, win: int = 480) -> DataFrame:
    """Moving average of |x| over 20 ms, zeros beyond the ends. Adds ``env`` to each block."""
    def one(x, o, k):
        return np.convolve(x, np.ones(win) / win)[o + (win - 1) // 2:][:k]

    return _with_context(signal, win).withColumn("env", _by_block(one)("ctx", "off", F.size("samples"))).drop("ctx", "off")


def silent_runs(env: DataFrame, size: int = K.SAMPLE_RATE, level: float = VOICED) -> DataFrame:
    """Maximal runs (vid, s, e) of samples whose envelope is below ``level``; e is exclusive.

    Edges are found inside blocks, then runs that touch across a block edge are joined.
    """
    n = F.size("env")
    quiet = lambda i: F.coalesce(F.get("env", i) < level, F.lit(False))
    idx = F.sequence(F.lit(0), n - 1)
    starts = F.filter(idx, lambda i: quiet(i) & ~F.when(i > 0, quiet(i - 1)).otherwise(F.lit(False)))
    ends = F.filter(idx, lambda i: quiet(i) & ~F.when(i < n - 1, quiet(i + 1)).otherwise(F.lit(False)))
    base = F.col("block") * size
    local = env.where(n > 0).select("vid", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("r"), base.alias("b")) \
        .select("vid", (F.col("b") + F.col("r.s")).alias("s"), (F.col("b") + F.col("r.e") + 1).alias("e"))
    ranked = positions(settle(local), "k", ("s",), bucket=_floor_div(F.col("s"), size * 64))
    seen = neighbours(ranked, lambda w: {"_pe": F.lag("e").over(w)}, pos="k")
    fresh = seen.withColumn("_at", F.when(F.col("_pe").isNull() | (F.col("_pe") != F.col("s")), F.col("k")))
    runs = running(settle(fresh), {"_m": ("max", F.col("_at"))}, order=("k",))
    return runs.groupBy("vid", F.coalesce("_at", "_m").alias("_run")).agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_run")


def cut_points(runs: DataFrame, tracks: DataFrame, rate: int = K.SAMPLE_RATE, step_s: float = 300.0, min_gap_s: float = 0.25) -> DataFrame:
    """Cuts (vid, no, sample) about every five minutes, in the middle of the longest silence near.

    tracks: vid, n (samples). A cut depends on the one before it, so a track's
    cuts are one fold; it looks only at silences long enough to be cut in, kept
    in buckets of a third of a step, of which four are read per cut.
    """
    step = int(step_s * rate)
    near, quarter = step // 3, step // 4
    least = F.lit(min_gap_s * rate)
    big = runs.where(F.col("e") - F.col("s") >= least)
    cells = big.withColumn("b", F.explode(F.sequence(_floor_div(F.col("s"), near), _floor_div(F.col("e") - 1, near))))
    grid = cells.groupBy("vid", "b").agg(F.collect_list(F.struct("s", "e")).alias("rs")) \
        .groupBy("vid").agg(F.map_from_entries(F.collect_list(F.struct("b", "rs"))).alias("quiet"))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    n = F.col("n")

    def go(points, _):
        last = F.element_at(points, -1)
        target = last + step
        lo, hi = F.greatest(last + quarter, target - near), F.least(n - 1, target + near)
        b = _floor_div(lo, near)
        rs = F.array_distinct(F.concat(*[F.coalesce(F.try_element_at("quiet", b + d), none) for d in range(4)]))
        inside = F.filter(F.transform(rs, lambda r: X.rec(s=F.greatest(r["s"], lo), e=F.least(r["e"], hi))), lambda r: r["e"] - r["s"] >= least)
        best = F.array_max(F.transform(inside, lambda r: X.rec(len=r["e"] - r["s"], neg=-r["s"], mid=r["s"] + _floor_div(r["e"] - r["s"], 2))))
        return F.when(target < n - quarter, F.concat(points, F.array(F.coalesce(best["mid"], F.least(target, n - 1))))).otherwise(points)

    zero = F.array(F.lit(0).cast("bigint"))
    turns = F.sequence(F.lit(1), F.floor(n / quarter).cast("int") + 1)
    points = F.when(n <= step, zero).otherwise(F.aggregate(turns, zero, go))
    return tracks.join(grid, "vid", "left").select("vid", F.posexplode(F.concat(points, F.array("n"))).alias("no", "sample")) \
        .select("vid", F.col("no").cast("bigint").alias("no"), "sample")


def silence_gate(converted: DataFrame, source: DataFrame, rate: int = K.SAMPLE_RATE) -> DataFrame:
    """Mute converted audio where the source is silent, 20 ms around speech kept, 6 ms ramps."""
    win, pad, ramp = int(0.020 * rate), int(0.020 * rate), max(1, int(0.006 * rate))

    def mask(x, o, k):
        loud = np.convolve(x, np.ones(win) / win)[(win - 1) // 2:][:len(x)] > VOICED
        wide = np.convolve(loud.astype(float), np.ones(2 * pad + 1))[pad:pad + len(x)] > 0.5
        soft = np.convolve(wide.astype(float), np.ones(ramp) / ramp)[(ramp - 1) // 2:][:len(x)]
        return np.clip(soft[o:o + k], 0.0, 1.0)

    gates = _with_context(source, win + 2 * pad + ramp).select("vid", "block", _by_block(mask)("ctx", "off", F.size("samples")).alias("_m"))
    pinned = pin_length(converted, source)
    return pinned.join(gates, ["vid", "block"]).withColumn("samples", F.zip_with("samples", "_m", lambda x, m: x * m)).drop("_m")


def pin_length(converted: DataFrame, source: DataFrame) -> DataFrame:
    """Converted blocks at exactly the source's length: zeros where short, cut where long."""
    want = source.select("vid", "block", F.size("samples").alias("_n"))
    have = converted.select("vid", "block", F.col("samples").cast(_DOUBLES).alias("_c"))
    joined = want.join(have, ["vid", "block"], "left").withColumn("_c", F.coalesce("_c", F.array().cast(_DOUBLES)))
    fill = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.col("_n") - F.size("_c")))
    return joined.select("vid", "block", F.slice(F.concat("_c", fill), F.lit(1), F.col("_n")).alias("samples"))


def resample_linear(signal: DataFrame, from_rate: int, to_rate: int, size: int = K.SAMPLE_RATE) -> DataFrame:
    """Linear interpolation onto another rate; end points stay end points.

    Every output block asks for the one to few input blocks under it.
    """
    lengths = signal.groupBy("vid").agg(F.sum(F.size("samples")).cast("bigint").alias("n"))
    out = F.bround(F.col("n") * to_rate / F.lit(from_rate), 0).cast("bigint")
    scale = F.when(F.col("m") > 1, (F.col("n") - 1) / (F.col("m") - 1)).otherwise(F.lit(0.0))
    grid = lengths.withColumn("m", out).where("m > 0").withColumn("scale", scale) \
        .withColumn("out_block", F.explode(F.sequence(F.lit(0).cast("bigint"), _floor_div(F.col("m") - 1, size)))) \
        .withColumn("j0", F.col("out_block") * size).withColumn("j1", F.least(F.col("m"), F.col("j0") + size) - 1) \
        .withColumn("i0", F.floor(F.col("j0") * F.col("scale")).cast("bigint")) \
        .withColumn("i1", F.least(F.col("n") - 1, F.floor(F.col("j1") * F.col("scale")).cast("bigint") + 1))
    need = grid.withColumn("block", F.explode(F.sequence(_floor_div(F.col("i0"), size), _floor_div(F.col("i1"), size))))
    parts = need.join(signal.select("vid", "block", F.col("samples").cast(_DOUBLES).alias("samples")), ["vid", "block"]) \
        .groupBy("vid", "out_block", "n", "scale", "j0", "j1").agg(
            F.sort_array(F.collect_list(X.rec(b=F.col("block"), s=F.col("samples")))).alias("ps"))
    base = F.get("ps", F.lit(0))["b"] * size
    flat = parts.withColumn("xs", F.flatten(F.transform("ps", lambda p: p["s"]))).withColumn("base", base)

    def at(j):
        p = j * F.col("scale")
        i = F.least(F.floor(p).cast("bigint"), F.col("n") - 1)
        lo = F.get("xs", (i - F.col("base")).cast("int"))
        hi = F.coalesce(F.get("xs", (i - F.col("base") + 1).cast("int")), lo)
        return lo + (hi - lo) * (p - i)

    return flat.select("vid", F.col("out_block").alias("block"), F.transform(F.sequence("j0", "j1"), at).alias("samples"))


def quantise(signal: DataFrame) -> DataFrame:
    """Clip to [-1, 1] and to whole 16-bit steps."""
    return signal.withColumn("samples", F.transform("samples", lambda x: (
        F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0)) * 32767).cast("int")))


# ---- measuring ------------------------------------------------------------------------
def level_floor(frames: DataFrame) -> DataFrame:
    """(vid, floor): the upper median level plus a margin, found by counting equal levels."""
    levels = settle(frames.groupBy("vid", "energy").agg(F.count("*").alias("c")))
    ranked = running(levels, {"below": ("sum", F.col("c"))}, order=("energy",), bucket=F.floor(F.col("energy") * 100_000))
    total = frames.groupBy("vid").agg(F.count("*").alias("n"))
    middle = _floor_div(F.col("n"), 2)
    return ranked.join(total, "vid").where((F.col("below") <= middle) & (middle < F.col("below") + F.col("c"))) \
        .select("vid", F.greatest(F.lit(1e-5), F.col("energy") + 1e-4).alias("floor"))


def onset_drift(frames: DataFrame, lines: DataFrame, frame_ms: int = 20) -> DataFrame:
    """(vid, id, drift_ms): first loud frame from 0.35 s before a line's start, NULL if none.

    Lines and loud frames are merged on one time axis read backwards, where the
    next loud frame is a running maximum.
    """
    loud = frames.join(level_floor(frames), "vid").where(F.col("energy") > F.col("floor") * 6) \
        .select("vid", (-F.col("frame") * frame_ms).alias("neg"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("start_ms"))
    asked = lines.select("vid", (-(F.col("start_ms") - 350)).alias("neg"), F.lit(1).alias("kind"), "id", "start_ms")
    axis = loud.unionByName(asked).withColumn("tie", F.coalesce("id", F.lit(-1)))
    merged = running(axis, {"_hit": ("max", F.when(F.col("kind") == 0, F.col("neg")))}, order=("neg", "kind", "tie"),
                     bucket=_floor_div(F.col("neg"), 600_000))
    return merged.where("kind = 1").select("vid", "id", F.abs(-F.col("_hit") - F.col("start_ms")).alias("drift_ms"))


def trim_tail(signal: DataFrame, ends: DataFrame, size: int = K.SAMPLE_RATE, limit: int = K.SAMPLE_RATE) -> DataFrame:
    """Past a track's end keep up to its last voiced sample, a second at most.

    ends: vid, end_sample.
    """
    tagged = signal.join(ends, "vid")
    base = F.col("block") * size
    last = F.array_max(F.filter(F.transform("samples", lambda x, i: F.when(
        (F.abs(x) > VOICED) & (base + i >= F.col("end_sample")) & (base + i < F.col("end_sample") + limit), base + i)), lambda p: p.isNotNull()))
    stops = tagged.groupBy("vid").agg(F.max(F.greatest(F.col("end_sample"), last + 1)).alias("_stop"))
    keep = F.least(F.size("samples").cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.col("_stop") - base)).cast("int")
    return signal.join(stops, "vid").withColumn("samples", F.slice("samples", F.lit(1), keep)).where(F.size("samples") > 0).drop("_stop")


def spoken_seconds(boundaries: DataFrame) -> DataFrame:
    """Spoken length from word boundaries (vid, id, offset, duration in 100 ns ticks)."""
    return boundaries.groupBy("vid", "id").agg((F.max(F.col("offset") + F.col("duration")) / 1e7).alias("seconds"))


def voiced_blocks(signal: DataFrame) -> DataFrame:
    return signal.where(F.exists("samples", lambda x: F.abs(x) > VOICED))
