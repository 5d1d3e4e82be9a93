"""Near-duplicate voice embeddings by randomised-rotation binary codes.

A unit vector is rotated at random and kept as its signs, with the inner product of vector and
sign vector as stored correction factor. The signs give an unbiased estimate of an inner product,
and its error is bounded with confidence by the factor: for a pair with cosine s the estimate
differs from s by about sqrt(1 - s^2) * sqrt(1 - f^2) / f / sqrt(d - 1) per standard deviation.
Pairs whose bound stays below the threshold are out; only the others are computed exactly.

Candidates share a language and a band of sign bits. Bits per band grow with the table, and the
number of bands with the bits, so that a pair at the threshold is missed with probability MISS.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, any_ids, components

MISS = 1e-4        # probability that no band holds a pair at the threshold
SIGMAS = 6.0       # standard deviations a pair may lie off its estimate
BLOCK = 1024       # rows of a bucket that one task compares with another BLOCK
GROUP_ROWS = 20_000  # rows dealt to one Python group


def rotation(d: int, number: int) -> np.ndarray:
    """The `number`-th random rotation of d dimensions; the same on every machine."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([d, number])).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _unit(batch: pa.RecordBatch) -> list[bytes | None]:
    """Little-endian doubles of the unit vector, None for a vector that links with nothing."""
    out: list[bytes | None] = []
    for v in batch.column("embedding").to_pylist():
        x = None
        if v and None not in v:
            a = np.array(v, dtype="<f8")
            with np.errstate(over="ignore"):
                top = np.abs(a).max()
                if np.isfinite(a).all() and top > 0:
                    a = a / top
                    x = (a / np.sqrt(a @ a)).tobytes()
        out.append(x)
    return out


def _units(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("voice"), batch.column("language"), pa.array(_unit(batch), pa.binary())],
                                         ["voice", "language", "unit"])


def _plan(rows: int, threshold: float) -> tuple[int, int]:
    """(bits per band, bands) for so many different vectors."""
    bits = max(8, math.ceil(math.log2(max(rows, 2) / 16)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def _coder(bits: int, bands: int):
    def run(batches):
        turns: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            ids, languages = batch.column("voice").to_pylist(), batch.column("language").to_pylist()
            units = [np.frombuffer(u, "<f8") for u in batch.column("unit").to_pylist()]
            out = []
            for i, x in enumerate(units):
                d = max(64, len(x))
                wide = np.zeros(d)
                wide[:len(x)] = x
                signs = []
                for k in range(-(-bits * bands // d)):
                    if (d, k) not in turns:
                        turns[d, k] = rotation(d, k)
                    y = wide @ turns[d, k]
                    signs.append(y > 0)
                    if k == 0:
                        first = y
                bit = np.concatenate(signs)[:bits * bands].reshape(bands, bits)
                keys = bit @ weights
                factor = np.abs(first).sum() / np.sqrt(d)
                step = np.abs(first).max() / 127
                small = np.rint(first / step).astype(np.int8)
                out.append((ids[i], f"{languages[i]}|{len(x)}", keys.tolist(), np.packbits(first > 0).tobytes(), factor, small.tobytes(), step))
            yield pa.RecordBatch.from_pydict(dict(zip(
                ("voice", "room", "keys", "code", "factor", "small", "step"), zip(*out, strict=True), strict=True)), schema=CODE_ARROW) \
                if out else pa.RecordBatch.from_pylist([], schema=CODE_ARROW)
    return run


CODE = "voice bigint, room string, keys array<bigint>, code binary, factor double, small binary, step double"
CODE_ARROW = pa.schema([("voice", pa.int64()), ("room", pa.string()), ("keys", pa.list_(pa.int64())), ("code", pa.binary()),
                        ("factor", pa.float64()), ("small", pa.binary()), ("step", pa.float64())])


def _cells(pdf: pd.DataFrame):
    """(start, end) of each cell of rows sorted by cell."""
    cell = pdf["cell"].to_numpy()
    cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
    return zip(np.r_[0, cuts], np.r_[cuts, len(cell)], strict=True)


def _undecided(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell", kind="stable", ignore_index=True)
        keep = np.zeros(len(pdf), bool)
        for a, b in _cells(pdf):
            if b - a < 2:
                continue
            part = pdf.iloc[a:b]
            bits = np.unpackbits(np.array([np.frombuffer(c, np.uint8) for c in part["code"]]), axis=1)
            d = bits.shape[1]
            signs = (bits.astype(np.float32) * 2 - 1) / np.float32(math.sqrt(d))
            rotated = np.array([np.frombuffer(s, np.int8) for s in part["small"]], dtype=np.float32) * part["step"].to_numpy(np.float32)[:, None]
            factor = part["factor"].to_numpy()
            estimate = (signs @ rotated.T) / factor[:, None]           # row: the signs of o; column: q itself
            spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(d - 1)
            rounding = part["step"].to_numpy()[None, :] * math.sqrt(d) / 2 / factor[:, None]  # q is kept in 8 bits
            least = threshold - SIGMAS * spread[:, None] * math.sqrt(1 - threshold**2) - rounding
            open_ = estimate >= least
            np.fill_diagonal(open_, False)
            open_ &= open_.T
            keep[a:b] = open_.any(1)
        return pdf.loc[keep, ["cell", "band", "voice"]]
    return run


def _exact(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "voice"], kind="stable", ignore_index=True)
        out = []
        for a, b in _cells(pdf):
            if b - a < 2:
                continue
            part = pdf.iloc[a:b]
            ids, copies, band = part["voice"].to_numpy(), part["copies"].to_numpy(), int(part["band"].iloc[0])
            unit = np.array([np.frombuffer(u, "<f8") for u in part["unit"]])
            linked = unit @ unit.T >= threshold
            np.fill_diagonal(linked, False)
            keys = np.array(part["keys"].tolist())
            first = linked.copy()
            for k in range(band):  # a pair counts in the first band that holds it
                first &= keys[:, k][:, None] != keys[:, k][None, :]
            if (low := part["low"].iloc[0]) != (high := part["high"].iloc[0]):
                home = part["block"].to_numpy()
                first &= home[:, None] != home[None, :]  # pairs within a block belong to its own cell
            label = np.arange(b - a)
            while True:  # the smallest row reachable within the cell
                new = np.minimum(label, np.where(linked, label[None, :], b - a).min(1))
                new = new[new]
                if (new == label).all():
                    break
                label = new
            links = (first * copies[None, :]).sum(1)
            some = linked.any(1)
            out.append(pd.DataFrame({"voice": ids[some], "links": links[some], "root": ids[label[some]]}))
        return pd.concat(out) if out else pd.DataFrame({"voice": [], "links": [], "root": []}).astype("int64")
    return run


def _deal(rows: DataFrame, total: int) -> DataFrame:
    return rows.withColumn("deal", F.pmod(F.xxhash64("cell"), F.lit(max(1, -(-total // GROUP_ROWS))))).groupBy("deal")


@any_ids("voice", "component", key="voice")
def near_voices(rows: DataFrame, scratch: Scratch, *, threshold: float = 0.98) -> DataFrame:
    """Per embedding: ``voice, n_links, component, kept``.

    ``rows``: ``voice`` bigint, ``language``, ``embedding`` array of numbers. Two rows are linked if
    they have the same language and length and a cosine of at least ``threshold`` in doubles; every
    link is computed exactly. ``n_links`` counts the other rows linked directly, ``component`` is
    the smallest voice reachable, ``kept`` marks that one. Rows with a NULL language, or a vector
    that is NULL, empty, zero or not finite throughout link with nothing. A NULL voice is its own
    (NULL) component. Repeated rows link with each other. An empty table gives no rows.
    Equal vectors are one vector with a number of copies, so they cost nothing; a bucket of sign
    bits is cut into blocks that are compared pairwise in different tasks.
    """
    base = rows.select(F.col("voice").cast("bigint").alias("voice"), F.col("language").cast("string").alias("language"),
                       F.col("embedding").cast("array<double>").alias("embedding"))
    units = base.mapInArrow(_units, "voice bigint, language string, unit binary") \
        .withColumn("body", F.when(F.col("language").isNotNull() & F.col("unit").isNotNull() & F.col("voice").isNotNull(), F.sha2("unit", 256)))
    units = scratch.keep(units, "units")
    usable = units.where("body IS NOT NULL")
    groups = usable.groupBy("language", "body").agg(F.min("voice").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("unit").alias("unit"))
    groups = scratch.keep(groups, "groups")
    total = groups.count()
    bits, bands = _plan(total, threshold)
    # a voice may come with several vectors: the row that stands for a vector gets a number of its own
    numbered = scratch.keep(groups.select(F.monotonically_increasing_id().alias("voice"), "language", "body", "rep", "copies", "unit"), "numbered")
    codes = scratch.keep(numbered.select("voice", "language", "unit").mapInArrow(_coder(bits, bands), CODE), "codes")
    inside = codes.select("voice", "room", F.posexplode("keys").alias("band", "key"))
    bucket = F.xxhash64("room", "band", "key")
    counts = scratch.keep(inside.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select("bucket", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "counts")
    dealt = counts.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    held = codes.select("voice", "room", "code", "factor", "small", "step", F.posexplode("keys").alias("band", "key")) \
        .withColumn("bucket", bucket).join(counts.drop("n").hint("merge"), "bucket")
    own = F.pmod(F.xxhash64("voice"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(own, o).alias("low"), F.greatest(own, o).alias("high")))
    celled = held.select("voice", "band", "code", "factor", "small", "step", "bucket", F.explode(pairs).alias("p")) \
        .select("voice", "band", "code", "factor", "small", "step", F.xxhash64("bucket", "p.low", "p.high").alias("cell"))
    near = _deal(celled, dealt).applyInPandas(_undecided(threshold), "cell bigint, band int, voice bigint")
    # blocks are part of the cell's name; they are worked out again from the bucket for the exact pass
    near = scratch.keep(near, "undecided")
    where = held.select("voice", "band", own.alias("block"), "bucket", F.explode(pairs).alias("p")) \
        .select("voice", "band", "block", F.col("p.low").alias("low"), F.col("p.high").alias("high"),
                F.xxhash64("bucket", "p.low", "p.high").alias("cell"))
    # Spark takes the size of a file, and one element an array, for the size of rows: it would send these through the driver
    exact = near.hint("merge").join(where, ["cell", "band", "voice"]).join(numbered.select("voice", "copies", "unit").hint("merge"), "voice") \
        .join(codes.select("voice", "keys").hint("merge"), "voice")
    linked = _deal(exact, near.count()).applyInPandas(_exact(threshold), "voice bigint, links bigint, root bigint")
    linked = scratch.keep(linked, "linked")
    links = linked.groupBy("voice").agg(F.sum("links").alias("links"))
    reps = numbered.select("voice", "language", "body", "rep", "copies")
    name = reps.select(F.col("voice").alias("a"), F.col("rep").alias("ra"))
    edges = linked.select("voice", "root").where("voice <> root").distinct() \
        .join(name, F.col("voice") == F.col("a")).join(name.select(F.col("a").alias("b"), F.col("ra").alias("rb")), F.col("root") == F.col("b")) \
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    # rows of one voice belong together through the voice itself
    found = components(edges, scratch, "voices")
    known = reps.join(links, "voice", "left").join(found, F.col("rep") == F.col("id"), "left") \
        .select("language", "body", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component"))
    out = usable.select("voice", "language", "body").join(known, ["language", "body"]).select("voice", "n_links", "component")
    alone = units.where("body IS NULL").select("voice", F.lit(0).cast("bigint").alias("n_links"), F.col("voice").alias("component"))
    return out.unionByName(alone).withColumn("kept", F.col("voice").eqNullSafe(F.col("component")))
