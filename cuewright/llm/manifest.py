"""Merkle manifest of a library's lines, as a tree of SHA-256 midstates.

Lines are the leaves; every video has a subtree over its lines in the order of their ids, and the
subroots, in the order of the videos, have a tree of their own. A parent keeps the hash state before
each of its children, so a changed line is folded up by resuming the state at its slot with the new
digest and the right siblings only; what lies left of it is never hashed again.

Places come from a sample sort, each level is one grouping by (tree, place / fanout), sixteen times
smaller than the one below, and paths are handed down the same levels.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.plans.ranking import ranked

from . import midstates
from .common import Scratch
from .midstates import DIGEST

LINE_FIELDS = ("vid", "id", "start_ms", "end_ms", "text", "en")
FANOUT = 16
RUNS = 512  # parents looked at together in a task
RESULT = "leaf string, subroot string, proof_sha256 string, folded_root string"


def leaf_text(fields: dict[str, Column]) -> Column:
    """What a leaf hashes: per field ``-`` if NULL, else its UTF-8 byte count, ``:`` and the value."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return F.concat(*[part(c) for c in fields.values()])


def _digests(column: pa.Array) -> np.ndarray:
    """[n, 32] bytes of a binary column without NULLs, every value whole digests."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8, at[-1] - at[0], at[0]).reshape(-1, DIGEST) if body is not None and at[-1] > at[0] \
        else np.zeros((0, DIGEST), np.uint8)


def _binary(rows: np.ndarray, per: np.ndarray | None = None) -> pa.Array:
    """A binary column of [n, 32] bytes: a digest each or, with ``per``, so many digests each."""
    ends = np.cumsum(per if per is not None else np.ones(len(rows), int)) * DIGEST
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _padded(rows: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """[n, width, 32]: each row's digests from the left."""
    out = np.zeros((len(sizes), width, DIGEST), np.uint8)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rows
    return out


def _parents(fanout: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, RUNS):
                part = batch.slice(at, RUNS)
                items = part.column("items")
                sizes = np.diff(np.asarray(items.offsets))
                children = _digests(items.flatten().field("digest"))
                digest, states = midstates.parents(_padded(children, sizes, fanout), sizes)
                lone = (sizes == 1) & (np.asarray(part.column("at")) == 0)  # the only node of its level
                digest[lone] = children[(np.cumsum(sizes) - sizes)[lone]]
                kept = np.arange(fanout) < sizes[:, None]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _binary(children, sizes), _binary(states[kept], sizes), _binary(digest), pa.array(lone)],
                    [*part.schema.names, "children", "states", "digest", "lone"])
    return run


def _grow(nodes: DataFrame, scratch: Scratch, name: str, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of the trees over ``nodes`` (tree, at, digest, ...), and (tree, digest, height) of their tops.

    ``nodes``' further columns are kept in the lowest level's items.
    """
    levels, tops = [], None
    while True:
        slot = F.pmod("at", F.lit(fanout)).cast("int").alias("slot")
        rest = [c for c in nodes.columns if c not in ("tree", "at", "digest")]
        runs = nodes.groupBy("tree", F.floor(F.col("at") / fanout).alias("at")).agg(
            F.sort_array(F.collect_list(F.struct(slot, "digest", *rest))).alias("items"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema.fields)
        level = scratch.keep(runs.mapInArrow(_parents(fanout), schema + ", children binary, states binary, digest binary, lone boolean"),
                             f"{name}-{len(levels) + 1}")
        top = level.where("lone").select("tree", "digest", F.lit(len(levels)).alias("height"))
        tops = top if tops is None else tops.unionAll(top)
        levels.append(level)
        nodes = level.where("NOT lone").select("tree", "at", "digest")
        if not nodes.take(1):
            return levels, tops


def _down(levels: list[DataFrame], tops: DataFrame, lowest: int, fanout: int) -> DataFrame:
    """(tree, at, subroot, path) of the nodes of height ``lowest``.

    ``tops``: (tree, height, subroot, path). A path has a step per level above: slot and number of
    children, the state before the slot, the siblings from left to right.
    """
    at_top = lambda h: tops.where(F.col("height") == h).select("tree", F.lit(0).cast("bigint").alias("at"), "subroot", "path")
    paths = at_top(len(levels) - 1)
    for height in range(len(levels) - 1, lowest, -1):
        level = levels[height - 1].where("NOT lone").alias("l").join(
            paths.alias("p"), F.col("l.tree").eqNullSafe(F.col("p.tree")) & (F.col("l.at") == F.col("p.at"))) \
            .select("l.tree", "l.at", "l.children", "l.states", F.size("l.items").alias("n"), "p.subroot", "p.path")
        child = level.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
        first, size = F.col("slot") * DIGEST, F.lit(DIGEST)
        step = F.struct(
            "n", "slot", F.substring("states", first + 1, size).alias("state"),
            F.concat(F.substring("children", F.lit(1), first),
                     F.substring("children", first + DIGEST + 1, (F.col("n") - F.col("slot") - 1) * DIGEST)).alias("siblings"))
        paths = child.select("tree", (F.col("at") * fanout + F.col("slot")).alias("at"), "subroot",
                             F.concat(F.array(step), F.col("path")).alias("path")).unionAll(at_top(height - 1))
    return paths


STEP = "array<struct<n:int,slot:int,state:binary,siblings:binary>>"


def _fold(fanout: int):
    """Every line's proof and its fold: the current digest taken up through the kept states."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, RUNS):
                part = batch.slice(at, RUNS)
                items, path = part.column("items"), part.column("path")
                sizes, depth = np.diff(np.asarray(items.offsets)), np.diff(np.asarray(path.offsets))
                flat, steps = items.flatten(), path.flatten()
                leaf, now = _digests(flat.field("digest")), _digests(flat.field("now"))
                run_of = np.repeat(np.arange(len(sizes)), sizes)
                slot = np.arange(len(leaf)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                value = now.copy()
                inner = np.flatnonzero(~np.asarray(part.column("lone"), dtype=bool)[run_of])
                if len(inner):
                    r, s = run_of[inner], slot[inner]
                    children, states = _padded(leaf, sizes, fanout), _padded(_digests(part.column("states")), sizes, fanout)
                    right = np.take_along_axis(children[r], np.minimum(s[:, None] + 1 + np.arange(fanout), fanout - 1)[:, :, None], axis=1)
                    value[inner] = midstates.refold(states[r, s], now[inner], right, sizes[r] - s - 1, sizes[r])
                # lines of a parent whose fold is the same so far go up together
                key = np.hstack([run_of.astype(">u4").view(np.uint8).reshape(-1, 4), value]).view("V36").ravel()
                _, first, back = np.unique(key, return_index=True, return_inverse=True)
                up, up_run = value[first], run_of[first]
                step_at, n_step = np.cumsum(depth) - depth, np.asarray(steps.field("n"))
                slot_step, state_step = np.asarray(steps.field("slot")), _digests(steps.field("state"))
                siblings = steps.field("siblings").to_pylist()
                for k in range(int(depth.max(initial=0))):
                    on = np.flatnonzero(depth[up_run] > k)
                    i = step_at[up_run[on]] + k
                    used, inverse = np.unique(i, return_inverse=True)
                    right = [siblings[j][DIGEST * slot_step[j]:] for j in used]
                    many = n_step[used] - 1 - slot_step[used]
                    right = _padded(np.frombuffer(b"".join(right), np.uint8).reshape(-1, DIGEST), many, fanout)
                    up[on] = midstates.refold(state_step[i], up[on], right[inverse], many[inverse], n_step[i])
                above = [b"".join(siblings[a:a + d]).hex() for a, d in zip(step_at, depth, strict=True)]
                proofs = []
                for a, n, tail, lone in zip(np.cumsum(sizes) - sizes, sizes, above, part.column("lone").to_pylist(), strict=True):
                    own = leaf[a:a + n].tobytes().hex()
                    proofs += [hashlib.sha256((("" if lone else own[:64 * j] + own[64 * j + 64:]) + tail).encode()).hexdigest() for j in range(n)]
                hexes = lambda rows: [x.hex() for x in map(bytes, rows)]
                row = pa.array(run_of)
                yield pa.RecordBatch.from_arrays(
                    [part.column("tree").take(row), flat.field("id"), pa.array(hexes(leaf), pa.string()), part.column("subroot").take(row),
                     pa.array(proofs, pa.string()), pa.array(hexes(up[back]), pa.string())],
                    ["vid", "id", "leaf", "subroot", "proof_sha256", "folded_root"])
    return run


class Manifest:
    """A sealed library: ``root`` (hex, None without lines) and the tables of its trees.

    ``fanout``: children of a parent. ``levels``: per level (tree, at, items, children, states, digest,
    lone), a tree being a video; ``tops``: (tree, digest, height).
    """

    def __init__(self, lines: DataFrame, scratch: Scratch, *, fields: tuple[str, ...] = LINE_FIELDS,
                 now: dict[str, Column] | None = None, fanout: int = FANOUT):
        columns = {f: F.col(f) for f in fields}
        leaf = F.sha2(leaf_text(columns).cast("binary"), 256)
        changed = F.lit(False)
        for f, c in (now or {}).items():
            changed = changed | ~c.eqNullSafe(F.col(f))
        current = F.when(changed, F.sha2(leaf_text({**columns, **(now or {})}).cast("binary"), 256)) if now else F.lit(None)
        rows = lines.select(F.col("vid").alias("tree"), "id", F.unhex(leaf).alias("digest"), F.unhex(current.cast("string")).alias("now"))
        rows = scratch.keep(rows.withColumn("now", F.coalesce("now", "digest")), "leaves")
        placed = ranked(rows, "at", ("id", "digest", "now"), keys=("tree",), keep=lambda df: scratch.keep(df, "ranked"))
        self.fanout = fanout
        self.levels, self.tops = _grow(placed, scratch, "lines", fanout)
        subroots = self.tops.select(F.lit(0).alias("whole"), "tree", "digest", "height")
        subroots = ranked(subroots, "at", ("tree",), keys=("whole",), keep=lambda df: scratch.keep(df, "subroots"))
        self.above, root = _grow(subroots.select(F.col("whole").alias("tree"), "at", "digest"), scratch, "videos", fanout)
        top = root.select("digest").first()  # one row
        self.root = bytes(top[0]).hex() if top else None
        start = root.select("tree", "height", F.lit("").alias("subroot"), F.array().cast(STEP).alias("path"))
        self.heads = subroots.alias("s").join(_down(self.above, start, 0, fanout).alias("p"), F.col("s.at") == F.col("p.at")).select(
            F.col("s.tree").alias("tree"), F.col("s.height").alias("height"), F.lower(F.hex("s.digest")).alias("subroot"), F.col("p.path").alias("path"))

    def check(self) -> DataFrame:
        """Per line: ``vid, id, leaf, subroot, root, proof_sha256, folded_root, verified``."""
        runs, paths = self.levels[0], _down(self.levels, self.heads, 1, self.fanout)
        one = self.heads.where("height = 0").select("tree", F.lit(0).cast("bigint").alias("at"), "subroot", "path")
        paths = paths.where("at IS NOT NULL").withColumn("lone", F.lit(False)).unionAll(one.withColumn("lone", F.lit(True)))
        rows = runs.alias("r").join(paths.alias("p"), F.col("r.tree").eqNullSafe(F.col("p.tree")) & (F.col("r.at") == F.col("p.at"))
                                    & (F.col("r.lone") == F.col("p.lone"))) \
            .select("r.tree", "r.items", "r.states", "r.lone", "p.subroot", "p.path")
        types = dict(runs.selectExpr("tree", "items[0].id AS id").dtypes)
        out = rows.mapInArrow(_fold(self.fanout), f"vid {types['tree']}, id {types['id']}, {RESULT}")
        return out.select("vid", "id", "leaf", "subroot", F.lit(self.root).cast("string").alias("root"), "proof_sha256", "folded_root",
                          (F.col("folded_root") == F.lit(self.root).cast("string")).alias("verified"))


def manifest(lines: DataFrame, scratch: Scratch, *, fields: tuple[str, ...] = LINE_FIELDS,
             now: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Per line: ``vid, id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``lines``: one row per line, with ``vid``, ``id`` and ``fields``, which are what a leaf hashes, in
    that order. ``now``: fields whose current value differs from the sealed one; the current leaf is
    folded up the kept states, and ``verified`` tells whether that gives the sealed root. Hashes are
    lowercase hex. ``proof_sha256`` hashes the siblings' digests from the line's level to the root.

    A video's lines ascend by id (NULL first); lines with one id ascend by their digest, repeated rows
    are a leaf each. A NULL vid is a video of its own, the first one. A NULL field hashes as ``-``, an
    empty text as ``0:``. A level's last parent may have fewer children, even one; a video with one
    line has it as its subroot. An empty table gives no rows; other columns are never looked at.
    """
    return Manifest(lines, scratch, fields=fields, now=now, fanout=fanout).check()
