"""SentencePiece encoding and decoding of whole transcripts by a streaming Viterbi.

The best segmentation maximises the sum of the pieces' scores. Positions are read one after the
other; only a window as long as the longest piece can still be extended. As soon as the paths of
all open positions run through one boundary, everything before it is final: its ids are committed
and the trellis before it is dropped.
"""
from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_ids, transcripts

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
CHECK_EVERY = 64      # positions between two looks for a common boundary
REMEMBER = 700_000    # segments a worker remembers; later ones are encoded each time
NO_PATH = -1e300
MISSING = object()


class PieceModel:
    """Pieces and scores of a model file; bytes stand in for characters without a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.ids = {self.text[i]: (model.get_score(i), i) for i in plain}
        # every beginning of a piece; None where it is no piece itself
        self.table: dict[str, tuple[float, int] | None] = {p[:k]: None for p in self.ids for k in range(1, len(p))}
        self.table.update(self.ids)
        self.pairs = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        self.fallback = min(s for s, _ in self.ids.values()) - 10.0
        # no piece has a space mark after another character: every path then ends before the mark
        self.breaks = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.raw = [bytes((self.byte_of[i],)) if i in self.byte_of else self.text[i].encode() for i in range(size)]
        self.memory: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; ties go to the longer last piece."""
        get, longest = self.table.get, self.longest
        out: list[int] = []
        base, n = 0, len(text)          # committed up to base
        best, back = [0.0], [(0, -1)]   # by position from base on: score, (start of the last piece, its id)
        for i in range(n):
            at = i - base
            if len(best) <= at + longest:
                best += [NO_PATH] * (CHECK_EVERY + longest)
                back += [(-1, -1)] * (CHECK_EVERY + longest)
            here = best[at]
            for size in range(1, min(longest, n - i) + 1):
                hit = get(text[i:i + size], MISSING)
                if hit is MISSING or hit is None:
                    if size == 1 and here + self.fallback > best[at + 1]:
                        best[at + 1], back[at + 1] = here + self.fallback, (i, -1)
                    if hit is None:     # only the beginning of pieces
                        continue
                    break
                score = here + hit[0]
                if score > best[at + size]:
                    best[at + size], back[at + size] = score, (i, hit[1])
            if i - base >= CHECK_EVERY and i % longest == 0:
                common = self._common(back, base, i + 1)
                if common > base:
                    out += self._path(text, back, base, common)
                    shift = best[common - base]
                    best = [s - shift if s > NO_PATH else s for s in best[common - base:]]
                    back = back[common - base:]
                    base = common
        return out + self._path(text, back, base, n)

    def _common(self, back, base: int, first: int) -> int:
        """The last boundary on the paths to every position from `first` on that has one by now.

        Later pieces start at `first` or behind it, so every complete path runs through one of these.
        """
        heads = {p for p in range(first, base + len(back)) if back[p - base][0] >= 0}
        while len(heads) > 1:
            last = max(heads)
            heads.remove(last)
            heads.add(max(base, back[last - base][0]))
        return heads.pop()

    def _path(self, text: str, back, base: int, end: int) -> list[int]:
        rev: list[int] = []
        while end > base:
            start, piece = back[end - base]
            if piece >= 0:
                rev.append(piece)
            else:
                raw = text[start:end].encode("utf-8", "surrogatepass")
                rev += [self.bytes.get(b, self.unknown) for b in reversed(raw)]
            end = start
        return rev[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers; white space is kept, one space mark is put in front (none in an empty text)."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        segments = SEGMENT.findall(marked) if self.breaks else [marked]
        memory = self.memory
        for s in segments:
            if s not in memory:
                break
        else:
            return b"".join([memory[s] for s in segments])
        out = []
        for s in segments:
            ids = memory.get(s)
            if ids is None:
                ids = self._fresh(s)
                if len(memory) < REMEMBER and len(s) <= 32:
                    memory[s] = ids
            out.append(ids)
        return b"".join(out)

    def _fresh(self, segment: str) -> bytes:
        """Ids of a new segment, cut where no piece joins two neighbours: every path ends there."""
        cuts = [k for k in range(1, len(segment)) if segment[k - 1:k + 1] not in self.pairs]
        if not cuts:
            return array("i", self.viterbi(segment)).tobytes()
        parts = [segment[a:b] for a, b in zip([0, *cuts], [*cuts, len(segment)], strict=True)]
        return b"".join([self.memory.get(p) or array("i", self.viterbi(p)).tobytes() for p in parts])

    def decode(self, ids) -> str:
        """The text of the ids; invalid UTF-8 becomes U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


@any_ids("vid")
def encode(rows: DataFrame, *, model: str) -> DataFrame:
    """``vid, ids array<int>`` per transcript. A NULL or empty text has no ids; a NULL vid is passed on.

    ``model``: a SentencePiece file. Repeated rows are encoded each. A space mark in the text itself
    reads as a space when decoded; apart from that ``decode`` gives the text back.
    """
    def run(batches):
        m = _model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [m.encode(t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("vid"), lists], ["vid", "ids"])
    return transcripts(rows).mapInArrow(run, "vid bigint, ids array<int>")


@any_ids("vid")
def decode(rows: DataFrame, *, model: str) -> DataFrame:
    """``vid, ids, text`` for rows of ``vid, ids``; NULL ids decode to an empty text."""
    def run(batches):
        m = _model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                yield pa.RecordBatch.from_arrays(
                    [part.column("vid"), ids, pa.array([m.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in ids], pa.string())],
                    ["vid", "ids", "text"])
    return rows.select(F.col("vid").cast("bigint").alias("vid"), "ids").mapInArrow(run, "vid bigint, ids array<int>, text string")
