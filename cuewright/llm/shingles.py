"""Word hashes and five-word shingles of whole texts, vectorised over bytes (runs inside tasks).

A word is a run of bytes above 0x20 of the UTF-8 text, A-Z as a-z.
"""
from __future__ import annotations

import numpy as np

WORDS = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, factor in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _TABLES[name] = np.cumprod(steps)
    return _TABLES["up"], _TABLES["down"]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text and in all)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum(np.array([len(x) + 1 for x in raw], np.int64)) if raw else np.zeros(0, np.int64)
    inside = data > 32
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, stops = edge[::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * up[:len(data)], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * down[starts])
    return hashes, np.r_[0, np.searchsorted(starts, ends)]


def places(texts: list[str]) -> np.ndarray:
    """[word, (start, end)] of the words of all texts, in code points of their text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff((data > 32).view(np.int8), prepend=0))
    begin = np.r_[0, np.cumsum([len(x) + 1 for x in raw])]
    point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte
    text = np.searchsorted(begin, edge, side="right") - 1
    return (point[edge] - point[begin[text]]).reshape(-1, 2)


def shingles(word: np.ndarray) -> np.ndarray:
    """Hashes of a text's shingles in order; a text of fewer than five words is one shingle, one of none has none."""
    n = len(word)
    if n < WORDS:
        return mix(np.array([(word * PLACES[:n]).sum() + np.uint64(n)], np.uint64)) if n else np.zeros(0, np.uint64)
    total = word[:n - WORDS + 1] * PLACES[0]
    for j in range(1, WORDS):
        total = total + word[j:n - WORDS + 1 + j] * PLACES[j]
    return mix(total)


def counted(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted different shingles, how often each) of every text."""
    word, at = words(texts)
    return [np.unique(shingles(word[a:b]), return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]


def slices(batch, most_rows: int = 512, most_bytes: int = 2_000_000):
    """Cut an Arrow batch with a `text` column into pieces of bounded text."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("text"))))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, min(start + most_rows, int(np.searchsorted(sizes, before + most_bytes, side="right"))))
        yield batch.slice(start, end - start)
        start = end
