"""Language of whole transcripts: sparse multinomial logistic regression on TF-IDF character n-grams.

1. Every task counts, over all transcripts that may be learned from, in how many a bucket of n-grams
   stands; the sums are the document frequencies.
2. A bounded sample of them, written once as sparse vectors, is learned from by follow-the-
   regularised-leader with elastic-net penalties, a pass at a time; a pass streams the vectors and
   holds nothing but the two accumulators.
3. A temperature, fitted on the part of the sample that was set apart, makes scores of the margins.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .shingles import slices

LENGTHS = (1, 2, 3, 4)      # code points of an n-gram
BUCKETS = 2**16
UNKNOWN = "und"
SPACED = np.ones(256, bool)  # what counts as white space below 256: all but letters
for _c in range(256):
    SPACED[_c] = not chr(_c).isalpha()


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted different buckets, how often each) of a text's n-grams, lower-cased, with single spaces for what is no letter."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    space = np.zeros(len(code), bool)
    low = code < 256
    space[low] = SPACED[code[low]]
    code = np.where(space, np.uint32(32), code)[~(space & np.r_[False, space[:-1]])]
    found, rolling = [], np.zeros(len(code) + 1, np.uint32)
    for n in LENGTHS:
        if len(code) < n:
            break
        rolling = rolling[:-1] * np.uint32(0x01000193) + code[n - 1:]
        mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        found.append((mixed >> np.uint32(16)).astype(np.uint16))
    every = np.sort(np.concatenate(found), kind="stable")  # sixteen bits: a radix sort
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[first], np.diff(np.r_[first, len(every)])


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and their tf * idf, of length one."""
    bucket, times = grams(text)
    x = times.astype(np.float32) * idf[bucket]
    return bucket, x / max(float(np.sqrt(x @ x)), 1e-12)


def _frequencies(batches):
    """In how many of a task's texts each bucket is; bucket -1 counts the texts."""
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen[grams(text)[0]] += 1
            n += 1
    on = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, on]), pa.array(np.r_[n, seen[on]])], ["bucket", "n"])


def _vectors(idf: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                found = [weighted(t, idf) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("deal"), part.column("lang"), pa.array([b.tobytes() for b, _ in found], pa.binary()),
                     pa.array([x.tobytes() for _, x in found], pa.binary())], ["deal", "lang", "buckets", "x"])
    return run


def weights(z: np.ndarray, n: np.ndarray, p: dict[str, float]) -> np.ndarray:
    """The regularised leader: zero where the first-order sum stays within the l1 penalty."""
    rate = (p["beta"] + np.sqrt(n)) / p["alpha"] + p["l2"]
    return np.where(np.abs(z) <= p["l1"], np.float32(0), (np.sign(z) * p["l1"] - z) / rate).astype(np.float32)


def learn_one(z: np.ndarray, n: np.ndarray, bucket: np.ndarray, x: np.ndarray, label: int, p: dict[str, float]) -> None:
    """One example's step, at the coordinates it has."""
    zb, nb = z[bucket], n[bucket]
    w = weights(zb, nb, p)
    g = np.outer(x, _softmax(x @ w) - np.eye(z.shape[1], dtype=np.float32)[label])
    more = nb + g * g
    z[bucket] = zb + g - (np.sqrt(more) - np.sqrt(nb)) / p["alpha"] * w
    n[bucket] = more


def _softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _rows(batch):
    for lang, b, x in zip(*(batch.column(c).to_pylist() for c in ("lang", "buckets", "x")), strict=True):
        yield lang, np.frombuffer(b, np.uint16), np.frombuffer(x, np.float32)


def _pass(labels: list[str], z: np.ndarray, n: np.ndarray, p: dict[str, float]):
    """One pass over the examples, in the order they were written."""
    index = {name: k for k, name in enumerate(labels)}

    def run(batches):
        zs, ns = z.copy(), n.copy()
        for batch in batches:
            for lang, bucket, x in _rows(batch):
                learn_one(zs, ns, bucket, x, index[lang], p)
        yield pa.RecordBatch.from_arrays([pa.array([zs.tobytes()], pa.binary()), pa.array([ns.tobytes()], pa.binary())], ["z", "n"])
    return run


def _margins(w: np.ndarray):
    def run(batches):
        for batch in batches:
            rows = [(lang, (x @ w[b]).astype(float).tolist()) for lang, b, x in _rows(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
                                             ["lang", "margin"])
    return run


def temperature(margin: np.ndarray, label: np.ndarray) -> float:
    """The temperature with the least log loss; the loss has one minimum in its inverse."""
    def loss(log_t: float) -> float:
        m = margin * math.exp(-log_t)
        m = m - m.max(axis=1, keepdims=True)
        return float((np.log(np.exp(m).sum(axis=1)) - m[np.arange(len(m)), label]).mean())
    low, high, golden = -4.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def _named(labels: list[str], w: np.ndarray, idf: np.ndarray, heat: float):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 256):
                margin = np.array([x @ w[b] for b, x in (weighted(t, idf) for t in part.column("text").to_pylist())])
                share = _softmax(margin / heat)
                best = share.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("vid"), pa.array([labels[k] for k in best], pa.string()), pa.array(share.max(axis=1).astype(float))],
                                                 ["vid", "source_lang", "score"])
    return run


def spoken_language(rows: DataFrame, scratch: Scratch, *, learn: Column | None = None, max_rows: int = 12_000, passes: int = 2,
                    alpha: float = 2.0, beta: float = 0.5, l1: float = 0.02, l2: float = 0.01) -> DataFrame:
    """Per transcript: ``vid, source_lang, score``; the score is the calibrated share of that language.

    ``rows``: ``vid, text, source_lang``; ``learn`` tells which rows may be learned from (default: all), and of those
    the ones with a language are. Frequencies cover them all; the regression takes at most ``max_rows``
    of them, those with the smallest hash of vid and text, a fifth of which sets the temperature.
    Only the text enters a prediction. Memory in a task and at the driver is BUCKETS numbers, twice
    for each language learned, whatever the table's size.

    A NULL text and one without a letter get ``und`` and score 0; so does every text if there is nothing
    to learn from. If there is one language, it is every other text's, with score 1. Of languages with
    equal shares the first by name is taken. A NULL vid is passed on, repeated rows get equal
    results, an empty table gives no rows; other columns are never looked at.
    """
    allowed = (F.lit(True) if learn is None else learn) & F.col("source_lang").isNotNull()
    # the condition may look at any column of the caller's, so it is taken before the others are left out
    rows = rows.select("vid", "text", "source_lang", F.coalesce(allowed, F.lit(False)).alias("learn"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    known = rows.where("learn AND letters")
    counts = known.select("text").mapInArrow(_frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = {r[0]: r[1] for r in counts.collect()}  # BUCKETS numbers at most
    total = counts.pop(-1, 0)
    idf = np.full(BUCKETS, math.log1p(total), np.float32)
    idf[list(counts)] = [math.log((1 + total) / (1 + n)) for n in counts.values()]
    idf += np.float32(0.1)
    nothing = rows.where("NOT letters").select("vid", F.lit(UNKNOWN).alias("source_lang"), F.lit(0.0).alias("score"))
    if not total:
        return rows.select("vid", F.lit(UNKNOWN).alias("source_lang"), F.lit(0.0).alias("score"))

    # rows beyond this share of the hash's range can't be among the smallest, but for a chance of 1e-9
    share = min(1.0, (max_rows + 6 * math.sqrt(max_rows) + 20) / total)
    deal = F.xxhash64("vid", "text")
    sample = known.select("text", F.col("source_lang").alias("lang"), deal.alias("deal"))
    if share < 1:
        sample = sample.where(F.col("deal") < int(-2**63 + share * (2**64 - 1)))
    sample = sample.mapInArrow(_vectors(idf), "deal bigint, lang string, buckets binary, x binary")
    sample = scratch.keep(sample.orderBy("deal", "lang").limit(max_rows).coalesce(1), "sample").orderBy("deal", "lang").coalesce(1)
    train, held = sample.where("pmod(deal, 5) > 0"), sample.where("pmod(deal, 5) = 0")
    labels = [r[0] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    p = {"alpha": alpha, "beta": beta, "l1": l1, "l2": l2}
    z = n = np.zeros((BUCKETS, len(labels)), np.float32)
    for _ in range(passes if len(labels) > 1 else 0):
        done = train.mapInArrow(_pass(labels, z, n, p), "z binary, n binary").collect()[0]  # one row
        z, n = (np.frombuffer(bytes(b), np.float32).reshape(z.shape) for b in done)
    w = weights(z, n, p)
    tried = held.mapInArrow(_margins(w), "lang string, margin array<double>").collect()  # at most max_rows / 5
    heat = temperature(np.array([r[1] for r in tried]), np.array([labels.index(r[0]) for r in tried])) if tried and len(labels) > 1 else 1.0
    named = rows.where("letters").select("vid", "text").mapInArrow(_named(labels, w, idf, heat), f"vid {dict(rows.dtypes)['vid']}, source_lang string, score double")
    return named.unionAll(nothing)
