"""Chained blocks give what one pass over a whole video gives, whatever the block size."""
import random
import re

import pytest

from cuewright.operators import audit as Q
from cuewright.operators import batching as B
from cuewright.operators import library as L
from pyspark.sql import functions as F

LINES = "vid string, id bigint, start_ms bigint, end_ms bigint, text string, en string"


def carried(texts):
    """The state machine line by line: an open quotation reaches into the next line only."""
    out, is_open = [], False
    for en in texts:
        en = (en or "").strip()
        if not en:
            out.append(None)
            continue
        out.append(is_open)
        is_open = not is_open and len(re.findall('["“”]', en)) % 2 == 1
    return out


def scripts(seed):
    """One video with nearly all lines, and some of few."""
    r = random.Random(seed)
    say = lambda: r.choice(['"Wait', 'he said"', "plain words", '"All of it"', "", None, '"', '" " "'])
    videos = {"hot": [say() for _ in range(900)], "odd": ['"'] * 70, "blank": [None] * 40, "one": ['"x'], "u": [say() for _ in range(33)]}
    return videos, [(v, i, 1000 * i, 1000 * i + 900, "Some source words here", en) for v, t in videos.items() for i, en in enumerate(t)]


@pytest.mark.parametrize("size", [2, 16, 4096])
def test_quotations_reach_over_block_edges(spark, size):
    videos, rows = scripts(size)
    got = {(r.vid, r.id): r.inside for r in Q.quote_carry(spark.createDataFrame(rows, LINES), size=size).collect()}
    want = {(v, i): s for v, t in videos.items() for i, s in enumerate(carried(t)) if s is not None}
    assert got == want


@pytest.mark.parametrize("window", [None, (5, 40)])
def test_audit_is_the_same_in_small_blocks(spark, window):
    df = spark.createDataFrame(scripts(1)[1], LINES)
    told = df.select("vid").distinct().withColumn("narrated", F.lit(True))
    small, large = ({(r.vid, r.id): r.faults for r in Q.audit(df, told, window, size=size).collect()} for size in (4, 4096))
    assert small == large and small
    every = {(r.vid, r.id): r.faults for r in Q.audit(df, told, window, every=True, size=4).collect()}
    assert {k: f for k, f in every.items() if f} == small
    assert len(every) == (df if window is None else df.where(F.col("id").between(window[0], window[1] - 1))).count()


def exchanges(df):
    return len(re.findall(r"\bExchange ", df._jdf.queryExecution().executedPlan().toString()))


def test_audit_moves_lines_once(spark):
    df = spark.createDataFrame(scripts(2)[1], LINES)
    told = df.select("vid").distinct().withColumn("narrated", F.lit(True))
    assert exchanges(Q.quote_carry(df)) <= 4 and exchanges(Q.audit(df, told)) <= 8  # counted before reuse and broadcasts


def test_the_later_of_two_rewrites_is_tried(spark):
    df = spark.createDataFrame([("v", 0, 0, 9000, "source words for it", "They went and"), ("v", 1, 9000, 18000, "more words", "Fine words here.")], LINES)
    told = spark.createDataFrame([("v", False)], "vid string, narrated boolean")
    fixes = spark.createDataFrame([("v", 0, 1, "Zebras went home early."), ("v", 0, 2, "All went home early.")], "vid string, id bigint, seq int, new string")
    audited = Q.audit(df, told, every=True)
    assert {r.id: r.en for r in Q.accept_repairs(audited, None, fixes).collect()} == {0: "All went home early.", 1: "Fine words here."}
    assert {r.id: r.en for r in Q.accept_repairs(df, Q.audit(df, told), fixes, told).collect()} == {0: "All went home early.", 1: "Fine words here."}
    assert [tuple(r) for r in Q.polish_stats(None, Q.accept_repairs(audited, None, fixes)).collect()] == [("v", 1, 1)]


def test_bucket_refills_and_a_new_day_begins(spark):
    log = spark.createDataFrame([(1, 100, "k", "m", 200, 3000, "30s", "", 6000), (2, 110, "k", "m", 200, 1000, "50s", "", None),
                                 (3, 120, "k", "m", 429, None, "", "tokens per day (TPD). Please try again in 1m0s.", None)],
                                "event_id long, ts_s long, key_id string, model string, http_status int, remaining long, reset_after string, message string, `limit` long")
    at = lambda now: B.bucket_state(log, now_s=F.lit(now)).first()
    early, late = at(120), at(86_400)
    assert (early["limit"], early["headroom"], early["level"], early["remaining"], early["reset_at_s"]) == (6000, 6000, 2000, 1000, 160.0)
    assert early["exhausted"] == "resets in 1m0s" and late["exhausted"] is None and late["level"] == 6000
    assert B.bucket_state(log.withColumn("limit", F.lit(None).cast("long"))).first()["headroom"] == 8000
    wait = lambda cost: B.bucket_state(log).select(B.would_wait(F.lit(cost), F.lit(130)).alias("w")).first()["w"]
    assert (wait(900), wait(2000)) == (0.0, 30.0)


def test_moments_without_a_line_stay(spark):
    lines = spark.createDataFrame([("v", 0, 0, 1000), ("v", 1, 500, 25_000)], "vid string, id long, start_ms long, end_ms long")
    moments = spark.createDataFrame([("v", 600), ("v", 24_999), ("v", 30_000), ("w", 5)], "vid string, at_ms long")
    assert {(r.vid, r.at_ms): r.id for r in L.line_at(lines, moments).collect()} == {("v", 600): 0, ("v", 24_999): 1, ("v", 30_000): None, ("w", 5): None}


def test_a_batch_of_blocks_needs_its_result_and_little_more(spark):
    """The Python side of the envelope keeps no object per block and no second copy of a batch."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from cuewright.operators.signal import _by_block

    sizes = [400] * 5000 + [0, 7]
    ends = np.r_[0, np.cumsum(sizes)]
    x = np.random.default_rng(1).normal(size=ends[-1])
    ctx = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
    off, n = pa.array([8] * 5000 + [0, 2], pa.int32()), pa.array([384] * 5000 + [0, 3], pa.int32())
    run = _by_block(lambda v, o, k: v[o:o + k] * 2).func
    tracemalloc.start()
    got = run(ctx, off, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[1].as_py() == (np.abs(x[408:792]) * 2).tolist() and got[5000].as_py() == [] and got[5001].as_py() == (np.abs(x[-5:-2]) * 2).tolist()
    assert peak < 1.3 * 8 * len(got.values)
    assert run(ctx.slice(1, 2), off.slice(1, 2), n.slice(1, 2)).to_pylist() == got.slice(1, 2).to_pylist()
