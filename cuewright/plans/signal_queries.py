"""Signal queries: embeddings read as audio, 64 samples a block, twenty blocks a track."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signal as M
from . import views as V
from .registry import query

SIZE = 64


def _signal(spark, sf_dir):
    """Every third block is silent at its front half, every fifth wholly."""
    e = V.table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v, i: F.when((F.col("vec_id") % 5 == 0) | ((F.col("vec_id") % 3 == 0) & (i < 32)), F.lit(0.0)).otherwise(v.cast("double")))
    return e.select(F.floor(F.col("vec_id") / 20).cast("bigint").alias("vid"), (F.col("vec_id") % 20).alias("block"), x.alias("samples"))


SIG = """sig AS (SELECT vec_id // 20 AS vid, vec_id % 20 AS block, i - 1 AS i, vec_id % 20 * 64 + i - 1 AS pos,
  CASE WHEN vec_id % 5 = 0 OR (vec_id % 3 = 0 AND i <= 32) THEN 0.0::DOUBLE ELSE CAST(embedding[i] AS DOUBLE) END AS x
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
tr AS (SELECT vid, count(*) AS n FROM sig GROUP BY vid)"""


def flat(df, digits=5):
    """One row per sample, rounded to whole steps, for comparison."""
    step = float(10 ** digits)
    return df.select("vid", "block", F.posexplode("samples").alias("i", "x")).select(
        "vid", "block", F.col("i").cast("bigint").alias("i"), F.floor(F.col("x") * step + 0.5).cast("bigint").alias("x"))


def rnd(x, digits=5):
    return f"CAST(floor(({x}) * {float(10 ** digits)}::DOUBLE + 0.5) AS BIGINT)"


def _clips(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 20).cast("bigint").alias("vid"), F.col("vec_id").alias("id"), (F.col("vec_id") % 20 * 50 - 20 + F.when(F.col("vec_id") % 20 >= 10, 640).otherwise(0)).alias("start_sample"), F.col("embedding").alias("samples"))


@query("m01_mix_timeline", f"""WITH c AS (SELECT vec_id // 20 AS vid, greatest(0, vec_id % 20 * 50 - 20 + CASE WHEN vec_id % 20 >= 10 THEN 640 ELSE 0 END) + i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
s AS (SELECT vid, pos, sum(x) AS x FROM c GROUP BY ALL), b AS (SELECT vid, unnest(range(max(pos) // 64 + 1)) AS block FROM s GROUP BY vid), g AS (SELECT vid, block, unnest(range(64)) AS i FROM b)
SELECT g.vid, g.block, g.i, {rnd('coalesce(x, 0)')} AS x FROM g LEFT JOIN s ON s.vid = g.vid AND s.pos = g.block * 64 + g.i""")
def _(spark, sf_dir):
    return flat(M.mix_timeline(_clips(spark, sf_dir), SIZE))


@query("m02_peak_limit", f"""WITH {SIG}, loud AS (SELECT vid, block, i, x * 2 AS x FROM sig), pk AS (SELECT vid, max(abs(x)) AS p FROM loud GROUP BY vid)
SELECT l.vid, block, i, {rnd('CASE WHEN p > 0.995::DOUBLE THEN x * (0.995::DOUBLE / p) ELSE x END')} AS x FROM loud l JOIN pk ON l.vid = pk.vid""")
def _(spark, sf_dir):
    return flat(M.peak_limit(_signal(spark, sf_dir).withColumn("samples", F.transform("samples", lambda x: x * 2))))


@query("m03_fade", f"""WITH {SIG} SELECT vid, block, i, {rnd('x * CASE WHEN i < 8 THEN i / 7.0::DOUBLE ELSE 1 END * CASE WHEN i >= 56 THEN (63 - i) / 7.0::DOUBLE ELSE 1 END')} AS x FROM sig""")
def _(spark, sf_dir):
    return flat(M.fade(_signal(spark, sf_dir), 8.0, 1000))


_RAMPS = "CASE WHEN i < {n} THEN i / {k}.0::DOUBLE ELSE 1 END * CASE WHEN i >= {m} THEN ({e} - i) / {k}.0::DOUBLE ELSE 1 END"


@query("m03_fit_clip", f"""WITH {SIG} SELECT vid, block, i, {rnd('x * CASE WHEN block % 3 = 1 THEN ' + _RAMPS.format(n=20, k=19, m=20, e=39) + ' ELSE '
  + _RAMPS.format(n=8, k=7, m=56, e=63) + ' END')} AS x FROM sig WHERE block % 3 <> 1 OR i < 40""")
def _(spark, sf_dir):
    """Every third clip has room for 40 of its 64 samples, every third for more, every third no limit."""
    limit = F.when(F.col("block") % 3 == 1, 40.0).when(F.col("block") % 3 == 2, 100.0)
    return flat(M.fit_clip(_signal(spark, sf_dir).withColumn("limit_ms", limit), 1000))


FRAMES = "fr AS (SELECT vid, pos // 16 AS frame, avg(abs(x)) AS energy FROM sig GROUP BY ALL)"


@query("m04_energy_frames", f"WITH {SIG}, {FRAMES} SELECT vid, frame, {rnd('energy')} AS x FROM fr")
def _(spark, sf_dir):
    return M.energy_frames(_signal(spark, sf_dir), 16, SIZE).select("vid", "frame", F.floor(F.col("energy") * 100000.0 + 0.5).cast("bigint").alias("x"))


ENV = """ev AS (SELECT vid, block, i, pos, sum(abs(x)) OVER (PARTITION BY vid ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8 AS e FROM sig)"""


@query("m05_moving_env", f"WITH {SIG}, {ENV} SELECT vid, block, i, {rnd('e')} AS x FROM ev")
def _(spark, sf_dir):
    env = M.moving_env(_signal(spark, sf_dir), 8)
    return flat(env.select("vid", "block", F.col("env").alias("samples")))


RUNS = """qt AS (SELECT vid, pos, pos - row_number() OVER (PARTITION BY vid ORDER BY pos) AS isl FROM ev WHERE e < 1e-5::DOUBLE),
rn AS (SELECT vid, min(pos) AS s, max(pos) + 1 AS e FROM qt GROUP BY vid, isl)"""


@query("m06_silent_runs", f"WITH {SIG}, {ENV}, {RUNS} SELECT vid, s, e FROM rn")
def _(spark, sf_dir):
    return M.silent_runs(M.moving_env(_signal(spark, sf_dir), 8), SIZE)


@query("m06_cut_points", f"""WITH RECURSIVE {SIG}, {ENV}, {RUNS},
cp AS (SELECT vid, n, CAST(0 AS BIGINT) AS no, CAST(0 AS BIGINT) AS sp FROM tr
  UNION ALL SELECT c.vid, c.n, c.no + 1, coalesce(max({{'l': least(r.e, least(c.n - 1, c.sp + 400)) - greatest(r.s, greatest(c.sp + 75, c.sp + 200)),
      'm': -greatest(r.s, greatest(c.sp + 75, c.sp + 200))}}).l // 2 - max({{'l': least(r.e, least(c.n - 1, c.sp + 400)) - greatest(r.s, greatest(c.sp + 75, c.sp + 200)),
      'm': -greatest(r.s, greatest(c.sp + 75, c.sp + 200))}}).m, least(c.sp + 300, c.n - 1))
  FROM cp c LEFT JOIN rn r ON r.vid = c.vid AND least(r.e, least(c.n - 1, c.sp + 400)) - greatest(r.s, greatest(c.sp + 75, c.sp + 200)) >= 20
  WHERE c.n > 300 AND c.sp + 300 < c.n - 75 GROUP BY c.vid, c.n, c.no, c.sp)
SELECT vid, no, sp AS sample FROM cp UNION ALL SELECT vid, max(no) + 1, max(n) FROM cp GROUP BY vid""")
def _(spark, sf_dir):
    sig = _signal(spark, sf_dir)
    runs = M.silent_runs(M.moving_env(sig, 8), SIZE)
    tracks = sig.groupBy("vid").agg(F.sum(F.size("samples")).alias("n"))
    return M.cut_points(runs, tracks, rate=100, step_s=3.0, min_gap_s=0.2)


def _converted(spark, sf_dir):
    """A conversion with a noise bed that loses its last block and some samples."""
    sig = _signal(spark, sf_dir)
    n = F.when(F.col("block") % 7 == 3, 60).otherwise(64)
    return sig.where("block < 19").withColumn("samples", F.slice(F.transform("samples", lambda x: x + 0.01), F.lit(1), n))


CONV = "cv AS (SELECT vid, block, i, pos, CASE WHEN block = 19 OR (block % 7 = 3 AND i >= 60) THEN 0 ELSE x + 0.01::DOUBLE END AS y FROM sig)"
GATE = """lo AS (SELECT vid, pos, CASE WHEN sum(abs(x)) OVER (PARTITION BY vid ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8 > 1e-5::DOUBLE THEN 1 ELSE 0 END AS k FROM sig),
wd AS (SELECT vid, pos, max(k) OVER (PARTITION BY vid ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS k FROM lo),
gt AS (SELECT vid, pos, sum(k) OVER (PARTITION BY vid ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 0 FOLLOWING) / 2.0::DOUBLE AS g FROM wd)"""


@query("m07_silence_gate", f"WITH {SIG}, {CONV}, {GATE} SELECT cv.vid, block, i, {rnd('y * g')} AS x FROM cv JOIN gt ON gt.vid = cv.vid AND gt.pos = cv.pos")
def _(spark, sf_dir):
    return flat(M.silence_gate(_converted(spark, sf_dir), _signal(spark, sf_dir), rate=400))


@query("m08_pin_length", f"WITH {SIG}, {CONV} SELECT vid, block, i, {rnd('y')} AS x FROM cv")
def _(spark, sf_dir):
    return flat(M.pin_length(_converted(spark, sf_dir), _signal(spark, sf_dir)))


@query("m09_resample_linear", f"""WITH {SIG}, g AS (SELECT vid, n, CAST(round_even(n * 150 / 100.0, 0) AS BIGINT) AS m FROM tr),
j AS (SELECT vid, n, m, unnest(range(m)) AS j FROM g), p AS (SELECT *, j * ((n - 1)::DOUBLE / (m - 1)) AS p FROM j), q AS (SELECT *, least(CAST(floor(p) AS BIGINT), n - 1) AS k FROM p)
SELECT q.vid, j // 64 AS block, j % 64 AS i, {rnd('a.x + (coalesce(b.x, a.x) - a.x) * (p - k)')} AS x FROM q JOIN sig a ON a.vid = q.vid AND a.pos = q.k LEFT JOIN sig b ON b.vid = q.vid AND b.pos = q.k + 1""")
def _(spark, sf_dir):
    return flat(M.resample_linear(_signal(spark, sf_dir), 100, 150, SIZE))


@query("m10_quantise", f"WITH {SIG} SELECT vid, block, i, CAST(trunc(least(greatest(x * 9, -1), 1) * 32767) AS BIGINT) AS x FROM sig")
def _(spark, sf_dir):
    q = M.quantise(_signal(spark, sf_dir).withColumn("samples", F.transform("samples", lambda x: x * 9)))
    return q.select("vid", "block", F.posexplode("samples").alias("i", "x")).select("vid", "block", F.col("i").cast("bigint").alias("i"), F.col("x").cast("bigint").alias("x"))


@query("m11_onset_drift", f"""WITH {SIG}, {FRAMES}, fl AS (SELECT vid, greatest(1e-5::DOUBLE, energy + 1e-4::DOUBLE) AS floor FROM
  (SELECT vid, energy, row_number() OVER (PARTITION BY vid ORDER BY energy) - 1 AS k, count(*) OVER (PARTITION BY vid) AS n FROM fr) WHERE k = n // 2),
ld AS (SELECT fr.vid, frame * 20 AS t FROM fr JOIN fl ON fr.vid = fl.vid WHERE energy > floor / 4 * 6),
ln AS (SELECT vid, block AS id, block * 80 + 17 AS start_ms FROM sig WHERE i = 0)
SELECT ln.vid, id, abs(min(t) - start_ms) AS drift_ms FROM ln LEFT JOIN ld ON ld.vid = ln.vid AND t >= start_ms - 350 GROUP BY ln.vid, id, start_ms""".replace("floor / 4 * 6", "floor * 6").replace("avg(abs(x)) AS energy", "CASE WHEN pos // 16 % 3 = 0 THEN avg(abs(x)) ELSE avg(abs(x)) / 1000 END AS energy").replace("GROUP BY ALL)", "GROUP BY vid, pos // 16)"))
def _(spark, sf_dir):
    frames = M.energy_frames(_signal(spark, sf_dir), 16, SIZE) \
        .withColumn("energy", F.when(F.col("frame") % 3 == 0, F.col("energy")).otherwise(F.col("energy") / 1000))
    lines = _signal(spark, sf_dir).select("vid", F.col("block").alias("id"), (F.col("block") * 80 + 17).alias("start_ms"))
    return M.onset_drift(frames, lines)


@query("m12_trim_tail", f"""WITH {SIG}, e AS (SELECT vid, 1000 + vid * 17 % 200 AS e FROM tr),
st AS (SELECT sig.vid, greatest(max(e.e), coalesce(max(pos) FILTER (WHERE abs(x) > 1e-5::DOUBLE AND pos >= e.e AND pos < e.e + 100), -1) + 1) AS stop FROM sig JOIN e ON e.vid = sig.vid GROUP BY sig.vid)
SELECT sig.vid, block, i, {rnd('x')} AS x FROM sig JOIN st ON st.vid = sig.vid WHERE pos < stop""")
def _(spark, sf_dir):
    sig = _signal(spark, sf_dir)
    ends = sig.select("vid").distinct().select("vid", (F.lit(1000) + F.col("vid") * 17 % 200).alias("end_sample"))
    return flat(M.trim_tail(sig, ends, SIZE, 100))


@query("m13_spoken_seconds", """SELECT l_orderkey AS vid, CAST(l_linenumber AS BIGINT) AS id, max(CAST(floor(l_extendedprice * 100) AS BIGINT) + l_partkey) AS ticks FROM lineitem GROUP BY ALL""")
def _(spark, sf_dir):
    b = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("vid"), F.col("l_linenumber").cast("bigint").alias("id"),
                                                  F.floor(F.col("l_extendedprice") * 100).cast("bigint").alias("offset"), F.col("l_partkey").alias("duration"))
    return M.spoken_seconds(b).select("vid", "id", F.floor(F.col("seconds") * 1e7 + 0.5).cast("bigint").alias("ticks"))


@query("m14_voiced_blocks", f"WITH {SIG} SELECT vid, block FROM sig GROUP BY ALL HAVING max(abs(x)) > 1e-5::DOUBLE")
def _(spark, sf_dir):
    return M.voiced_blocks(_signal(spark, sf_dir)).select("vid", "block")
