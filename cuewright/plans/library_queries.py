"""Source, library, download and usage queries, with their DuckDB counterparts."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..operators import formats as FM
from ..operators import library as L
from ..operators import usage as U
from ..session import shared_folder
from ..sources import catalogues as S
from ..sources import text_tracks as TT
from ..streaming import windows as W
from . import views as V
from .registry import query

WS = K.WHITESPACE_CLASS
STRIP = "'" + K.WHITESPACE + "'"
BIG = "bigint"


# ---- line arrays ---------------------------------------------------------------------
def _array_docs(spark, sf_dir):
    """One JSON array per video, every tenth one cut short."""
    ln = V.lines(spark, sf_dir)
    seg = X.rec(id=F.col("id"), start=F.col("start_ms") / 1000, end=F.col("end_ms") / 1000, text=F.col("text"), en=F.col("en"))
    docs = ln.groupBy("vid").agg(F.to_json(F.sort_array(F.collect_list(seg))).alias("json"))
    return docs.withColumn("json", F.when(F.col("vid") % 10 == 3, F.lit('[{"id": 0, "start"')).otherwise(F.col("json")))


@query("s01_read_lines", V.with_lines("SELECT vid, id, start_ms, end_ms, text, en FROM lines WHERE vid % 10 <> 3"))
def _(spark, sf_dir):
    return TT.lines_from_json(_array_docs(spark, sf_dir)).select("vid", "id", "start_ms", "end_ms", "text", "en")


@query("s02_write_lines", V.with_lines("SELECT vid, id, start_ms, end_ms, text, en FROM lines"))
def _(spark, sf_dir):
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    TT.write_lines(V.lines(spark, sf_dir).select("vid", "id", "start_ms", "end_ms", "text", "en"), path)
    return TT.load_lines(spark, path)


def _part_blobs(spark, sf_dir):
    raw = V.raw_segments(spark, sf_dir)
    text = F.when(F.col("seq") % 6 == 2, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("text")))
    seg = X.rec(start=F.col("rel_start_ms") / 1000, end=F.col("rel_end_ms") / 1000, text=text)
    blobs = raw.groupBy("vid", "chunk").agg(F.sort_array(F.collect_list(X.rec(seq=F.col("seq"), s=seg))).alias("x"))
    json = F.to_json(X.rec(language=F.lit(" French "), segments=F.transform("x", lambda r: r["s"])))
    return blobs.select("vid", "chunk", F.when(F.col("vid") % 9 == 4, F.lit("{broken")).otherwise(json).alias("json"))


PARTS_SQL = V.RAW_SQL + """,
blob AS (SELECT vid, chunk, row_number() OVER (PARTITION BY vid, chunk ORDER BY seq) - 1 AS pos, rel_start_ms AS start_ms, rel_end_ms AS end_ms,
  CASE WHEN seq % 6 = 2 THEN '  ' ELSE ' ' || text END AS text FROM raw WHERE vid % 9 <> 4)
"""


@query("s03_read_parts", V.with_lines(PARTS_SQL + "SELECT vid, chunk, ' French ' AS language, pos, start_ms, end_ms, text FROM blob"))
def _(spark, sf_dir):
    return TT.parts_from_json(_part_blobs(spark, sf_dir))


@query("s04_ingest_asr", V.with_lines(PARTS_SQL + f"SELECT vid, chunk, 'french' AS language, pos, start_ms, end_ms, trim(text, {STRIP}) AS text FROM blob WHERE trim(text, {STRIP}) <> ''"))
def _(spark, sf_dir):
    return TT.ingest_asr(_part_blobs(spark, sf_dir))


def clock_sql(ms, sep):
    t = f"greatest(0, {ms})"
    return (f"(lpad(CAST({t} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({t} % 3600000 // 60000 AS VARCHAR), 2, '0') || ':' || "
            f"lpad(CAST({t} % 60000 // 1000 AS VARCHAR), 2, '0') || '{sep}' || lpad(CAST({t} % 1000 AS VARCHAR), 3, '0'))")


CUE_SQL = rf"""
flat AS (SELECT vid, id, start_ms, end_ms, array_to_string(list_filter(regexp_split_to_array(en, '[{WS}]+'), lambda w: w <> ''), ' ') AS t FROM lines WHERE trim(en, {STRIP}) <> ''),
piece AS (SELECT *, flatten(list_transform(string_split(regexp_replace(t, '(\w[A-Za-z]-)(\w+[A-Za-z])', '\1' || chr(1) || '\2', 'g'), ' '),
  lambda w: list_transform(string_split(w, chr(1)), lambda p, i: CASE WHEN i = 1 THEN ' ' ELSE '' END || p))) AS ps FROM flat),
folded AS (SELECT *, list_reduce(ps, lambda acc, x: CASE
   WHEN acc = '' THEN ltrim(x, ' ')
   WHEN length(regexp_extract(acc, '[^\n]*$')) + length(x) <= 42 THEN acc || x ELSE acc || chr(10) || ltrim(x, ' ') END, '') AS f FROM piece),
cue AS (SELECT *, CASE WHEN length(t) <= 42 THEN t WHEN len(string_split(f, chr(10))) <= 2 THEN f
   WHEN length(l2) <= 41 THEN l1 || chr(10) || l2 || '…' WHEN contains(l2, ' ') THEN l1 || chr(10) || regexp_extract(l2, '^(.*) [^ ]*$', 1) || '…'
   WHEN length(l1) <= 41 THEN l1 || '…' ELSE l1 || chr(10) || '…' END AS cue,
   row_number() OVER (PARTITION BY vid ORDER BY id) AS n FROM (SELECT *, string_split(f, chr(10))[1] AS l1, string_split(f, chr(10))[2] AS l2 FROM folded))
"""


@query("s05_to_srt", V.with_lines(CUE_SQL + f"""SELECT vid, n, CASE WHEN n > 1 THEN chr(10) ELSE '' END || n || chr(10) || {clock_sql('start_ms', ',')} || ' --> '
  || {clock_sql('end_ms', ',')} || chr(10) || cue AS text FROM cue"""))
def _(spark, sf_dir):
    return TT.to_srt(V.lines(spark, sf_dir))


@query("s06_to_vtt", V.with_lines(CUE_SQL + f"""SELECT DISTINCT vid, CAST(0 AS BIGINT) AS n, 'WEBVTT' AS text FROM lines UNION ALL
  SELECT vid, n, chr(10) || {clock_sql('start_ms', '.')} || ' --> ' || {clock_sql('end_ms', '.')} || chr(10) || cue FROM cue"""))
def _(spark, sf_dir):
    return TT.to_vtt(V.lines(spark, sf_dir))


@query("s07_cue_clock", V.with_lines(f"SELECT vid, id, {clock_sql('start_ms * 31 - 500', ',')} AS srt, {clock_sql('start_ms * 31 - 500', '.')} AS vtt FROM lines"))
def _(spark, sf_dir):
    t = F.col("start_ms") * 31 - 500
    return V.lines(spark, sf_dir).select("vid", "id", X.cue_clock(t).alias("srt"), X.cue_clock(t, ".").alias("vtt"))


@query("s08_wrap_cue", V.with_lines(CUE_SQL + "SELECT vid, id, cue FROM cue"))
def _(spark, sf_dir):
    ln = V.lines(spark, sf_dir).where(X.strip(F.col("en")) != "")
    return ln.select("vid", "id", X.wrap_cue(F.col("en")).alias("cue"))


# ---- formats ---------------------------------------------------------------------------
def _formats(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    audio = F.col("l_linenumber") % 3 == 0
    q = F.col("l_quantity").cast("int")
    height = F.element_at(F.array(*[F.lit(h) for h in (144, 360, 480, 720, 1080)]), q % 5 + 1)
    code = F.when(F.col("l_returnflag") == "A", "avc1.4d401f").when(F.col("l_returnflag") == "N", "vp9").otherwise("av01.0")
    mp4 = F.col("l_linestatus") == "O"
    pos = (F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")
    size = F.floor("l_extendedprice").cast(BIG) * 1000
    return li.select(
        F.col("l_orderkey").alias("vid"), pos.alias("pos"),
        F.concat(pos.cast("string"), F.when(F.col("l_tax") == 0, "-drc").otherwise("")).alias("format_id"),
        F.when(audio, F.when(mp4, "m4a").otherwise("webm")).otherwise(F.when(mp4, "mp4").otherwise("webm")).alias("ext"),
        F.when(~audio, height).alias("height"), F.when(~audio, F.when(q % 2 == 0, 30.0).otherwise(60.0)).alias("fps"),
        F.when(audio, "none").otherwise(code).alias("vcodec"),
        F.when(audio | (F.col("l_tax") == 0.08), "mp4a").otherwise("none").alias("acodec"),
        F.when(audio, F.col("l_quantity") * 4).alias("abr"), F.when(~audio, F.floor("l_extendedprice") / 4).alias("tbr"),
        F.when(F.col("l_discount") >= 0.02, size).alias("filesize"), F.when(F.col("l_discount") >= 0.01, size + 7).alias("filesize_approx"))


FORMATS_SQL = """
fmt AS (SELECT l_orderkey AS vid, (l_partkey * 10000 + l_suppkey) * 10 + l_linenumber AS pos,
  ((l_partkey * 10000 + l_suppkey) * 10 + l_linenumber) || CASE WHEN l_tax = 0 THEN '-drc' ELSE '' END AS format_id,
  CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN l_linestatus = 'O' THEN 'm4a' ELSE 'webm' END ELSE CASE WHEN l_linestatus = 'O' THEN 'mp4' ELSE 'webm' END END AS ext,
  CASE WHEN l_linenumber % 3 <> 0 THEN ([144, 360, 480, 720, 1080])[CAST(l_quantity AS INT) % 5 + 1] END AS height,
  CASE WHEN l_linenumber % 3 <> 0 THEN CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 30 ELSE 60 END END AS fps,
  CASE WHEN l_linenumber % 3 = 0 THEN 'none' ELSE CASE l_returnflag WHEN 'A' THEN 'avc1.4d401f' WHEN 'N' THEN 'vp9' ELSE 'av01.0' END END AS vcodec,
  CASE WHEN l_linenumber % 3 = 0 OR l_tax = 0.08 THEN 'mp4a' ELSE 'none' END AS acodec,
  CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 4 END AS abr, CASE WHEN l_linenumber % 3 <> 0 THEN floor(l_extendedprice) / 4 END AS tbr,
  CASE WHEN l_discount >= 0.02 THEN CAST(floor(l_extendedprice) AS BIGINT) * 1000 END AS filesize,
  CASE WHEN l_discount >= 0.01 THEN CAST(floor(l_extendedprice) AS BIGINT) * 1000 + 7 END AS filesize_approx FROM lineitem),
vf AS (SELECT *, CASE WHEN vcodec LIKE 'avc1%' THEN 0 WHEN vcodec LIKE 'av01%' THEN 1 WHEN vcodec LIKE 'vp09%' THEN 2 WHEN vcodec LIKE 'vp9%' THEN 3 ELSE 4 END AS rk
  FROM fmt WHERE height > 0 AND acodec = 'none' AND ext IN ('mp4', 'webm') AND format_id NOT LIKE '%-drc' AND coalesce(filesize, filesize_approx, 0) > 0),
best AS (SELECT * FROM vf QUALIFY row_number() OVER (PARTITION BY vid, height ORDER BY rk, tbr DESC, pos) = 1),
aud AS (SELECT *, bool_or(ext = 'm4a') OVER (PARTITION BY vid) AS any_m4a FROM fmt WHERE vcodec = 'none' AND acodec <> 'none' AND abr > 0 AND format_id NOT LIKE '%-drc'),
cand AS (SELECT *, unnest([128, 48]) AS want FROM aud WHERE NOT any_m4a OR ext = 'm4a'),
pick AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY vid, want ORDER BY abr < want - 1, CASE WHEN abr >= want - 1 THEN abr ELSE -abr END, pos) = 1),
menu AS (SELECT b.vid, CAST(b.height AS BIGINT) AS height, b.height || 'p' || CASE WHEN b.fps > 35 THEN CAST(CAST(floor(b.fps) AS BIGINT) AS VARCHAR) ELSE '' END AS label,
  b.format_id || coalesce('+' || a.format_id, '') AS format, string_split(b.vcodec, '.')[1] AS vcodec, coalesce(CAST(round_even(a.abr, 0) AS BIGINT), 0) AS abr,
  CASE WHEN b.ext = 'mp4' AND (a.vid IS NULL OR a.ext = 'm4a') THEN 'mp4' ELSE 'mkv' END AS ext,
  coalesce(b.filesize, b.filesize_approx) + coalesce(a.filesize, a.filesize_approx, 0) AS size
  FROM best b LEFT JOIN pick a ON a.vid = b.vid AND a.want = CASE WHEN b.height >= 360 THEN 128 ELSE 48 END)
"""


@query("s09_read_formats", f"WITH {FORMATS_SQL} SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY pos, format_id, filesize, filesize_approx) - 1 AS pos, format_id, ext, CAST(height AS BIGINT) AS height, vcodec, acodec, filesize FROM fmt")
def _(spark, sf_dir):
    item = F.struct("pos", "format_id", "filesize", "filesize_approx", "ext", "height", "fps", "vcodec", "acodec", "abr", "tbr")
    docs = _formats(spark, sf_dir).groupBy("vid").agg(F.to_json(X.rec(formats=F.sort_array(F.collect_list(item)))).alias("json"))
    return S.read_formats(docs).select("vid", "pos", "format_id", "ext", F.col("height").cast(BIG).alias("height"), "vcodec", "acodec", "filesize")


def _log(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    pct = F.concat(F.floor(F.col("value")).cast("string"), F.lit("."), (F.col("event_id") % 10).cast("string"))
    line = F.when(F.col("event_type") == "error", F.lit("[Merger] Merging formats")) \
        .when(F.col("event_type") == "view", F.concat(F.lit("DL  "), pct, F.lit("% 1.5MiB/s Unknown"))) \
        .when(F.col("event_type") == "click", F.concat(F.lit(" DL "), pct, F.lit("%  2MiB/s 00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))) \
        .when(F.col("event_type") == "signup", F.concat(F.lit("DL "), pct, F.lit("%"))).otherwise(F.lit("[info] nothing"))
    return e.select("event_id", line.alias("value"))


PROGRESS_SQL = """SELECT event_id, CASE WHEN event_type = 'error' THEN 98 ELSE least(97, CAST(floor(value) AS BIGINT)) END AS pct,
  CASE event_type WHEN 'view' THEN '1.5MiB/s' WHEN 'click' THEN '2MiB/s' WHEN 'signup' THEN '-' ELSE '' END AS speed,
  CASE event_type WHEN 'click' THEN '00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') ELSE '' END AS eta FROM events WHERE event_type <> 'purchase'"""


@query("s10_read_progress", PROGRESS_SQL)
def _(spark, sf_dir):
    """The log written out as text files and tailed to the end as a stream."""
    base = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    _log(spark, sf_dir).select(F.concat_ws("\t", F.col("event_id").cast("string"), "value").alias("value")).write.text(f"{base}/in")
    raw = spark.readStream.schema("value STRING").text(f"{base}/in")
    cells = F.split("value", "\t", 2)
    found = S.progress_of(raw.select(cells[0].cast(BIG).alias("event_id"), cells[1].alias("value")))
    found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state") \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/out")


@query("f06_progress_of", PROGRESS_SQL)
def _(spark, sf_dir):
    return S.progress_of(_log(spark, sf_dir))


@query("f01_video_formats", f"WITH {FORMATS_SQL} SELECT vid, format_id FROM vf")
def _(spark, sf_dir):
    return FM.video_formats(_formats(spark, sf_dir)).select("vid", "format_id")


@query("f02_best_per_height", f"WITH {FORMATS_SQL} SELECT vid, CAST(height AS BIGINT) AS height, format_id FROM best")
def _(spark, sf_dir):
    return FM.best_per_height(_formats(spark, sf_dir)).select("vid", F.col("height").cast(BIG).alias("height"), "v.format_id")


@query("f03_pair_audio", f"""WITH {FORMATS_SQL} SELECT vid, max(CASE WHEN want = 128 THEN format_id END) AS large, max(CASE WHEN want = 48 THEN format_id END) AS small FROM pick GROUP BY vid""")
def _(spark, sf_dir):
    return FM.pair_audio(_formats(spark, sf_dir)).select("vid", F.col("large.format_id").alias("large"), F.col("small.format_id").alias("small"))


@query("f04_quality_menu", f"WITH {FORMATS_SQL} SELECT * FROM menu")
def _(spark, sf_dir):
    return FM.quality_menu(_formats(spark, sf_dir))


@query("f05_explain_error", """WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'Sign in to confirm you' || chr(39) || 're not a bot. Use --cookies'
  WHEN 'view' THEN 'Could not copy Chrome cookie database' WHEN 'click' THEN 'could not find firefox cookies' ELSE 'Video unavailable' END AS m FROM events)
SELECT event_id, CASE WHEN m LIKE 'Could not copy%' OR m LIKE 'could not find%' THEN 'cookies_locked' WHEN m LIKE 'Sign%' THEN CASE WHEN user_id % 2 = 0 THEN 'refused_with_cookies' ELSE 'bot_check' END END AS why FROM e""")
def _(spark, sf_dir):
    m = F.when(F.col("event_type") == "error", "Sign in to confirm you're not a bot. Use --cookies").when(F.col("event_type") == "view", "Could not copy Chrome cookie database") \
        .when(F.col("event_type") == "click", "could not find firefox cookies").otherwise("Video unavailable")
    return V.table(spark, sf_dir, "events").select("event_id", F.substring_index(FM.explain_error(m, F.col("user_id") % 2 == 0), ":", 1).alias("why"))


# ---- library table, voices, stamps ----------------------------------------------------------
@query("s11_read_videos", f"WITH {V.VIDEOS_SQL} SELECT vid, CAST(CASE WHEN vid % 2 = 0 THEN 0 ELSE vid % 500 END AS DOUBLE) AS position_s, CAST(0 AS DOUBLE) AS watched_at FROM videos")
def _(spark, sf_dir):
    """Old files lack the later columns; both generations are read together."""
    v = V.videos(spark, sf_dir)
    base = f"{shared_folder(spark)}/videos-{uuid.uuid4().hex}"
    v.where("vid % 2 = 0").select("vid", "title").write.parquet(f"{base}/gen=1")
    v.where("vid % 2 = 1").select("vid", "title", (F.col("vid") % 500).cast("double").alias("position_s"), F.lit(None).cast("double").alias("watched_at")).write.parquet(f"{base}/gen=2")
    return S.read_videos(spark, base).select("vid", "position_s", "watched_at")


def _stage_log(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("vid"), F.when(F.col("event_type") == "view", "asr").when(F.col("event_type") == "click", "lang").otherwise("dub").alias("stage"),
        F.when(F.col("event_type") == "error", "clear").otherwise("mark").alias("op"), F.col("event_id").alias("ts"),
        F.floor("value").cast("string").alias("stamp"), F.col("event_id").alias("size_bytes"))


STAGE_SQL = """lg AS (SELECT user_id % 40 AS vid, CASE event_type WHEN 'view' THEN 'asr' WHEN 'click' THEN 'lang' ELSE 'dub' END AS stage,
  CASE WHEN event_type = 'error' THEN 'clear' ELSE 'mark' END AS op, event_id AS ts, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS stamp, event_id AS size_bytes FROM events),
cur AS (SELECT vid, stage, stamp, size_bytes FROM (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY vid, stage ORDER BY ts DESC) = 1) WHERE op = 'mark')"""


@query("s12_current_stages", f"WITH {STAGE_SQL} SELECT * FROM cur")
def _(spark, sf_dir):
    return S.current_stages(_stage_log(spark, sf_dir))


LOCALES = ("en-US", "en-GB", "en-AU", "en-CA", "en-IE", "en-ZA", "fr-FR")


def _voices(spark, sf_dir):
    p = V.table(spark, sf_dir, "part")
    loc = F.element_at(F.array(*[F.lit(x) for x in LOCALES]), (F.col("p_size") % 7 + 1).cast("int"))
    name = F.concat(loc, F.lit("-"), F.initcap(F.replace("p_name", F.lit(" "), F.lit(""))), F.col("p_partkey").cast("string"),
                    F.when(F.col("p_partkey") % 3 == 0, "Multilingual").otherwise(""), F.lit("Neural"))
    return p.select(name.alias("short_name"), loc.alias("locale"), F.when(F.col("p_partkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
                    F.array(F.col("p_brand")).alias("personalities"))


def _clone_files(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier").withColumn("dir", F.replace(F.lower("s_name"), F.lit("#"), F.lit("")))
    k = F.col("s_suppkey")
    meta = F.when(k % 5 == 1, F.lit("{oops")).when(k % 2 == 0, F.concat(F.lit('{"name": "Clone '), k.cast("string"), F.lit('", "gender": "Female"}'))) \
        .otherwise(F.concat(F.lit('{"base_voice": "en-GB-'), k.cast("string"), F.lit('"}')))
    return s.select("dir", F.explode(F.array(X.rec(name=F.lit("voice.json"), content=meta), X.rec(
        name=F.when(k % 7 == 3, "notes.txt").otherwise("model.pth"), content=F.lit("")))).alias("f")).select("dir", "f.*")


CLONE_SQL = f"""
sup AS (SELECT s_suppkey AS k, replace(lower(s_name), '#', '') AS dir FROM supplier WHERE s_suppkey % 5 <> 1 AND s_suppkey % 7 <> 3),
clones AS (SELECT dir AS id, CASE WHEN k % 2 = 0 THEN 'Clone ' || k ELSE upper(left(dir, 1)) || substr(dir, 2) END AS name,
  CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Unknown' END AS gender, CASE WHEN k % 2 = 0 THEN '{K.DEFAULT_BASE_VOICE}' ELSE 'en-GB-' || k END AS base_voice FROM sup)
"""


@query("s13_voice_dim", f"""WITH {CLONE_SQL},
v AS (SELECT (['en-US', 'en-GB', 'en-AU', 'en-CA', 'en-IE', 'en-ZA', 'fr-FR'])[p_size % 7 + 1] AS locale, p_size % 7 AS r, upper(left(replace(p_name, ' ', ''), 1)) || lower(substr(replace(p_name, ' ', ''), 2)) || p_partkey
   || CASE WHEN p_partkey % 3 = 0 THEN 'Multilingual' ELSE '' END AS name, p_partkey % 3 = 0 AS multilingual, CASE WHEN p_partkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, p_brand FROM part)
SELECT locale || '-' || name || 'Neural' AS id, name, locale, gender, multilingual, p_brand AS personalities, false AS clone, CAST(CASE WHEN r < 5 THEN r ELSE 9 END AS BIGINT) AS locale_rank FROM v WHERE locale LIKE 'en-%'
UNION ALL SELECT id, name, 'clone', gender, false, '', true, -1 FROM clones""")
def _(spark, sf_dir):
    return S.voice_dim(_voices(spark, sf_dir), S.clone_dim(_clone_files(spark, sf_dir))).withColumn("personalities", F.array_join("personalities", ","))


@query("s14_clone_dim", f"WITH {CLONE_SQL} SELECT * FROM clones")
def _(spark, sf_dir):
    return S.clone_dim(_clone_files(spark, sf_dir))


@query("s15_base_voice", f"""WITH {CLONE_SQL}, jobs AS (SELECT o_orderkey AS vid, 'supplier' || lpad(CAST(o_custkey % 200 AS VARCHAR), 9, '0') AS voice FROM orders)
SELECT j.voice, j.vid, coalesce(c.base_voice, j.voice) AS base_voice FROM jobs j LEFT JOIN clones c ON c.id = j.voice""")
def _(spark, sf_dir):
    jobs = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vid"), F.concat(
        F.lit("supplier"), F.lpad((F.col("o_custkey") % 200).cast("string"), 9, "0")).alias("voice"))
    return S.base_voice(jobs, S.clone_dim(_clone_files(spark, sf_dir)))


# ---- library ----------------------------------------------------------------------------------
VID = f"WITH {V.VIDEOS_SQL}"


@query("l01_create_videos", VID + """ SELECT vid, title, CASE WHEN vid % 3 = 0 THEN 'downloading' ELSE 'queued' END AS status, 'Waiting to start' AS stage,
  CAST(0 AS BIGINT) AS progress, CAST(1700000000 AS BIGINT) AS created_at, CAST(1700000000 AS BIGINT) AS updated_at FROM videos""")
def _(spark, sf_dir):
    new = V.videos(spark, sf_dir).select("vid", "title", F.when(F.col("vid") % 3 == 0, "downloading").otherwise("").alias("status"))
    out = L.create_videos(new, 1700000000)
    return out.withColumns({c: F.col(c).cast(BIG) for c in ("created_at", "updated_at")})


@query("l02_update_videos", VID + """ SELECT vid, CASE WHEN vid % 5 = 0 THEN 'ready' ELSE status END AS status, CASE WHEN vid % 10 = 0 THEN NULL ELSE title END AS title,
  CASE WHEN vid % 5 = 0 THEN 1700000001 ELSE created_at END AS updated_at FROM videos""")
def _(spark, sf_dir):
    v = V.videos(spark, sf_dir).select("vid", "status", "title", F.col("created_at").alias("updated_at"))
    patch = v.where("vid % 5 = 0").select("vid", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("title"),
                                           F.when(F.col("vid") % 10 == 0, F.array(F.lit("title"))).alias("set_fields"))
    return L.update_videos(v, patch, 1700000001).withColumn("updated_at", F.col("updated_at").cast(BIG))


@query("l03_get_video", VID + " SELECT vid, title, status FROM videos WHERE vid = 17")
def _(spark, sf_dir):
    return L.get_video(V.videos(spark, sf_dir), 17).select("vid", "title", "status")


@query("l04_list_videos", VID + " SELECT vid, title, created_at FROM videos ORDER BY created_at DESC, vid")
def _(spark, sf_dir):
    return L.list_videos(V.videos(spark, sf_dir)).select("vid", "title", "created_at")


@query("l05_delete_videos", VID + """ SELECT vid, 'kept' AS outcome FROM videos WHERE NOT (vid % 4 = 0 AND status <> 'processing')
UNION ALL SELECT vid, 'still processing' FROM videos WHERE vid % 4 = 0 AND status = 'processing' UNION ALL SELECT -o_orderkey, 'not found' FROM orders WHERE o_orderkey > 0 AND o_orderkey % 400 = 0""")
def _(spark, sf_dir):
    v = V.videos(spark, sf_dir)
    ids = v.where("vid % 4 = 0").select("vid").unionByName(v.where("vid > 0 AND vid % 400 = 0").select((-F.col("vid")).alias("vid")))
    kept, refused = L.delete_videos(v, ids)
    return kept.select("vid", F.lit("kept").alias("outcome")).unionByName(refused.select("vid", F.col("reason").alias("outcome")))


def _stats_json():
    return F.when(F.col("vid") % 6 == 1, F.lit("{nope")).when(F.col("vid") % 6 == 2, F.lit(None)).otherwise(F.concat(
        F.lit('{"lines": '), F.col("duration_s").cast("string"), F.lit(', "compressed": '), (F.col("vid") % 50).cast("string"), F.lit(', "max_rate_milli": 1550}')))


def _files(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    names = ("dubbed.mp4", "thumb.jpg", "source.mkv", "source.txt", "notes.md", "source.mp4", "english.srt")
    return li.select(F.col("l_orderkey").alias("vid"), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("l_linenumber")).alias("name"))


STATS_SQL = VID + """, st AS (SELECT vid, CASE vid % 6 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE duration_s END AS lines,
  CASE vid % 6 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE vid % 50 END AS compressed, duration_s FROM videos),
fl AS (SELECT l_orderkey AS vid, bool_or(l_linenumber = 1) AS o, bool_or(l_linenumber = 2) AS t, bool_or(l_linenumber IN (3, 6)) AS s FROM lineitem GROUP BY 1)
"""


@query("l06_decorate", STATS_SQL + """SELECT st.vid, coalesce(o, false) AS has_output, coalesce(t, false) AS has_thumb, coalesce(s, false) AS has_source, lines
FROM st LEFT JOIN fl ON st.vid = fl.vid""")
def _(spark, sf_dir):
    v = V.videos(spark, sf_dir).withColumn("stats", _stats_json())
    return L.decorate(v, _files(spark, sf_dir)).select("vid", "has_output", "has_thumb", "has_source", F.try_variant_get("stats", "$.lines", BIG).alias("lines"))


@query("l07_shelf", VID + " SELECT vid, title FROM videos WHERE status IN ('downloading', 'downloaded') AND contains(lower(title), 'urgent 1')")
def _(spark, sf_dir):
    return L.shelf(V.videos(spark, sf_dir), "downloads", "URGENT 1").select("vid", "title")


@query("l07_shelf_counts", VID + " SELECT count(*) FILTER (WHERE status NOT IN ('downloading', 'downloaded')) AS dubbed, count(*) FILTER (WHERE status IN ('downloading', 'downloaded')) AS downloads FROM videos")
def _(spark, sf_dir):
    return L.shelf_counts(V.videos(spark, sf_dir))


@query("l08_status", VID + " SELECT vid, status, 'stage' AS stage, vid % 100 AS progress, NULL::VARCHAR AS error, vid % 700 AS line_count, duration_s FROM videos")
def _(spark, sf_dir):
    return L.status(V.videos(spark, sf_dir).withColumns({"stage": F.lit("stage"), "progress": F.col("vid") % 100, "error": F.lit(None).cast("string"), "line_count": F.col("vid") % 700}))


@query("l09_effective_opts", VID + """ SELECT vid, CASE WHEN vid % 3 = 0 THEN 'asked' WHEN vid % 2 = 0 THEN 'v' || vid ELSE 'default' END AS voice,
  CASE WHEN vid % 5 = 0 THEN '9' WHEN vid % 4 = 0 THEN '3' ELSE '0' END AS speed FROM videos""")
def _(spark, sf_dir):
    v = V.videos(spark, sf_dir).withColumn("voice", F.when(F.col("vid") % 2 == 0, F.concat(F.lit("v"), F.col("vid").cast("string"))).otherwise("")) \
        .withColumn("stats", F.when(F.col("vid") % 4 == 0, F.create_map(F.lit("speed"), F.lit("3")))) \
        .withColumn("request", F.map_from_entries(F.array_compact(F.array(
            F.when(F.col("vid") % 3 == 0, F.struct(F.lit("voice"), F.lit("asked"))), F.when(F.col("vid") % 5 == 0, F.struct(F.lit("speed"), F.lit("9")))))))
    return L.effective_opts(v, {"voice": "default", "speed": "0"}, ["voice", "speed"])


@query("l10_admit", VID + """ SELECT vid, 'translate' AS action, CASE WHEN status IN ('queued', 'processing') THEN 'already in flight' WHEN vid % 4 = 0 THEN 'no source' END AS refusal FROM videos
UNION ALL SELECT vid, 'revoice', CASE WHEN status = 'processing' THEN 'already in flight' WHEN vid % 6 = 0 THEN 'no transcript' END FROM videos""")
def _(spark, sf_dir):
    v = V.videos(spark, sf_dir).withColumn("has_source", F.col("vid") % 4 != 0).withColumn("line_count", F.col("vid") % 6)
    one = lambda a: L.admit(v, a).select("vid", F.lit(a).alias("action"), "refusal")
    return one("translate").unionByName(one("revoice"))


@query("l11_line_at", V.with_lines("""moments AS (SELECT user_id AS vid, event_id, CAST(floor(value * 1000) AS BIGINT) AS at_ms FROM events)
SELECT m.vid, m.event_id, m.at_ms, min(l.id) AS id FROM moments m LEFT JOIN lines l ON l.vid = m.vid AND m.at_ms >= l.start_ms AND m.at_ms < l.end_ms GROUP BY ALL"""))
def _(spark, sf_dir):
    m = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("vid"), "event_id", F.floor(F.col("value") * 1000).cast(BIG).alias("at_ms"))
    return L.line_at(V.lines(spark, sf_dir), m)


@query("l12_line_marks", V.with_lines("""SELECT vid, id, concat_ws(',', CASE WHEN id % 40 * 50 > 1050 THEN printf('%.2f', id % 40 * 50 / 1000.0) || 'x' END,
  CASE WHEN id % 9 = 0 THEN 'rewritten' END, CASE WHEN id % 11 = 0 THEN 'cut short' END) AS marks FROM lines"""))
def _(spark, sf_dir):
    ln = V.lines(spark, sf_dir).withColumns({"dub_speedup_milli": F.col("id") % 40 * 50, "fixed": F.col("id") % 9 == 0, "clipped": F.col("id") % 11 == 0})
    return L.line_marks(ln).select("vid", "id", F.array_join("marks", ",").alias("marks"))


AGO = "CASE " + " ".join(f"WHEN s >= {n} THEN (s // {n}) || ' {w}' || CASE WHEN s // {n} > 1 THEN 's' ELSE '' END || ' ago'" for n, w in
                         ((31536000, "year"), (2592000, "month"), (86400, "day"), (3600, "hour"), (60, "minute"))) + " ELSE 'just now' END"
HMS = """(CASE WHEN d // 3600 > 0 THEN (d // 3600) || ':' || lpad(CAST(d % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(d // 60 AS VARCHAR) END || ':' || lpad(CAST(d % 60 AS VARCHAR), 2, '0'))"""


@query("l13_labels", VID + f"""SELECT vid, {HMS} AS length, {AGO} AS age, (d // 60) || ':' || lpad(CAST(d % 60 AS VARCHAR), 2, '0') AS clock
  FROM (SELECT vid, duration_s * (vid % 3 + 1) AS d, 1000000000 - created_at AS s FROM videos)""")
def _(spark, sf_dir):
    d = (F.col("duration_s") * (F.col("vid") % 3 + 1)).cast("double")
    return V.videos(spark, sf_dir).select("vid", X.hhmmss(d).alias("length"), X.ago(F.lit(1000000000) - F.col("created_at")).alias("age"), X.minute_clock(d).alias("clock"))


@query("l14_stat_grid", STATS_SQL + f"""SELECT vid, {HMS} AS length, coalesce(lines, vid % 700) AS lines, CASE WHEN vid % 2 = 0 THEN 'Andrew' ELSE '-' END AS voice,
  coalesce(compressed, 0) AS compressed, CASE WHEN lines IS NULL THEN 1000 ELSE 1550 END AS peak_milli, CAST(0 AS BIGINT) AS clipped FROM (SELECT *, duration_s AS d FROM st)""".replace("CASE WHEN lines IS NULL THEN 1000 ELSE 1550 END", "CAST(CASE WHEN lines IS NULL THEN 1000 ELSE 1550 END AS BIGINT)"))
def _(spark, sf_dir):
    v = V.videos(spark, sf_dir).withColumns({"stats": F.coalesce(F.try_parse_json(_stats_json()), F.parse_json(F.lit("{}"))), "line_count": F.col("vid") % 700,
                                             "voice": F.when(F.col("vid") % 2 == 0, "en-US-AndrewNeural").otherwise("")})
    return L.stat_grid(v)


@query("l15_validate_uploads", """WITH f AS (SELECT l_orderkey AS vid, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, 'My clip ' || l_partkey || (['.mp4', '.MKV', '.txt', '', '.tar.webm', '.mov', '.ts'])[l_linenumber] AS filename,
  CASE WHEN l_quantity < 5 THEN 0 ELSE 10 END AS z, CASE WHEN l_returnflag = 'A' THEN ' Named ' ELSE ' ' END AS t FROM lineitem)
SELECT vid, p, s, CAST(n AS BIGINT) AS n, CASE WHEN trim(t) <> '' THEN trim(t) ELSE substr(regexp_replace(filename, '\\.[^./]+$', ''), 1, 200) END AS title,
  CASE WHEN n IN (3, 4) THEN 'format not supported' WHEN z = 0 THEN 'empty file' END AS refusal FROM f""")
def _(spark, sf_dir):
    ends = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".MKV", ".txt", "", ".tar.webm", ".mov", ".ts")]), F.col("l_linenumber"))
    files = V.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("vid"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast(BIG).alias("n"),
        F.concat(F.lit("My clip "), F.col("l_partkey").cast("string"), ends).alias("filename"),
        F.when(F.col("l_quantity") < 5, 0).otherwise(10).alias("size_bytes"), F.when(F.col("l_returnflag") == "A", " Named ").otherwise(" ").alias("title"))
    return L.validate_uploads(files).select("vid", "p", "s", "n", "title", "refusal")


# ---- windows and incremental work -------------------------------------------------------------
WIN_SQL = """
vd AS (SELECT vid, max(total_ms) AS dur FROM lines GROUP BY vid),
win AS (SELECT vid, dur, CAST(k AS BIGINT) AS window_no, CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN 45000 WHEN k = 2 THEN 135000 ELSE 315000 + (k - 3) * 300000 END AS from_ms,
  least(dur, CASE WHEN k = 0 THEN 45000 WHEN k = 1 THEN 135000 ELSE 315000 + (k - 2) * 300000 END) AS until_ms
  FROM (SELECT vid, dur, unnest(range(0, 2000)) AS k FROM vd) WHERE CASE WHEN k = 0 THEN 0 WHEN k = 1 THEN 45000 WHEN k = 2 THEN 135000 ELSE 315000 + (k - 3) * 300000 END < dur),
wn AS (SELECT *, CASE WHEN start_ms < 45000 THEN 0 WHEN start_ms < 135000 THEN 1 WHEN start_ms < 315000 THEN 2 ELSE 3 + (start_ms - 315000) // 300000 END AS window_no FROM lines),
fin AS (SELECT *, (vid + window_no * 3) % 5 <> 0 AS done FROM win),
gap AS (SELECT vid, min(window_no) FILTER (WHERE NOT done) AS g, max(until_ms) AS dur FROM fin GROUP BY vid),
pre AS (SELECT f.vid, coalesce(max(until_ms) FILTER (WHERE g IS NULL OR window_no < g), 0) AS ready_ms, gap.dur AS duration_ms, g IS NULL AS complete FROM fin f JOIN gap ON f.vid = gap.vid GROUP BY f.vid, gap.dur, g)
"""


def _durations(spark, sf_dir):
    return V.lines(spark, sf_dir).where("id = 0").select("vid", F.col("total_ms").alias("duration_ms"))


def _windows(spark, sf_dir):
    return W.growing_windows(_durations(spark, sf_dir)).withColumn("done", (F.col("vid") + F.col("window_no") * 3) % 5 != 0)


@query("w01_growing_windows", V.with_lines(WIN_SQL + "SELECT vid, window_no, from_ms, until_ms FROM win"))
def _(spark, sf_dir):
    return W.growing_windows(_durations(spark, sf_dir))


@query("w02_assign_windows", V.with_lines(WIN_SQL + "SELECT vid, id, CAST(window_no AS BIGINT) AS window_no FROM wn"))
def _(spark, sf_dir):
    return W.assign_windows(V.lines(spark, sf_dir)).select("vid", "id", "window_no")


@query("w03_window_batches", V.with_lines(WIN_SQL + "SELECT vid, id // 30 AS batch, CAST(min(window_no) AS BIGINT) AS window_no FROM wn GROUP BY ALL"))
def _(spark, sf_dir):
    return W.window_batches(V.lines(spark, sf_dir))


@query("w04_ready_prefix", V.with_lines(WIN_SQL + "SELECT * FROM pre"))
def _(spark, sf_dir):
    return W.ready_prefix(_windows(spark, sf_dir))


@query("w04_ready_prefix_stream", V.with_lines(WIN_SQL + "SELECT vid, ready_ms FROM pre WHERE ready_ms > 0"))
def _(spark, sf_dir):
    from ..streaming.prefix import prefix_table
    base = f"{shared_folder(spark)}/prefix-{uuid.uuid4().hex}"
    done = _windows(spark, sf_dir).where("done").select("vid", "window_no", "until_ms")
    done.repartition(4, F.xxhash64("vid", "window_no")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(done.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return prefix_table(stream, base)


@query("w05_hls_segments", V.with_lines(WIN_SQL + "SELECT vid, k AS segment, k * 6000 AS from_ms, least((k + 1) * 6000, dur) AS until_ms FROM (SELECT vid, dur, unnest(range(0, (dur + 5999) // 6000)) AS k FROM vd)"))
def _(spark, sf_dir):
    return W.hls_segments(_durations(spark, sf_dir))


@query("w06_stream_status", V.with_lines(WIN_SQL + "SELECT vid, ready_ms, duration_ms, complete AS done, ready_ms > 0 AS playable, ready_ms >= 5000 AS offered FROM pre"))
def _(spark, sf_dir):
    return W.stream_status(W.ready_prefix(_windows(spark, sf_dir)))


@query("w06_stream_status_stream", V.with_lines(WIN_SQL + "SELECT vid, ready_ms, duration_ms, complete AS done, ready_ms > 0 AS playable, ready_ms >= 5000 AS offered FROM pre"))
def _(spark, sf_dir):
    from ..streaming.status import status_table
    base = f"{shared_folder(spark)}/status-{uuid.uuid4().hex}"
    windows = _windows(spark, sf_dir)
    done = windows.where("done").select("vid", "window_no", "until_ms")
    done.repartition(4, F.xxhash64("vid", "window_no")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(done.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return status_table(stream, windows.groupBy("vid").agg(F.max("until_ms").alias("duration_ms")), base)


def _positions(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("vid"), V.epoch_s(F.col("ts")).alias("ts_s"), (F.col("value") - 5).alias("at_s"))


POS_SQL = """SELECT user_id AS vid, CAST(floor(greatest(0.0, arg_max(value - 5, CAST(floor(epoch(ts)) AS BIGINT) * 100000000 + event_id)) * 10 + 0.5) AS BIGINT) AS at_tenths,
  max(CAST(floor(epoch(ts)) AS BIGINT)) AS watched_at FROM events GROUP BY user_id"""


@query("w07_latest_position", POS_SQL)
def _(spark, sf_dir):
    return L.latest_position(_positions(spark, sf_dir))


@query("w07_latest_position_stream", POS_SQL)
def _(spark, sf_dir):
    from ..streaming.positions import latest_position_table
    base = f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}"
    p = _positions(spark, sf_dir)
    p.repartition(4, F.xxhash64("event_id")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return latest_position_table(stream, base)


@query("w08_watched", VID + """ SELECT vid, CAST(CASE WHEN p > 20 AND duration_s > 0 THEN CASE WHEN least(1.0::DOUBLE, p::DOUBLE / duration_s) > 0.97::DOUBLE THEN 1000 ELSE floor(least(1.0::DOUBLE, p::DOUBLE / duration_s) * 1000) END END AS BIGINT) AS share
  FROM (SELECT *, vid * 37 % 2500 AS p FROM videos)""")
def _(spark, sf_dir):
    return V.videos(spark, sf_dir).select("vid", L.watched(F.col("vid") * 37 % 2500, F.col("duration_s")).alias("share"))


@query("w09_usable_artifacts", """WITH m AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'audio' ELSE 'render' END AS kind, CAST(floor(value * 100) AS BIGINT) AS z, event_id % 1000 AS d FROM events)
SELECT event_id FROM m WHERE (kind = 'audio' AND z > 4096 AND d > 500) OR (kind = 'render' AND z > 512)""")
def _(spark, sf_dir):
    m = V.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "audio").otherwise("render").alias("kind"),
                                                F.floor(F.col("value") * 100).cast(BIG).alias("size_bytes"), (F.col("event_id") % 1000).alias("duration_ms"))
    return L.usable_artifacts(m).select("event_id")


@query("w10_recovery_plan", VID + """ SELECT vid, created_at, CASE WHEN status = 'downloading' THEN 'fail' ELSE 'resume' END AS action FROM videos
  WHERE status IN ('downloading', 'processing', 'queued') ORDER BY created_at, vid""")
def _(spark, sf_dir):
    return L.recovery_plan(V.videos(spark, sf_dir)).select("vid", "created_at", "action")


@query("w11_stages_to_run", f"""WITH {STAGE_SQL}, inp AS (SELECT DISTINCT vid, stage, stamp FROM lg WHERE vid % 3 = 0 OR ts % 50 = 0)
SELECT vid, stage, stamp FROM inp WHERE (vid, stage, stamp) NOT IN (SELECT (vid, stage, stamp) FROM cur)""")
def _(spark, sf_dir):
    log = _stage_log(spark, sf_dir)
    return L.stages_to_run(S.current_stages(log), log.where("vid % 3 = 0 OR ts % 50 = 0").select("vid", "stage", "stamp").distinct())


@query("w12_accumulate_stats", V.with_lines(WIN_SQL + """, pw AS (SELECT vid, window_no, count(*) AS lines, count(*) FILTER (WHERE id % 3 = 0) AS crowded, max(id % 1000 + 1000) AS m FROM wn GROUP BY ALL)
SELECT vid, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(crowded) AS BIGINT) AS crowded, max(m) AS max_rate_milli FROM pw GROUP BY vid"""))
def _(spark, sf_dir):
    per = W.assign_windows(V.lines(spark, sf_dir)).groupBy("vid", "window_no").agg(
        F.count("*").alias("lines"), F.count_if(F.col("id") % 3 == 0).alias("crowded"), F.max(F.col("id") % 1000 + 1000).alias("max_rate_milli"))
    return W.accumulate_stats(per)


@query("w13_stage_progress", """SELECT event_id, least(100, greatest(0, CAST(floor(CASE event_type WHEN 'view' THEN (user_id::DOUBLE / 100) * 30 + 10 WHEN 'click' THEN (user_id::DOUBLE / 100) * 20 + 72
  ELSE (user_id::DOUBLE / 100) * 50 + 45 END) AS BIGINT))) AS pct FROM events""")
def _(spark, sf_dir):
    stage = F.when(F.col("event_type") == "view", "transcribe").when(F.col("event_type") == "click", "speech").otherwise("window")
    return V.table(spark, sf_dir, "events").select("event_id", W.stage_progress(stage, F.col("user_id"), F.lit(100)).alias("pct"))


# ---- usage ----------------------------------------------------------------------------------------
LEVEL_SQL = f"""WITH {V.REQUESTS_SQL},
lev AS (SELECT streams, max(ts_s) - min(ts_s) + 1 AS seconds, count(*) FILTER (WHERE http_status = 200) AS ok, count(*) FILTER (WHERE http_status = 429) AS retries,
  CAST(coalesce(sum(total_tokens) FILTER (WHERE http_status = 200), 0) AS BIGINT) AS tokens FROM requests GROUP BY streams)
"""


@query("u01_concurrency_report", LEVEL_SQL + """SELECT *, CAST(floor((SELECT min_by(seconds, streams) FROM lev) * 1000::DOUBLE / seconds + 0.5) AS BIGINT) AS speedup_milli,
  streams = (SELECT streams FROM lev ORDER BY seconds, streams LIMIT 1) AS fastest FROM lev""")
def _(spark, sf_dir):
    return U.concurrency_report(V.requests(spark, sf_dir))


@query("u02_throughput_report", LEVEL_SQL + "SELECT streams, seconds, ok, retries AS refused, tokens, CAST(floor(tokens * 1000::DOUBLE / seconds + 0.5) AS BIGINT) AS tokens_per_ks FROM lev")
def _(spark, sf_dir):
    return U.throughput_report(V.requests(spark, sf_dir))


@query("u03_shared_bucket", f"""WITH {V.REQUESTS_SQL},
bu AS (SELECT model || '/' || (ts_s // 7200) AS burst, model, min(ts_s) AS from_s, max(ts_s) AS to_s, 7000 + max(event_id) % 1000 AS base FROM requests WHERE key_id = 0 GROUP BY model, ts_s // 7200),
hit AS (SELECT burst, min(remaining) FILTER (WHERE remaining >= 0) AS lowest, count(*) FILTER (WHERE http_status = 429) AS refused, count(*) AS probes
  FROM bu JOIN requests r ON r.key_id = 1 AND r.model = bu.model AND r.ts_s BETWEEN from_s AND to_s GROUP BY burst)
SELECT bu.burst, lowest, coalesce(refused, 0) AS refused, coalesce(probes, 0) AS probes, CASE WHEN lowest IS NULL THEN 'inconclusive' WHEN refused > 0 OR base - lowest > base * 0.3::DOUBLE THEN 'shared'
  WHEN base - lowest < base * 0.05::DOUBLE THEN 'separate' ELSE 'unclear' END AS verdict FROM bu LEFT JOIN hit ON bu.burst = hit.burst""")
def _(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    slot = F.floor(F.col("ts_s") / 7200).cast(BIG)
    bursts = r.where("key_id = 0").groupBy("model", slot.alias("slot")).agg(
        F.min("ts_s").alias("from_s"), F.max("ts_s").alias("to_s"), (F.max("event_id") % 1000 + 7000).alias("base")) \
        .withColumn("burst", F.concat_ws("/", "model", F.col("slot").cast("string")))
    return U.shared_bucket(bursts, r.where("key_id = 1").select("model", "ts_s", "http_status", "remaining"))


@query("u04_lines_per_minute", f"""WITH {V.REQUESTS_SQL},
run AS (SELECT streams, CAST(sum(total_tokens % 40) AS BIGINT) AS lines, CAST(sum(ts_s % 9 + 1) AS BIGINT) AS seconds FROM requests GROUP BY streams),
b AS (SELECT lines AS bl, seconds AS bs FROM run ORDER BY streams LIMIT 1)
SELECT streams, lines, seconds, CAST(floor(lines * 60::DOUBLE / seconds + 0.5) AS BIGINT) AS per_minute, CAST(floor((lines::DOUBLE / seconds) / (bl::DOUBLE / bs) * 1000 + 0.5) AS BIGINT) AS fair_milli,
  abs(lines - bl) > greatest(2.0, bl * 0.05::DOUBLE) AS unequal FROM run, b""")
def _(spark, sf_dir):
    return U.lines_per_minute(V.requests(spark, sf_dir).select("streams", (F.col("total_tokens") % 40).alias("lines"), (F.col("ts_s") % 9 + 1).alias("seconds")))


MODELS = ("qwen/qwen3-32b", "openai/gpt-oss-120b", "llama-3.3-70b-versatile", "whisper-large-v3", "groq/compound", "deepseek-r1-distill", "meta/llama-guard-4",
          "playai-tts", "moonshotai/kimi-k2", "allam-2-7b", "llama-4-scout", "gemma2")


def _model():
    """A model id per customer; the number keeps ids distinct."""
    return F.concat(F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("c_custkey") % len(MODELS) + 1).cast("int")), F.lit("-v"), F.col("c_custkey").cast("string"))


MODEL_SQL = f"mo AS (SELECT c_nationkey AS pool, ([{', '.join(repr(m) for m in MODELS)}])[c_custkey % {len(MODELS)} + 1] || '-v' || c_custkey AS model FROM customer)"


@query("u05_est_throughput", f"""WITH {MODEL_SQL} SELECT CAST(pool AS BIGINT) AS pool, CAST(sum(CASE WHEN regexp_matches(model, '{K.REASONING_MODEL}') THEN 50 ELSE 110 END) AS BIGINT) AS lines_per_minute,
  count(*) * 8000 AS tokens_per_minute FROM mo GROUP BY pool""")
def _(spark, sf_dir):
    return U.est_throughput(V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast(BIG).alias("pool"), _model().alias("model")))


PREF = "CASE " + " ".join(f"WHEN contains(model, '{p}') THEN {i}" for i, p in enumerate(K.MODEL_PREFERENCE)) + f" ELSE {len(K.MODEL_PREFERENCE)} END"


@query("u06_model_dim", f"""WITH {MODEL_SQL} SELECT model, CASE WHEN contains(model, 'whisper') THEN 'speech' ELSE 'chat' END AS kind,
  CAST(CASE WHEN NOT contains(model, 'whisper') THEN {PREF} END AS BIGINT) AS rank, NOT regexp_matches(model, 'whisper|compound|allam') AS helper
  FROM mo WHERE NOT regexp_matches(model, 'prompt-guard|safeguard|orpheus|-tts|guard-')""")
def _(spark, sf_dir):
    return U.model_dim(V.table(spark, sf_dir, "customer").select(_model().alias("model")))


LIMITS = {"tokens_per_day": 200_000, "requests_per_day": 1_000, "tokens_per_minute": 8_000}


@query("u07_usage_vs_limits", f"""WITH {V.REQUESTS_SQL},
mi AS (SELECT key_id, model, ts_s // 86400 AS day, ts_s // 60 AS m, sum(total_tokens) AS t, count(*) AS r FROM requests GROUP BY ALL),
dy AS (SELECT key_id, model, day, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(r) AS BIGINT) AS requests, CAST(max(t) AS BIGINT) AS peak_minute FROM mi GROUP BY ALL)
SELECT *, tokens * 1000 // 200000 AS day_tokens_milli, requests * 1000 // 1000 AS day_requests_milli, peak_minute * 1000 // 8000 AS minute_tokens_milli FROM dy""")
def _(spark, sf_dir):
    r = V.requests(spark, sf_dir)
    limits = r.select("model").distinct().select("model", *[F.lit(v).alias(k) for k, v in LIMITS.items()])
    return U.usage_vs_limits(r, limits)
