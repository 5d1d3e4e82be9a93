"""Transcript queries over the given tables, each with its DuckDB counterpart."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..operators import transcript as T
from . import views as V
from .registry import query

WS = K.WHITESPACE_CLASS
STRIP = "'" + K.WHITESPACE + "'"


def _pause_events(spark, sf_dir):
    """Pauses after every fifth line; how deep they are depends on the video."""
    ln = V.lines(spark, sf_dir).where("id % 5 = 0")
    level = F.when(F.col("vid") % 4 == 0, F.array(F.lit(-32), F.lit(-26))) \
        .when(F.col("vid") % 4 == 1, F.array(F.lit(-26), F.lit(-20))).otherwise(F.array(F.lit(-20)))
    end_at = F.col("end_ms") + F.when(F.col("id") % 3 == 0, -1).otherwise(500)
    return ln.select("vid", F.explode(level).alias("level"), F.explode(F.array(
        X.rec(kind=F.lit("start"), at_ms=F.col("end_ms")),
        X.rec(kind=F.lit("end"), at_ms=end_at))).alias("x")) \
        .select("vid", F.col("level").cast("bigint").alias("level_db"), "x.kind", "x.at_ms")


PAUSES_SQL = """
ev AS (SELECT vid, unnest(CASE vid % 4 WHEN 0 THEN [-32, -26] WHEN 1 THEN [-26, -20] ELSE [-20] END) AS level_db,
   end_ms AS a, end_ms + CASE WHEN id % 3 = 0 THEN -1 ELSE 500 END AS b FROM lines WHERE id % 5 = 0),
sa AS (SELECT vid, level_db, a, row_number() OVER (PARTITION BY vid, level_db ORDER BY a) AS k FROM ev),
sb AS (SELECT vid, level_db, b, row_number() OVER (PARTITION BY vid, level_db ORDER BY b) AS k FROM ev),
points AS (SELECT sa.vid, CAST(sa.level_db AS BIGINT) AS level_db, (a + b) // 2 AS at_ms FROM sa
   JOIN sb ON sa.vid = sb.vid AND sa.level_db = sb.level_db AND sa.k = sb.k WHERE b > a),
quiet AS (SELECT vid, at_ms FROM points WHERE level_db = (SELECT min(level_db) FROM points p WHERE p.vid = points.vid)),
vids AS (SELECT vid, max(total_ms) AS duration_ms FROM lines GROUP BY vid)
"""


@query("t01_pause_points", V.with_lines(PAUSES_SQL + "SELECT vid, level_db, at_ms FROM points"))
def _(spark, sf_dir):
    return T.pause_points(_pause_events(spark, sf_dir))


@query("t02_quiet_points", V.with_lines(PAUSES_SQL + "SELECT vid, at_ms FROM quiet"))
def _(spark, sf_dir):
    return T.quiet_points(T.pause_points(_pause_events(spark, sf_dir)))


def _videos_of_lines(spark, sf_dir):
    return V.lines(spark, sf_dir).where("id = 0").select("vid", F.col("total_ms").alias("duration_ms"))


def _planned(spark, sf_dir):
    points = T.quiet_points(T.pause_points(_pause_events(spark, sf_dir)))
    return T.plan_chunks(_videos_of_lines(spark, sf_dir), points)


PLAN_SQL = PAUSES_SQL + """,
cuts AS (SELECT vid, duration_ms, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS k FROM vids
  UNION ALL
  SELECT c.vid, c.duration_ms, coalesce(min({'d': abs(q.at_ms - c.cut - 900000), 'q': q.at_ms}).q, c.cut + 900000), c.k + 1
  FROM cuts c LEFT JOIN quiet q ON q.vid = c.vid AND abs(q.at_ms - c.cut - 900000) < 45000
  WHERE c.duration_ms > 900000 AND c.cut + 900000 < c.duration_ms - 30000
  GROUP BY c.vid, c.duration_ms, c.cut, c.k),
plan AS (SELECT vid, k AS chunk, cut AS start_ms,
  coalesce(lead(cut) OVER (PARTITION BY vid ORDER BY k), duration_ms) - cut AS length_ms FROM cuts)
"""


@query("t03_plan_chunks", V.with_lines(PLAN_SQL + "SELECT * FROM plan", True))
def _(spark, sf_dir):
    return _planned(spark, sf_dir)


LEAD_SQL = PLAN_SQL + """,
led AS (SELECT *, CASE WHEN start_ms > 50 THEN 2500 ELSE 0 END AS lead_ms FROM plan)
"""


@query("t04_with_lead", V.with_lines(LEAD_SQL + """SELECT *, CAST(lead_ms AS BIGINT) AS lead_ms,
  start_ms - lead_ms AS offset_ms, length_ms + lead_ms AS span_ms FROM led""".replace("SELECT *,", "SELECT vid, chunk, start_ms, length_ms,"), True))
def _(spark, sf_dir):
    return T.with_lead(_planned(spark, sf_dir))


@query("t05_split_oversize", f"""WITH {V.VIDEOS_SQL},
sized AS (SELECT vid, CAST(0 AS BIGINT) AS start_ms, duration_s * 1000 AS length_ms,
  duration_s * 1000 * (10 + vid % 97) AS size_bytes FROM videos),
deep AS (SELECT *, CASE WHEN size_bytes <= 25165824 THEN 1
   ELSE CAST(pow(2, ceil(log2(ceil(size_bytes / 25165824.0)))) AS BIGINT) END AS n FROM sized),
judged AS (SELECT *, n > 1 AND length_ms / n < 30000 AS rejected FROM deep)
SELECT vid, start_ms + (length_ms * part) // m AS start_ms, (length_ms * (part + 1)) // m - (length_ms * part) // m AS length_ms,
  size_bytes, rejected, part FROM (SELECT *, CASE WHEN rejected THEN 1 ELSE n END AS m,
  unnest(range(CASE WHEN rejected THEN 1 ELSE n END)) AS part FROM judged)""")
def _(spark, sf_dir):
    v = V.videos(spark, sf_dir)
    length = F.col("duration_s") * 1000
    return T.split_oversize(v.select("vid", F.lit(0).cast("bigint").alias("start_ms"), length.alias("length_ms"),
                                     (length * (F.lit(10) + F.col("vid") % 97)).alias("size_bytes")))


KEY_SQL = """substr(sha1('whisper|auto|' || ((start_ms - lead_ms) // 1000) || '.' || lpad(CAST((start_ms - lead_ms) % 1000 AS VARCHAR), 3, '0')
  || '|' || ((length_ms + lead_ms) // 1000) || '.' || lpad(CAST((length_ms + lead_ms) % 1000 AS VARCHAR), 3, '0')), 1, 16)"""


def _keyed(spark, sf_dir):
    led = T.with_lead(_planned(spark, sf_dir))
    return led.select("vid", "chunk", T.chunk_key(F.lit("whisper"), F.lit("auto"), F.col("offset_ms"), F.col("span_ms")).alias("chunk_key"))


@query("t06_chunk_key", V.with_lines(LEAD_SQL + f"SELECT vid, chunk, {KEY_SQL} AS chunk_key FROM led", True))
def _(spark, sf_dir):
    return _keyed(spark, sf_dir)


@query("t07_pending_chunks", V.with_lines(LEAD_SQL + f""", keyed AS (SELECT vid, chunk, {KEY_SQL} AS chunk_key FROM led)
SELECT vid, chunk, chunk_key FROM keyed WHERE chunk_key NOT IN (SELECT chunk_key FROM keyed WHERE vid % 3 = 0)""", True))
def _(spark, sf_dir):
    keyed = _keyed(spark, sf_dir)
    return T.pending_chunks(keyed, keyed.where("vid % 3 = 0")).select("vid", "chunk", "chunk_key")


GLOBAL_SQL = V.RAW_SQL + """,
wholefile AS (SELECT vid, chunk, chunk_ms, lead_ms, seq, rel_start_ms + chunk_ms - lead_ms AS start_ms,
  rel_end_ms + chunk_ms - lead_ms AS end_ms, text, lang, duration_ms FROM raw),
kept AS (SELECT * FROM wholefile WHERE NOT (lead_ms > 0 AND start_ms + end_ms < chunk_ms * 2))
"""


@query("t08_globalise", V.with_lines(GLOBAL_SQL + "SELECT vid, chunk, seq, start_ms, end_ms FROM wholefile"))
def _(spark, sf_dir):
    return T.globalise(V.raw_segments(spark, sf_dir)).select("vid", "chunk", "seq", "start_ms", "end_ms")


@query("t09_drop_lead_dupes", V.with_lines(GLOBAL_SQL + "SELECT vid, chunk, seq, start_ms, end_ms FROM kept"))
def _(spark, sf_dir):
    return T.drop_lead_dupes(T.globalise(V.raw_segments(spark, sf_dir))).select("vid", "chunk", "seq", "start_ms", "end_ms")


def _chunk_languages(spark, sf_dir):
    spoken = F.when((F.col("vid") + F.col("chunk")) % 3 == 0, "French") \
        .when((F.col("vid") + F.col("chunk")) % 3 == 1, "vietnamese").otherwise(F.when(F.col("vid") % 2 == 0, "").otherwise("xx"))
    return V.raw_segments(spark, sf_dir).select("vid", "chunk").distinct().withColumn("language", spoken)


CODES_SQL = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.LANGUAGE_CODES.items()) + " ELSE language END"


@query("t10_vote_language", V.with_lines(V.RAW_SQL + f""",
ch AS (SELECT DISTINCT vid, chunk, CASE (vid + chunk) % 3 WHEN 0 THEN 'French' WHEN 1 THEN 'vietnamese'
   ELSE CASE WHEN vid % 2 = 0 THEN '' ELSE 'xx' END END AS language FROM raw),
votes AS (SELECT vid, lower(trim(language)) AS language, count(*) AS n, min(chunk) AS f FROM ch WHERE trim(language) <> '' GROUP BY ALL),
won AS (SELECT vid, language FROM votes QUALIFY row_number() OVER (PARTITION BY vid ORDER BY n DESC, f) = 1),
done AS (SELECT a.vid, coalesce(w.language, 'german') AS language FROM (SELECT DISTINCT vid FROM ch) a LEFT JOIN won w ON a.vid = w.vid)
SELECT vid, {CODES_SQL} AS language FROM done"""))
def _(spark, sf_dir):
    return T.vote_language(_chunk_languages(spark, sf_dir), "german")


@query("t11_lang_code", f"""WITH d AS (SELECT doc_id AS vid,
  CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE lang END AS language FROM documents)
SELECT vid, {CODES_SQL} AS code FROM d""")
def _(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    name = F.when(F.col("lang") == "en", "english").when(F.col("lang") == "fr", "french") \
        .when(F.col("lang") == "de", "german").otherwise(F.col("lang"))
    return d.select(F.col("doc_id").alias("vid"), T.language_code(name).alias("code"))


RATIO_SQL = f"""
worded AS (SELECT *, list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda w: w <> '') AS ws FROM lines),
ratio AS (SELECT vid, id, start_ms, end_ms, text, total_ms, CASE WHEN len(ws) < 6 THEN 0.0::DOUBLE
  ELSE len(list_filter(ws, lambda w: length(w) <= 2))::DOUBLE / len(ws) END AS ratio FROM worded),
broken AS (SELECT *, end_ms - start_ms >= 3000 AND ratio > 0.2 AS bad FROM ratio)
"""
LOOSE = {"span_ms": 3000, "ratio": 0.2}


@query("t12_fragment_ratio", V.with_lines(RATIO_SQL + "SELECT vid, id, CAST(floor(ratio * 1000000 + 0.5) AS BIGINT) AS ratio_ppm FROM ratio"))
def _(spark, sf_dir):
    return V.lines(spark, sf_dir).select("vid", "id", X.half_up(T.fragment_ratio(F.col("text")) * 1000000).alias("ratio_ppm"))


@query("t13_is_collapsed", V.with_lines(RATIO_SQL + "SELECT vid, id, end_ms - start_ms >= 8000 AND ratio > 0.55 AS collapsed, bad AS doubtful FROM broken"))
def _(spark, sf_dir):
    return V.lines(spark, sf_dir).select("vid", "id", T.is_collapsed().alias("collapsed"), T.is_collapsed(**LOOSE).alias("doubtful"))


@query("t14_repair_plan", V.with_lines(RATIO_SQL + """SELECT vid, id AS seq, n, greatest(0, start_ms - 300) AS offset_ms, end_ms - start_ms + 600 AS span_ms
FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY start_ms, id) AS n FROM broken WHERE bad) WHERE n <= 40"""))
def _(spark, sf_dir):
    return T.repair_plan(V.lines(spark, sf_dir).withColumnRenamed("id", "seq"), **LOOSE)


def _fixes(lines):
    """Two recovered halves for every other doubtful line."""
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("bigint")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = lines.where(T.is_collapsed(**LOOSE) & (F.col("seq") % 2 == 0))
    return rows.select("vid", "seq", F.explode(F.array(
        X.rec(part=F.lit(0).cast("bigint"), s=F.col("start_ms"), e=mid, t=F.substr("text", F.lit(1), half)),
        X.rec(part=F.lit(1).cast("bigint"), s=mid, e=F.col("end_ms"), t=F.substr("text", half + 1)))).alias("x")) \
        .select("vid", "seq", "x.part", F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"), F.col("x.t").alias("text"))


def _fix_sql(src: str) -> str:
    """CTEs ``fixes`` and ``mended`` from a relation with vid, seq, start_ms, end_ms, text, bad."""
    return f"""
fixes AS (SELECT vid, seq, 0 AS part, start_ms, (start_ms + end_ms) // 2 AS end_ms, substr(text, 1, length(text) // 2) AS text FROM {src} WHERE bad AND seq % 2 = 0
  UNION ALL SELECT vid, seq, 1, (start_ms + end_ms) // 2, end_ms, substr(text, length(text) // 2 + 1) FROM {src} WHERE bad AND seq % 2 = 0),
mended AS (SELECT vid, seq, 0 AS part, start_ms, end_ms, text, duration_ms FROM {src} WHERE NOT bad
  UNION ALL SELECT b.vid, b.seq, coalesce(f.part, 0), coalesce(f.start_ms, b.start_ms), coalesce(f.end_ms, b.end_ms),
    coalesce(trim(f.text, {STRIP}), b.text), duration_ms FROM {src} b LEFT JOIN (SELECT * FROM fixes WHERE trim(text, {STRIP}) <> '') f
    ON b.vid = f.vid AND b.seq = f.seq WHERE bad)"""


@query("t15_apply_repairs", V.with_lines(RATIO_SQL + ", broke AS (SELECT *, id AS seq, total_ms AS duration_ms FROM broken)," + _fix_sql("broke")
       + " SELECT vid, seq, CAST(part AS BIGINT) AS part, start_ms, end_ms, text FROM mended"))
def _(spark, sf_dir):
    ln = V.lines(spark, sf_dir).withColumnRenamed("id", "seq").select("vid", "seq", "start_ms", "end_ms", "text")
    return T.apply_repairs(ln, _fixes(ln), **LOOSE)


FLAT_SQL = f"regexp_replace(text, '[{WS}{K.ARTEFACT_CLASS}]', '', 'g')"
FILLER_SQL = ", ".join(f"regexp_replace('{x}', '[{WS}{K.ARTEFACT_CLASS}]', '', 'g')" for x in K.FILLER_LINES)


def _artefact_sql(src: str, out: str) -> str:
    return f"""{out} AS (SELECT * REPLACE (trim(text, {STRIP}) AS text) FROM {src} WHERE {FLAT_SQL} <> '' AND {FLAT_SQL} NOT IN ({FILLER_SQL})
  AND NOT (length({FLAT_SQL}) > 6 AND len(list_distinct(string_split({FLAT_SQL}, ''))) = 1))"""


def _noisy(spark, sf_dir):
    """Lines with filler, punctuation-only and stuck-character lines mixed in."""
    k = F.col("id") % 9
    text = F.when(k == 2, F.lit("Thanks for  watching")).when(k == 4, F.lit(" ?!. ")).when(k == 6, F.lit("aa a,aaaaa")) \
        .when(k == 8, F.concat(F.lit("\t "), F.col("text"), F.lit(" \n"))).otherwise(F.col("text"))
    return V.lines(spark, sf_dir).withColumn("text", text)


NOISY_SQL = """noisy AS (SELECT * REPLACE (CASE id % 9 WHEN 2 THEN 'Thanks for  watching' WHEN 4 THEN ' ?!. ' WHEN 6 THEN 'aa a,aaaaa'
  WHEN 8 THEN chr(9) || ' ' || text || ' ' || chr(10) ELSE text END AS text) FROM lines)"""


@query("t16_drop_artefacts", V.with_lines(NOISY_SQL + "," + _artefact_sql("noisy", "clean") + " SELECT vid, id, text FROM clean"))
def _(spark, sf_dir):
    return T.drop_artefacts(_noisy(spark, sf_dir)).select("vid", "id", "text")


def _tight(spark, sf_dir):
    """Every seventh video has its ends stretched so lines overlap deeply."""
    stretch = F.when(F.col("vid") % 7 == 0, F.col("id") % 11 * 700).otherwise(F.col("id") % 4 * 60)
    return V.lines(spark, sf_dir).select("vid", "id", "start_ms", (F.col("end_ms") + stretch).alias("end_ms"), "text",
                                         (F.col("total_ms") - 200).alias("duration_ms"))


def _overlap_sql(src: str, out: str) -> str:
    """Recursive counterpart of the overlap repair; src has a dense id."""
    return f"""
{out}_c AS MATERIALIZED (SELECT *, greatest(0, least(start_ms, duration_ms)) AS cs,
  greatest(greatest(0, least(start_ms, duration_ms)) + 200, least(end_ms, duration_ms)) AS ce FROM {src}),
{out}_r AS (SELECT vid, id, cs AS s, ce AS e FROM {out}_c WHERE id = 0
  UNION ALL SELECT c.vid, c.id, greatest(c.cs, r.e),
    CASE WHEN c.cs < r.e AND c.ce <= r.e + 150 THEN r.e + 400 ELSE c.ce END
  FROM {out}_r r JOIN {out}_c c ON c.vid = r.vid AND c.id = r.id + 1),
{out} AS (SELECT c.* REPLACE (r.s AS start_ms, r.e AS end_ms) FROM {out}_c c JOIN {out}_r r ON c.vid = r.vid AND c.id = r.id)"""


@query("t17_fix_overlaps", V.with_lines("""tight AS (SELECT vid, id, start_ms, end_ms + CASE WHEN vid % 7 = 0 THEN id % 11 * 700 ELSE id % 4 * 60 END AS end_ms,
  text, total_ms - 200 AS duration_ms FROM lines),""" + _overlap_sql("tight", "fixed") + " SELECT vid, id, start_ms, end_ms, text FROM fixed", True))
def _(spark, sf_dir):
    return T.fix_overlaps(_tight(spark, sf_dir)).select("vid", "id", "start_ms", "end_ms", "text")


def _merge_sql(src: str, out: str) -> str:
    cjk = f"regexp_matches(r.gt || l.text, '[{K.CJK_CLASS}]')"
    return f"""
{out}_l AS MATERIALIZED (SELECT * FROM {src}),
{out}_r AS (SELECT vid, id, id AS gid, start_ms AS gs, end_ms AS ge, text AS gt FROM {out}_l WHERE id = 0
  UNION ALL SELECT vid, id, CASE WHEN j THEN gid ELSE id END, CASE WHEN j THEN gs ELSE start_ms END, end_ms,
    CASE WHEN j THEN gt || CASE WHEN cjk THEN '' ELSE ' ' END || text ELSE text END
  FROM (SELECT l.vid, l.id, l.start_ms, l.end_ms, l.text, r.gid, r.gs, r.gt, {cjk} AS cjk,
      l.start_ms - r.ge <= 400 AND l.end_ms - r.gs <= 7000 AND length(r.gt) + length(l.text) <= 44
      AND NOT regexp_matches(r.gt, '[。！？!?…][{WS}]*$') AS j
    FROM {out}_r r JOIN {out}_l l ON l.vid = r.vid AND l.id = r.id + 1)),
{out} AS (SELECT vid, gid AS id, min(gs) AS start_ms, max_by(ge, id) AS end_ms, max_by(gt, id) AS text FROM {out}_r GROUP BY vid, gid)"""


def _short(spark, sf_dir):
    """Lines cut to a few characters on two thirds of the videos, so that many merge."""
    text = F.when(F.col("vid") % 3 == 0, F.col("text")).otherwise(X.strip(F.substring("text", 1, 9)))
    start, end = F.floor(F.col("id") * 900).cast("bigint"), F.floor(F.col("id") * 900 + 700 + F.col("id") % 7 * 30).cast("bigint")
    return V.lines(spark, sf_dir).select("vid", "id", start.alias("start_ms"), end.alias("end_ms"), text.alias("text"))


SHORT_SQL = f"""short AS (SELECT vid, id, id * 900 AS start_ms, id * 900 + 700 + id % 7 * 30 AS end_ms,
  CASE WHEN vid % 3 = 0 THEN text ELSE trim(substr(text, 1, 9), {STRIP}) END AS text FROM lines)"""


@query("t18_merge_lines", V.with_lines(SHORT_SQL + "," + _merge_sql("short", "merged") + " SELECT vid, id, start_ms, end_ms, text FROM merged", True))
def _(spark, sf_dir):
    return T.merge_lines(_short(spark, sf_dir))


def _split_sql(src: str, out: str) -> str:
    def best(chars):
        return f"""(list_min(list_transform(list_filter(range(greatest(1, want - reach), least(n - 1, want + reach)),
            lambda j: instr('{chars}', substr(text, j + 1, 1)) > 0), lambda j: abs(j - want) * 1000000 + j)) % 1000000 + 1)"""
    return f"""
{out}_p AS (SELECT *, length(text) AS n, end_ms - start_ms AS span, (end_ms - start_ms) // 7000 + 1 AS parts FROM {src}),
{out}_k AS (SELECT *, CAST(floor(k * (n::DOUBLE / parts)) AS BIGINT) AS want, greatest(2, n // (parts * 5)) AS reach
  FROM (SELECT *, unnest(range(1, parts)) AS k FROM {out}_p WHERE parts >= 2 AND n >= 8)),
{out}_c AS (SELECT vid, seq, coalesce({best(K.BREAK_SENTENCE)}, {best(K.BREAK_CLAUSE)}, {best(K.BREAK_SPACE)}, want) AS c, n FROM {out}_k),
{out}_b AS (SELECT DISTINCT vid, seq, c FROM {out}_c WHERE c > 0 AND c < n
  UNION SELECT vid, seq, 0 FROM {out}_p UNION SELECT vid, seq, n FROM {out}_p),
{out}_e AS (SELECT vid, seq, c AS a, lead(c) OVER (PARTITION BY vid, seq ORDER BY c) AS b,
  row_number() OVER (PARTITION BY vid, seq ORDER BY c) - 1 AS part FROM {out}_b),
{out} AS (SELECT p.vid, p.seq, e.part,
  CASE WHEN whole THEN start_ms ELSE CAST(floor((start_ms + span * (a::DOUBLE / n)) / 10 + 0.5) AS BIGINT) * 10 END AS start_ms,
  CASE WHEN whole THEN end_ms ELSE CAST(floor((start_ms + span * (b::DOUBLE / n)) / 10 + 0.5) AS BIGINT) * 10 END AS end_ms,
  CASE WHEN whole THEN text ELSE trim(substr(text, a + 1, b - a), {STRIP}) END AS text
  FROM (SELECT *, parts < 2 OR n < 8 AS whole FROM {out}_p) p JOIN {out}_e e ON p.vid = e.vid AND p.seq = e.seq
  WHERE b IS NOT NULL AND (whole OR trim(substr(text, a + 1, b - a), {STRIP}) <> ''))"""


@query("t19_split_long", V.with_lines("src AS (SELECT vid, id AS seq, start_ms, end_ms, text FROM lines),"
       + _split_sql("src", "cutup") + " SELECT vid, seq, part, start_ms, end_ms, text FROM cutup"))
def _(spark, sf_dir):
    ln = V.lines(spark, sf_dir).select("vid", F.col("id").alias("seq"), "start_ms", "end_ms", "text")
    return T.split_long(ln)


@query("t20_renumber", V.with_lines("""SELECT vid, id AS seq, row_number() OVER (PARTITION BY vid ORDER BY end_ms % 5000, id) - 1 AS id,
  end_ms % 5000 AS start_ms FROM lines"""))
def _(spark, sf_dir):
    ln = V.lines(spark, sf_dir).select("vid", F.col("id").alias("seq"), (F.col("end_ms") % 5000).alias("start_ms"))
    return T.renumber(ln)


ASSEMBLE_SQL = GLOBAL_SQL + RATIO_SQL.replace("FROM lines)", f"FROM (SELECT vid, seq AS id, start_ms, end_ms, trim(text, {STRIP}) AS text, duration_ms AS total_ms FROM kept WHERE trim(text, {STRIP}) <> ''))").replace("\nworded", ",\nworded") + \
    ", broke AS (SELECT *, id AS seq, total_ms AS duration_ms FROM broken)," + _fix_sql("broke") + "," + \
    _artefact_sql("mended", "wiped") + """,
ranked AS (SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY start_ms, seq, part) - 1 AS id, start_ms, end_ms, text, duration_ms FROM wiped),""" + \
    _overlap_sql("ranked", "fixed") + ", presplit AS (SELECT vid, id AS seq, start_ms, end_ms, text FROM fixed)," + \
    _split_sql("presplit", "cutup") + """,
numbered AS (SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY start_ms, seq, part) - 1 AS id, start_ms, end_ms, text FROM cutup),""" + \
    _merge_sql("numbered", "merged") + """
SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY start_ms, id) - 1 AS id, start_ms, end_ms, text FROM merged"""


@query("t21_assemble", V.with_lines(ASSEMBLE_SQL, True))
def _(spark, sf_dir):
    raw = V.raw_segments(spark, sf_dir)
    heard = T.drop_lead_dupes(T.globalise(raw)).withColumn("text", X.strip(F.col("text"))).select("vid", "seq", "start_ms", "end_ms", "text")
    return T.assemble(raw, _fixes(heard), **LOOSE)
