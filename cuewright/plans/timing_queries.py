"""Timing and audit queries over the given tables, with their DuckDB counterparts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..operators import audit as Q
from ..operators import timing as D
from . import views as V
from .registry import query

WS = K.WHITESPACE_CLASS
STRIP = "'" + K.WHITESPACE + "'"

SLOT_SQL = f"""
said AS (SELECT *, trim(en, {STRIP}) AS t, lead(start_ms) OVER (PARTITION BY vid ORDER BY id) AS next_ms FROM lines),
breath AS (SELECT *, CASE WHEN t = '' THEN 60 WHEN right(t, 1) IN ('.', '!', '?', '…') THEN 300
   WHEN right(t, 1) IN (',', ';', ':', '—', '-') THEN 170 ELSE 90 END AS own FROM said),
slot AS (SELECT *, CAST(CASE WHEN next_ms IS NULL THEN 60 ELSE own END AS BIGINT) AS breath_ms,
  greatest(350, coalesce(next_ms, total_ms) - CASE WHEN next_ms IS NULL THEN 60 ELSE own END - start_ms) AS slot_ms FROM breath),
spoken AS (SELECT *, CAST(length(en) * 60 AS BIGINT) AS natural_ms FROM slot WHERE trim(en) <> ''),
rend AS (SELECT *, CASE WHEN natural_ms / slot_ms <= 1.02::DOUBLE THEN 1.0::DOUBLE ELSE least(natural_ms / slot_ms, 1.35::DOUBLE) END AS native_rate FROM spoken),
dur AS (SELECT *, natural_ms / native_rate AS d, CAST(coalesce(next_ms, total_ms) - start_ms AS DOUBLE) AS room FROM rend),
wide AS (SELECT *, greatest(300.0::DOUBLE, room - breath_ms) AS w FROM dur),
gap AS (SELECT *, CASE WHEN d / w > 1.25::DOUBLE THEN greatest(300.0::DOUBLE, least(room - 60, greatest(60.0::DOUBLE, d / 1.25::DOUBLE))) ELSE w END AS gap_ms FROM wide),
tempo0 AS (SELECT *, least(greatest(1.0::DOUBLE, d / gap_ms), greatest(1.0::DOUBLE, least(1.55::DOUBLE, 1.7::DOUBLE / native_rate))) AS plain_tempo,
  CASE WHEN next_ms IS NOT NULL THEN greatest(200, next_ms - start_ms - 40) END AS limit_ms FROM gap),
crowd AS (SELECT *, coalesce(d / plain_tempo > limit_ms, false) AS crowded FROM tempo0),
tempo AS (SELECT *, CASE WHEN crowded THEN least(greatest(plain_tempo, d / limit_ms), greatest(plain_tempo, least(1.9::DOUBLE, 2.15::DOUBLE / native_rate)))
  ELSE plain_tempo END AS tempo FROM crowd),
plan AS (SELECT *, crowded AND d / tempo > limit_ms + 10 AS clipped,
  CAST(floor(tempo * native_rate * 1000 + 0.5) AS BIGINT) AS rate_milli,
  start_ms AS dub_start_ms, CAST(floor(start_ms + coalesce(least(d / tempo, limit_ms), d / tempo) + 0.5) AS BIGINT) AS dub_end_ms FROM tempo)
"""


def milli(name):
    return X.half_up(F.col(name) * 1000).alias(name)


def micro_sql(name):
    return f"CAST(floor({name} * 1000 + 0.5) AS BIGINT) AS {name}"


def _plan(spark, sf_dir):
    ln = V.lines(spark, sf_dir)
    return D.dub_plan(ln, D.rendered(D.slots(ln), V.renders(spark, sf_dir)))


@query("d01_clean_for_speech", V.with_lines(f"""SELECT vid, id, trim(regexp_replace(strip_accents(replace(regexp_replace(replace(
   en, '…', ' '), '^[{WS}]*\\.\\.\\.[{WS}]*', ''), '—', ' - ')), '[{WS}]+', ' ', 'g'), {STRIP}) AS spoken FROM lines WHERE lang <> 'xx'"""))
def _(spark, sf_dir):
    return V.lines(spark, sf_dir).select("vid", "id", X.clean_for_speech(F.col("en")).alias("spoken"))


FP_SQL = V.with_lines(f"""spoken AS (SELECT vid, id, trim(regexp_replace(strip_accents(en), '[{WS}]+', ' ', 'g'), {STRIP}) AS spoken FROM lines),
fp AS (SELECT vid, id, spoken, substr(sha1('voice|0|5|0|' || spoken), 1, 10) AS fingerprint FROM spoken)""")
VOICE = {"voice": "voice", "pitch": 0, "speed": 5, "volume": 0}


@query("d02_render_fingerprint", FP_SQL + " SELECT vid, id, fingerprint FROM fp")
def _(spark, sf_dir):
    return D.with_fingerprint(V.lines(spark, sf_dir), **VOICE).select("vid", "id", "fingerprint")


@query("d03_to_render", FP_SQL + " SELECT vid, id, fingerprint FROM fp WHERE spoken <> '' AND NOT (id % 3 = 0 AND id * 100 > 512)")
def _(spark, sf_dir):
    ln = V.lines(spark, sf_dir)
    done = D.with_fingerprint(ln.where("id % 3 = 0"), **VOICE).select("vid", "id", "fingerprint", (F.col("id") * 100).alias("size_bytes"))
    return D.to_render(ln, done, **VOICE).select("vid", "id", "fingerprint")


@query("d04_breath_after", V.with_lines(SLOT_SQL + "SELECT vid, id, CAST(own AS BIGINT) AS breath_ms FROM breath"))
def _(spark, sf_dir):
    return V.lines(spark, sf_dir).select("vid", "id", D.breath_after(F.col("en")).alias("breath_ms"))


@query("d05_slot_width", V.with_lines(SLOT_SQL + "SELECT vid, id, slot_ms FROM slot"))
def _(spark, sf_dir):
    return D.slots(V.lines(spark, sf_dir)).select("vid", "id", "slot_ms")


@query("d06_native_rate", V.with_lines(SLOT_SQL + f"""SELECT vid, id, {micro_sql('native_rate')},
  CAST(round_even((1.0::DOUBLE * native_rate - 1.0) * 100, 0) AS BIGINT) AS rate_pct FROM rend"""))
def _(spark, sf_dir):
    r = D.rendered(D.slots(V.lines(spark, sf_dir)), V.renders(spark, sf_dir))
    return r.select("vid", "id", milli("native_rate"), "rate_pct")


@query("d07_plan_gap", V.with_lines(SLOT_SQL + f"SELECT vid, id, {micro_sql('gap_ms')} FROM gap"))
def _(spark, sf_dir):
    return _plan(spark, sf_dir).select("vid", "id", milli("gap_ms"))


@query("d08_plan_tempo", V.with_lines(SLOT_SQL + f"SELECT vid, id, {micro_sql('plain_tempo')} FROM tempo0"))
def _(spark, sf_dir):
    return _plan(spark, sf_dir).select("vid", "id", milli("plain_tempo"))


@query("d09_rescue", V.with_lines(SLOT_SQL + f"SELECT vid, id, {micro_sql('tempo')}, crowded FROM plan WHERE crowded"))
def _(spark, sf_dir):
    return _plan(spark, sf_dir).where("crowded").select("vid", "id", milli("tempo"), "crowded")


@query("d10_clipped", V.with_lines(SLOT_SQL + "SELECT vid, id, clipped FROM plan WHERE clipped"))
def _(spark, sf_dir):
    return _plan(spark, sf_dir).where("clipped").select("vid", "id", "clipped")


@query("d11_flags_recomputed", V.with_lines(SLOT_SQL + "SELECT vid, id, crowded, clipped FROM plan"))
def _(spark, sf_dir):
    """Lines that carry flags of an earlier plan; the new plan replaces all of them."""
    ln = V.lines(spark, sf_dir)
    stale = ln.withColumns({"crowded": F.col("id") % 2 == 0, "clipped": F.lit(True)})
    return D.dub_plan(stale, D.rendered(D.slots(ln), V.renders(spark, sf_dir))).select("vid", "id", "crowded", "clipped")


@query("d12_dub_plan", V.with_lines(SLOT_SQL + f"SELECT vid, id, {micro_sql('tempo')}, CAST(limit_ms AS BIGINT) AS limit_ms, crowded, clipped FROM plan"))
def _(spark, sf_dir):
    return _plan(spark, sf_dir).select("vid", "id", milli("tempo"), "limit_ms", "crowded", "clipped")


@query("d13_dub_times", V.with_lines(SLOT_SQL + "SELECT vid, id, dub_start_ms, dub_end_ms, rate_milli AS dub_speedup_milli FROM plan"))
def _(spark, sf_dir):
    return D.dub_times(_plan(spark, sf_dir)).select("vid", "id", "dub_start_ms", "dub_end_ms", "dub_speedup_milli")


@query("d14_overlapped", V.with_lines(SLOT_SQL + """SELECT vid, count(*) FILTER (WHERE o) AS overlapped FROM
 (SELECT vid, start_ms < lag(dub_end_ms) OVER (PARTITION BY vid ORDER BY id) - 20 AS o FROM plan) GROUP BY vid"""))
def _(spark, sf_dir):
    timed = D.dub_times(_plan(spark, sf_dir)).select("vid", "id", "start_ms", "dub_end_ms")
    return D.overlapped(timed).groupBy("vid").agg(F.count_if("overlapped").alias("overlapped"))


STATS_SQL = """SELECT vid, count(*) AS lines, count(*) FILTER (WHERE tempo > 1.01) AS compressed, count(*) FILTER (WHERE crowded) AS crowded,
  count(*) FILTER (WHERE clipped) AS clipped, greatest(1000, max(rate_milli)) AS max_rate_milli FROM plan GROUP BY vid"""


@query("d15_dub_stats", V.with_lines(SLOT_SQL + STATS_SQL))
def _(spark, sf_dir):
    return D.dub_stats(_plan(spark, sf_dir))


@query("d15_failed_lines", V.with_lines(SLOT_SQL + f""", st AS ({STATS_SQL}), lost AS (SELECT vid, count(*) AS failed FROM lines
  WHERE trim(en, {STRIP}) <> '' AND id % 11 = 3 GROUP BY vid)
SELECT coalesce(st.vid, lost.vid) AS vid, coalesce(lines, 0) AS lines, coalesce(compressed, 0) AS compressed, coalesce(crowded, 0) AS crowded,
  coalesce(clipped, 0) AS clipped, coalesce(max_rate_milli, 1000) AS max_rate_milli, coalesce(failed, 0) AS failed FROM st FULL JOIN lost ON st.vid = lost.vid"""))
def _(spark, sf_dir):
    """Renders of every eleventh line have failed."""
    return D.with_failed(D.dub_stats(_plan(spark, sf_dir)), V.lines(spark, sf_dir), V.renders(spark, sf_dir).where("id % 11 <> 3"))


STAMP_SQL = """parts AS (SELECT vid, id // 16 AS b, substr(sha1(string_agg(id || ':' || start_ms || ':' || en, chr(31) ORDER BY id)), 1, 16) AS p FROM lines GROUP BY vid, b),
digests AS (SELECT vid, substr(sha1(string_agg(p, chr(31) ORDER BY b)), 1, 16) AS d FROM parts GROUP BY vid),
stamps AS (SELECT vid, substr(sha1('voice|0|0|0|1.7|0|||' || d), 1, 16) AS stamp FROM digests)"""
OPTIONS = ["voice", 0, 0, 0, 1.7, 0, None, None]


@query("d16_dub_stamp", V.with_lines(STAMP_SQL + " SELECT vid, stamp FROM stamps"))
def _(spark, sf_dir):
    return D.dub_stamp(V.lines(spark, sf_dir), OPTIONS, 16)


@query("d17_reuse_track", V.with_lines(STAMP_SQL + " SELECT vid, stamp FROM stamps WHERE vid % 4 < 2"))
def _(spark, sf_dir):
    now = D.dub_stamp(V.lines(spark, sf_dir), OPTIONS, 16).withColumn("size_bytes", F.col("vid") * 10)
    past = now.withColumn("stamp", F.when(F.col("vid") % 4 == 3, "other").otherwise(F.col("stamp"))) \
        .withColumn("size_bytes", F.when(F.col("vid") % 4 == 2, -1).otherwise(F.col("size_bytes"))).withColumn("stage", F.lit("dub"))
    return D.reuse_track(past, now).select("vid", "stamp")


@query("d18_final_stats", V.with_lines(f"""SELECT vid, count(*) AS line_count, count(*) FILTER (WHERE trim(en, {STRIP}) <> '') AS translated_lines,
  '5' AS speed FROM lines GROUP BY vid"""))
def _(spark, sf_dir):
    return D.final_stats(V.lines(spark, sf_dir), {"pitch": 0, "speed": 5, "volume": 0, "keep_original_audio": False}) \
        .select("vid", "line_count", "translated_lines", F.col("stats")["speed"].alias("speed"))


# ---- audit ---------------------------------------------------------------------------
NW = r"[^\p{L}\p{N}_]"
MARKERS = {"en": ("(^| )the ", "(^| )and "), "fr": ("(^| )la ", "(^| )des "), "de": ("(^| )die ", "(^| )und ")}
YOU_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN regexp_matches(text, '{a}')" for k, (a, _) in MARKERS.items()) + " ELSE false END"
THEM_SQL = "CASE lang " + " ".join(f"WHEN '{k}' THEN regexp_matches(text, '{b}')" for k, (_, b) in MARKERS.items()) + " ELSE false END"


def _faults_sql(en, source, budget, inside, carried, narrated):
    q = f'["“”]'
    narration = (f"array_to_string(list_filter(regexp_split_to_array({en}, '{q}'), lambda p, i: (i - 1) % 2 = CASE WHEN {inside} THEN 1 ELSE 0 END), ' ')")
    cjk = f"len(regexp_extract_all({source}, '[{K.SOURCE_SCRIPT_CLASS}]'))"
    size = f"(CASE WHEN {cjk} >= length({source}) * 0.5 THEN {cjk} ELSE length({source}) END)"
    floor = f"(CASE WHEN {cjk} >= length({source}) * 0.5 THEN 1.2::DOUBLE ELSE 0.42::DOUBLE END)"
    words = K.SECOND_PERSON_WORDS.replace("'", "''")
    dangling = f"regexp_matches({en}, '(\\.\\.\\.|…)[{WS}]*$|(?i)(^|{NW})({K.DANGLING_WORDS})[{WS}]*[.,]?[{WS}]*$')"
    long = f"length({en}) > {budget} * 1.55::DOUBLE"
    return f"""CASE WHEN {en} = '' THEN '' ELSE concat_ws(';',
      CASE WHEN regexp_matches({en}, '(?i)(^|{NW})({K.CLASH_PHRASES})($|{NW})') THEN 'gender_clash' END,
      CASE WHEN {narrated} AND regexp_matches({narration}, '(?i)(^|{NW})({words})($|{NW})') AND right({en}, 1) <> '?' THEN 'second_person' END,
      CASE WHEN {dangling} AND NOT {carried} THEN 'unfinished' END,
      CASE WHEN regexp_matches({en}, '[{K.SOURCE_SCRIPT_CLASS}]') THEN 'source_script' END,
      CASE WHEN {long} THEN 'too_long' END,
      CASE WHEN NOT ({long}) AND length({source}) > 0 AND {size} >= 10 AND length({en}) < {size} * {floor} AND length({en}) < {budget} * 0.55::DOUBLE THEN 'dropped' END) END"""


AUDIT_SQL = f"""
narr AS (SELECT vid, n >= 12 AND you / n >= 0.4::DOUBLE AND you >= them AS narrated, n, you, them FROM
  (SELECT vid, count(*) AS n, count(*) FILTER (WHERE {YOU_SQL}) AS you, count(*) FILTER (WHERE {THEM_SQL}) AS them
   FROM lines WHERE trim(text, {STRIP}) <> '' GROUP BY vid)),
base AS (SELECT l.*, trim(en, {STRIP}) AS t, trim(text, {STRIP}) AS src,
  greatest(12, CAST(floor(greatest(400, end_ms - start_ms) * 15 / 1000.0) AS BIGINT)) AS budget,
  trim(lead(en) OVER (PARTITION BY l.vid ORDER BY id), {STRIP}) AS nxt, narrated FROM lines l JOIN narr ON l.vid = narr.vid),
q AS (SELECT vid, id, len(regexp_extract_all(t, '["“”]')) % 2 = 1 AS odd FROM base WHERE t <> ''),
i AS (SELECT *, sum(CASE WHEN odd THEN 0 ELSE 1 END) OVER (PARTITION BY vid ORDER BY id) AS isl FROM q),
r AS (SELECT *, sum(CASE WHEN odd THEN 1 ELSE 0 END) OVER (PARTITION BY vid, isl ORDER BY id) AS run_pos FROM i),
o AS (SELECT *, odd AND run_pos % 2 = 1 AS open_after FROM r),
carry AS (SELECT vid, id, coalesce(lag(open_after) OVER (PARTITION BY vid ORDER BY id), false) AS inside FROM o),
cont AS (SELECT b.*, coalesce(c.inside, false) AS inside, nxt IS NOT NULL AND (len(regexp_extract_all(t, '["“”]')) % 2 = 1
  OR (nxt <> '' AND ((lower(left(nxt, 1)) = left(nxt, 1) AND upper(left(nxt, 1)) <> left(nxt, 1)) OR left(nxt, 1) IN ('.', ',', '…', '"', '”')))) AS carried
  FROM base b LEFT JOIN carry c ON b.vid = c.vid AND b.id = c.id),
judged AS (SELECT *, {_faults_sql('t', 'src', 'budget', 'inside', 'carried', 'narrated')} AS faults FROM cont),
faulty AS (SELECT *, (row_number() OVER (PARTITION BY vid ORDER BY id) - 1) // 20 AS grp FROM judged WHERE faults <> '')
"""


def _narrated(spark, sf_dir):
    return Q.is_narrated(V.lines(spark, sf_dir), markers=MARKERS)


def _audit(spark, sf_dir):
    return Q.audit(V.lines(spark, sf_dir), _narrated(spark, sf_dir))


def _flag(name, op, sql):
    @query(name, V.with_lines(AUDIT_SQL + f"SELECT vid, id, {sql} AS flag FROM cont WHERE t <> ''"))
    def _(spark, sf_dir):
        ln = V.lines(spark, sf_dir)
        en = X.strip(F.col("en"))
        return ln.where(en != "").select("vid", "id", op(en, X.strip(F.col("text")), X.budget_chars(F.col("start_ms"), F.col("end_ms"))).alias("flag"))


_flag("q01_clash", lambda en, s, b: X.clash(en), f"regexp_matches(t, '(?i)(^|{NW})({K.CLASH_PHRASES})($|{NW})')")
_flag("q02_narration_of", lambda en, s, b: X.narration_of(en, F.lit(False)),
      """array_to_string(list_filter(regexp_split_to_array(t, '["“”]'), lambda p, i: (i - 1) % 2 = 0), ' ')""")
_flag("q07_source_left", lambda en, s, b: X.source_left(en), f"regexp_matches(t, '[{K.SOURCE_SCRIPT_CLASS}]')")
_flag("q08_over_budget", lambda en, s, b: X.over_budget(en, b), "length(t) > budget * 1.55::DOUBLE")
_flag("q09_dropped_content", lambda en, s, b: X.dropped_content(en, s, b),
      f"""length(src) > 0 AND length(src) >= 10 AND NOT regexp_matches(src, '[{K.SOURCE_SCRIPT_CLASS}]')
  AND length(t) < length(src) * 0.42::DOUBLE AND length(t) < budget * 0.55::DOUBLE""")


@query("q03_quote_carry", V.with_lines(AUDIT_SQL + "SELECT vid, id, inside FROM carry"))
def _(spark, sf_dir):
    return Q.quote_carry(V.lines(spark, sf_dir))


def _coded(name, code):
    @query(name, V.with_lines(AUDIT_SQL + f"SELECT vid, id FROM faulty WHERE contains(faults, '{code}')"))
    def _(spark, sf_dir):
        return _audit(spark, sf_dir).where(F.array_contains("faults", code)).select("vid", "id")


_coded("q04_pov_fault", "second_person")
_coded("q05_unfinished", "unfinished")


@query("q06_continues", V.with_lines(AUDIT_SQL + "SELECT vid, id, carried FROM cont"))
def _(spark, sf_dir):
    from .blocks import neighbours
    seen = neighbours(V.lines(spark, sf_dir), lambda w: {"nxt": F.lead("en").over(w)}, before=0)
    return seen.select("vid", "id", Q.continues(X.strip(F.col("en")), F.col("nxt")).alias("carried"))


@query("q10_is_narrated", V.with_lines(AUDIT_SQL + "SELECT vid, narrated FROM narr"))
def _(spark, sf_dir):
    return _narrated(spark, sf_dir)


@query("q11_audit", V.with_lines(AUDIT_SQL + "SELECT vid, id, faults FROM faulty"))
def _(spark, sf_dir):
    return _audit(spark, sf_dir).select("vid", "id", F.array_join("faults", ";").alias("faults"))


@query("q12_polish_groups", V.with_lines(AUDIT_SQL + "SELECT vid, id, grp FROM faulty"))
def _(spark, sf_dir):
    return Q.polish_groups(_audit(spark, sf_dir)).select("vid", "id", "grp")


@query("q13_polish_payload", V.with_lines(AUDIT_SQL + """SELECT vid, grp,
  string_agg(id || '|' || budget || '|' || replace(faults, ';', '; ') || '|' || text || '|' || en, chr(10) ORDER BY id) AS payload FROM faulty GROUP BY vid, grp"""))
def _(spark, sf_dir):
    return Q.polish_payload(Q.polish_groups(_audit(spark, sf_dir)))


@query("q14_polish_tokens", V.with_lines(AUDIT_SQL + """SELECT vid, grp, CAST(floor(least(2600.0::DOUBLE,
  greatest(400.0::DOUBLE, sum(budget) / 3.2::DOUBLE + count(*) * 6 + 80) * 2)) AS BIGINT) AS max_tokens FROM faulty GROUP BY vid, grp"""))
def _(spark, sf_dir):
    return Q.polish_tokens(Q.polish_groups(_audit(spark, sf_dir)))


NEW_SQL = "CASE id % 3 WHEN 0 THEN text WHEN 1 THEN en || ' and' ELSE 'I ' || text || '.' END"
ACCEPT_SQL = AUDIT_SQL + f""",
tried AS (SELECT *, trim({NEW_SQL}, {STRIP}) AS new FROM faulty),
after AS (SELECT *, {_faults_sql('new', 'src', 'budget', 'false', 'false', 'narrated')} AS later FROM tried),
kept AS (SELECT vid, id, new FROM after WHERE new <> '' AND new <> en
  AND (CASE WHEN later = '' THEN 0 ELSE len(string_split(later, ';')) END) < len(string_split(faults, ';')))
"""


def _repaired(spark, sf_dir):
    audited = Q.audit(V.lines(spark, sf_dir), _narrated(spark, sf_dir), every=True)
    k = F.col("id") % 3
    new = F.when(k == 0, F.col("text")).when(k == 1, F.concat("en", F.lit(" and"))).otherwise(F.concat(F.lit("I "), "text", F.lit(".")))
    fixes = V.lines(spark, sf_dir).select("vid", "id", F.explode(F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("~ an earlier rewrite").alias("new")), F.struct(F.lit(1).alias("seq"), new.alias("new")))).alias("f"))
    return Q.accept_repairs(audited, None, fixes.select("vid", "id", "f.*"))


@query("q15_accept_repairs", V.with_lines(ACCEPT_SQL + """SELECT l.vid, l.id, coalesce(k.new, l.en) AS en, k.new IS NOT NULL AS fixed
  FROM lines l LEFT JOIN kept k ON l.vid = k.vid AND l.id = k.id"""))
def _(spark, sf_dir):
    return _repaired(spark, sf_dir).select("vid", "id", "en", "fixed")


@query("q16_polish_stats", V.with_lines(ACCEPT_SQL + """SELECT f.vid, count(*) AS checked, count(k.id) AS fixed
  FROM faulty f LEFT JOIN kept k ON f.vid = k.vid AND f.id = k.id GROUP BY f.vid"""))
def _(spark, sf_dir):
    return Q.polish_stats(None, _repaired(spark, sf_dir))
