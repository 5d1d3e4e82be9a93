"""Batching, reply and cast queries over the given tables, with their DuckDB counterparts."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..operators import batching as B
from ..operators import cast as C
from ..operators import replies as R
from ..session import settle, shared_folder
from . import views as V
from .registry import query

WS = K.WHITESPACE_CLASS
STRIP = "'" + K.WHITESPACE + "'"
BUDGET = "greatest(12, CAST(floor(greatest(400, end_ms - start_ms) * 15 / 1000.0) AS BIGINT))"
REPLY = "CAST(floor(greatest(300.0::DOUBLE, least(2600.0::DOUBLE, ({b} / 3.2::DOUBLE + {n} * 5 + 60) * 2.0))) AS BIGINT)"

BATCH_SQL = f"""
grid AS (SELECT *, id // 30 AS batch, {BUDGET} AS budget, count(*) OVER (PARTITION BY vid) AS total FROM lines),
ctx AS (SELECT *, coalesce(string_agg(text, ' / ') OVER (PARTITION BY vid ORDER BY id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(text, ' / ') OVER (PARTITION BY vid ORDER BY id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after FROM grid),
pay AS (SELECT vid, batch, CASE WHEN min_by(before, id) = '' THEN '' ELSE '# preceding context (do not translate): ' || min_by(before, id) || chr(10) END
  || string_agg(id || '|' || budget || '|' || text, chr(10) ORDER BY id)
  || CASE WHEN max_by(after, id) = '' THEN '' ELSE chr(10) || '# following context (do not translate): ' || max_by(after, id) END AS payload,
  sum(budget) AS chars, count(*) AS n FROM ctx GROUP BY vid, batch)
"""


def sql(tail, head=BATCH_SQL, recursive=False):
    return V.with_lines(head + tail, recursive)


@query("b01_budget_chars", sql("SELECT vid, id, budget FROM grid"))
def _(spark, sf_dir):
    return V.lines(spark, sf_dir).select("vid", "id", B.budget().alias("budget"))


def tokens_sql(t):
    cjk = f"len(regexp_extract_all({t}, '[{K.CJK_CLASS}]'))"
    return f"{cjk} + (length({t}) - {cjk}) // 3 + 8"




@query("b02_estimate_tokens", sql(f"SELECT vid, id, CAST({tokens_sql('text')} AS BIGINT) AS tokens FROM grid"))
def _(spark, sf_dir):
    return V.lines(spark, sf_dir).select("vid", "id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("b03_max_tokens", sql(f"SELECT vid, batch, {REPLY.format(b='chars', n='n')} AS max_tokens FROM pay"))
def _(spark, sf_dir):
    return B.batch_tokens(V.lines(spark, sf_dir))


@query("b04_projected_cost", sql(f"SELECT vid, batch, CAST(1900 + {tokens_sql('payload')} + 2 * {REPLY.format(b='chars', n='n')} AS BIGINT) AS cost FROM pay"))
def _(spark, sf_dir):
    return B.projected_cost(V.lines(spark, sf_dir), 1900, True)


WINDOW_NO = "CASE WHEN start_ms < 45000 THEN 0 WHEN start_ms < 135000 THEN 1 WHEN start_ms < 315000 THEN 2 ELSE 3 + (start_ms - 315000) // 300000 END"


@query("b05_batch_grid", sql(f"""SELECT vid, w AS window_no, min(id) // 30 * 30 AS lo, least(max(total), (max(id) + 1 + 29) // 30 * 30) AS hi
  FROM (SELECT *, {WINDOW_NO} AS w FROM grid) GROUP BY vid, w"""))
def _(spark, sf_dir):
    from ..streaming.windows import window_no
    ln = V.lines(spark, sf_dir)
    n = ln.groupBy("vid").agg(F.count("*").alias("total"))
    spans = ln.groupBy("vid", window_no(F.col("start_ms")).alias("window_no")).agg(F.min("id").alias("l"), (F.max("id") + 1).alias("h"))
    lo, hi = B.snap_window(F.col("l"), F.col("h"), F.col("total"))
    return spans.join(n, "vid").select("vid", "window_no", lo.alias("lo"), hi.alias("hi"))


@query("b06_pending_batches", sql(f"""SELECT vid, batch, count(*) FILTER (WHERE trim(en, {STRIP}) = '') AS blank, min(id) AS lo, max(id) + 1 AS hi
  FROM (SELECT * REPLACE (CASE WHEN vid % 3 = 0 AND trim(en, {STRIP}) = '' THEN 'done' ELSE en END AS en) FROM grid) GROUP BY vid, batch HAVING count(*) FILTER (WHERE trim(en, {STRIP}) = '') > 0"""))
def _(spark, sf_dir):
    return B.pending_batches(V.lines(spark, sf_dir).withColumn(
        "en", F.when((F.col("vid") % 3 == 0) & B.blank(F.col("en")), "done").otherwise(F.col("en"))))


@query("b07_context_lines", sql("SELECT vid, id, before, after FROM ctx"))
def _(spark, sf_dir):
    return B.context_lines(V.lines(spark, sf_dir)).select("vid", "id", "before", "after")


@query("b08_payload", sql("SELECT vid, batch, payload FROM pay"))
def _(spark, sf_dir):
    return B.payload(V.lines(spark, sf_dir)).select("vid", "batch", "payload")


FIT_SQL = BATCH_SQL + f""",
cum AS MATERIALIZED (SELECT vid, id, batch, sum(length(id || '|' || budget || '|' || text) + 1) OVER w AS pn, sum(budget) OVER w AS pb,
  length(id || '|' || budget || '|' || text) + 1 AS cn, budget AS cb,
  CASE WHEN before = '' THEN 0 ELSE length(before) + 41 END AS bn, CASE WHEN after = '' THEN 0 ELSE length(after) + 41 END AS an
  FROM ctx WINDOW w AS (PARTITION BY vid ORDER BY id)),
piece AS (SELECT vid, min(id) AS lo, max(id) + 1 AS hi, 0 AS depth FROM cum GROUP BY vid, batch
  UNION ALL SELECT vid, CASE WHEN side = 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN side = 0 THEN lo + (hi - lo) // 2 ELSE hi END, depth + 1
  FROM (SELECT p.*, 2700 + 8 + ((b.pn - a.pn + a.cn - 1) + a.bn + b.an) // 3 + {REPLY.format(b='(b.pb - a.pb + a.cb)', n='(p.hi - p.lo)')} AS cost, unnest([0, 1]) AS side
    FROM piece p JOIN cum a ON a.vid = p.vid AND a.id = p.lo JOIN cum b ON b.vid = p.vid AND b.id = p.hi - 1) WHERE cost > 3600 AND hi - lo > 1),
costed AS (SELECT p.*, CAST(2700 + 8 + ((b.pn - a.pn + a.cn - 1) + a.bn + b.an) // 3 + {REPLY.format(b='(b.pb - a.pb + a.cb)', n='(p.hi - p.lo)')} AS BIGINT) AS cost
    FROM piece p JOIN cum a ON a.vid = p.vid AND a.id = p.lo JOIN cum b ON b.vid = p.vid AND b.id = p.hi - 1)
"""


@query("b09_fit_batches", V.with_lines(FIT_SQL + "SELECT vid, lo, hi, cost FROM costed WHERE cost <= 3600 OR hi - lo = 1", True))
def _(spark, sf_dir):
    return B.fit_batches(V.lines(spark, sf_dir), 2700, 3600)


@query("b09_fit_pending", V.with_lines(FIT_SQL + """SELECT vid, lo, hi, cost FROM costed WHERE (cost <= 3600 OR hi - lo = 1)
  AND (vid, lo // 30) IN (SELECT (vid, id // 30) FROM lines WHERE id % 97 = 5)""", True))
def _(spark, sf_dir):
    ln = V.lines(spark, sf_dir)
    return B.fit_batches(ln, 2700, 3600, B.batch_grid(ln.where("id % 97 = 5")).select("vid", "batch"))


ASSIGN_SQL = BATCH_SQL + """,
bat AS (SELECT DISTINCT vid, batch FROM grid),
asg AS (SELECT vid, batch, CAST(batch % 6 // 2 AS BIGINT) AS key_id, CASE batch % 2 WHEN 0 THEN 'click' ELSE 'error' END AS model FROM bat)
"""


def _batches(spark, sf_dir):
    return B.batch_grid(V.lines(spark, sf_dir)).select("vid", "batch").distinct()


def _assigned(spark, sf_dir):
    return B.assign_buckets(_batches(spark, sf_dir), [0, 1, 2], ["click", "error"]).withColumn("key_id", F.col("key_id").cast("bigint"))


@query("b10_assign_buckets", sql("SELECT vid, batch, key_id, model FROM asg", ASSIGN_SQL))
def _(spark, sf_dir):
    return _assigned(spark, sf_dir)


def _answers(spark, sf_dir):
    """Answers to every line but each eleventh; every eighth is blank already. Each reply also has a stray id of the next batch."""
    told = B.batch_grid(V.lines(spark, sf_dir)).select("vid", "batch", "id", "en")
    stray = told.where("id % 30 = 0 AND batch > 0").select("vid", (F.col("batch") - 1).alias("batch"), "id", F.lit("stray").alias("en"))
    return told.where("id % 11 <> 0").unionByName(stray)


@query("b11_missing_lines", sql("SELECT vid, id FROM grid WHERE id % 11 = 0"))
def _(spark, sf_dir):
    return B.missing_lines(V.lines(spark, sf_dir), _answers(spark, sf_dir)).select("vid", "id")


@query("b12_blank_real_lines", sql(f""",bad AS (SELECT *, (id % 11 = 0 OR trim(en, {STRIP}) = '') AND length(trim(text, {STRIP})) >= 8 AS b FROM grid)
SELECT vid, id, batch FROM (SELECT *, count(*) FILTER (WHERE b) OVER (PARTITION BY vid, batch) AS nb, count(*) OVER (PARTITION BY vid, batch) AS n FROM bad)
WHERE b AND nb < n"""))
def _(spark, sf_dir):
    return B.blank_real_lines(V.lines(spark, sf_dir), _answers(spark, sf_dir))


@query("b13_sample_spread", sql(f""",sp AS (SELECT vid, trim(text, {STRIP}) AS t, row_number() OVER (PARTITION BY vid ORDER BY id) - 1 AS k,
  count(*) OVER (PARTITION BY vid) AS n FROM lines WHERE trim(text, {STRIP}) <> ''),
pk AS (SELECT vid, n, m, i, least(n - 1, CAST(floor(i * (n::DOUBLE / m)) AS BIGINT)) AS k FROM
  (SELECT vid, n, m, unnest(range(m)) AS i FROM (SELECT DISTINCT vid, n, least(110, n) AS m FROM sp)))
SELECT pk.vid, string_agg(substr(t, 1, greatest(24, 3200 // m)), chr(10) ORDER BY i) AS sample FROM pk JOIN sp ON pk.vid = sp.vid AND pk.k = sp.k GROUP BY pk.vid"""))
def _(spark, sf_dir):
    return B.sample_spread(V.lines(spark, sf_dir))


@query("b14_opening", sql("SELECT vid, string_agg(text, ' / ' ORDER BY id) AS opening FROM lines WHERE abs(id) < 55 GROUP BY vid"))
def _(spark, sf_dir):
    return B.opening(V.lines(spark, sf_dir))


@query("b15_translate_progress", sql(f"SELECT vid, 45 + count(*) FILTER (WHERE trim(en, {STRIP}) <> '') * 25 // count(*) AS progress FROM lines GROUP BY vid"))
def _(spark, sf_dir):
    return B.translate_progress(V.lines(spark, sf_dir))


KIND = """CASE WHEN http_status < 400 THEN NULL WHEN http_status = 413 THEN 'too_large' WHEN http_status = 429 AND contains(lower(message), 'per day') THEN 'exhausted'
  WHEN http_status IN (429, 502, 503) THEN 'transient' ELSE 'fatal' END"""


@query("b16_classify_refusal", f"WITH {V.REQUESTS_SQL} SELECT event_id, {KIND} AS refusal FROM requests")
def _(spark, sf_dir):
    return V.requests(spark, sf_dir).select("event_id", B.classify_refusal(F.col("http_status"), F.col("message")).alias("refusal"))


RESET = r"""coalesce(TRY_CAST(regexp_extract(reset_after, '^(?:(\d+)m)?([\d.]+)?s?', 1) AS DOUBLE), 0) * 60
  + coalesce(TRY_CAST(regexp_extract(reset_after, '^(?:(\d+)m)?([\d.]+)?s?', 2) AS DOUBLE), 0)"""
HINT = r"""CASE WHEN regexp_matches(message, 'try again in [\dhms.]+') THEN 'resets in ' || regexp_replace(regexp_extract(message, 'try again in ([\dhms.]+)', 1), '\.+$', '')
  ELSE 'resets later today' END"""


@query("b17_parse_reset", f"WITH {V.REQUESTS_SQL} SELECT event_id, CAST(floor(({RESET}) * 1000 + 0.5) AS BIGINT) AS reset_ms, {HINT} AS hint FROM requests")
def _(spark, sf_dir):
    return V.requests(spark, sf_dir).select("event_id", X.half_up(X.parse_seconds(F.col("reset_after")) * 1000).alias("reset_ms"),
                                           X.reset_hint(F.col("message")).alias("hint"))


STATE_SQL = f"""
st AS (SELECT key_id, model, arg_max(remaining, ts_s * 10000000 + event_id) FILTER (WHERE http_status < 400) AS remaining,
  CAST(floor(arg_max(ts_s + {RESET}, ts_s * 10000000 + event_id) FILTER (WHERE http_status < 400)) AS BIGINT) AS reset_at_s,
  arg_max({HINT}, ts_s * 10000000 + event_id) FILTER (WHERE {KIND} = 'exhausted' AND ts_s // 86400 = day) AS exhausted
  FROM (SELECT *, max(ts_s // 86400) OVER (PARTITION BY key_id, model) AS day FROM requests) GROUP BY key_id, model)"""


@query("b18_bucket_state", f"WITH {V.REQUESTS_SQL}, {STATE_SQL} SELECT * FROM st")
def _(spark, sf_dir):
    return B.bucket_state(V.requests(spark, sf_dir)).withColumn("reset_at_s", F.floor("reset_at_s").cast("bigint"))


@query("b18_bucket_state_stream", f"WITH {V.REQUESTS_SQL}, {STATE_SQL} SELECT * FROM st")
def _(spark, sf_dir):
    from ..streaming.buckets import bucket_state_table
    base = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    r = V.requests(spark, sf_dir)
    r.repartition(4, F.xxhash64("event_id")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return bucket_state_table(stream, base).withColumn("reset_at_s", F.floor("reset_at_s").cast("bigint"))


@query("b18_budget", f"""WITH {V.REQUESTS_SQL}, {STATE_SQL},
lim AS (SELECT key_id, model, arg_max(lim, ts_s * 10000000 + event_id) FILTER (WHERE http_status < 400 AND lim IS NOT NULL) AS lim,
  max(ts_s) FILTER (WHERE http_status < 400) AS seen, max(ts_s // 86400) AS day
  FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 6000 + 1000 * key_id END AS lim FROM requests) GROUP BY key_id, model)
SELECT st.key_id, st.model, remaining, reset_at_s, CASE WHEN (reset_at_s - 30) // 86400 > day THEN NULL ELSE exhausted END AS exhausted,
  lim AS "limit", coalesce(lim, 8000) AS headroom, CASE WHEN lim > 0
  THEN least(lim, remaining + CAST(floor(lim * greatest(reset_at_s - 30 - seen, 0) / 60.0) AS BIGINT)) ELSE remaining END AS level,
  CAST(CASE WHEN remaining IS NULL OR remaining >= 5000 THEN 0 ELSE 30 END AS BIGINT) AS wait_s
FROM st JOIN lim ON st.key_id = lim.key_id AND st.model = lim.model""")
def _(spark, sf_dir):
    """Every bucket half a minute before its own reset, for a request of 5,000 tokens."""
    now = F.floor("reset_at_s").cast("bigint") - 30
    log = V.requests(spark, sf_dir).withColumn("limit", F.when(F.col("event_id") % 3 == 0, 6000 + 1000 * F.col("key_id")))
    state = B.bucket_state(log, now_s=now).withColumn("reset_at_s", F.floor("reset_at_s").cast("bigint"))
    return state.withColumn("headroom", F.col("headroom").cast("bigint")).withColumn("wait_s", B.would_wait(F.lit(5000), now).cast("bigint"))


@query("b19_reassign", V.with_lines(ASSIGN_SQL + f", {V.REQUESTS_SQL}, {STATE_SQL}," + """
live AS (SELECT key_id, model, row_number() OVER (ORDER BY key_id, model) - 1 AS k, count(*) OVER () AS n FROM st WHERE exhausted IS NULL),
dead AS (SELECT * FROM st WHERE exhausted IS NOT NULL)
SELECT a.vid, a.batch, CASE WHEN d.key_id IS NULL THEN a.key_id ELSE l.key_id END AS key_id, CASE WHEN d.key_id IS NULL THEN a.model ELSE l.model END AS model, d.key_id IS NOT NULL AS moved
FROM asg a LEFT JOIN dead d ON a.key_id = d.key_id AND a.model = d.model LEFT JOIN live l ON l.k = a.batch % l.n"""))
def _(spark, sf_dir):
    return B.reassign(_assigned(spark, sf_dir), B.bucket_state(V.requests(spark, sf_dir)))


# ---- replies --------------------------------------------------------------------------
def _replies(spark, sf_dir):
    """Answers per batch: bullets, echoed budgets, thinking, JSON, and a few that are only prose."""
    ln = B.batch_grid(V.lines(spark, sf_dir)).where("id % 13 <> 5")
    en = F.regexp_replace("en", r"[\"\n]", " ")
    row = F.when(F.col("id") % 7 == 1, F.concat(F.lit(" - "), F.col("id").cast("string"), F.lit(" | "), en)) \
        .when(F.col("id") % 7 == 2, F.concat(F.col("id").cast("string"), F.lit("|42| "), en)) \
        .when(F.col("id") % 7 == 3, F.concat(F.col("id").cast("string"), F.lit('|"'), en, F.lit('"\n'), F.col("id").cast("string"), F.lit("|again "), en)) \
        .otherwise(F.concat(F.col("id").cast("string"), F.lit("|"), en))
    got = ln.groupBy("vid", "batch").agg(
        B.ordered_text("id", row, "\n").alias("rows"),
        F.sort_array(F.collect_list(X.rec(id=F.col("id"), en=en))).alias("items"))
    kind = (F.col("vid") + F.col("batch")) % 10
    content = F.when(kind == 7, F.to_json(X.rec(lines=F.col("items")))).when(kind == 8, F.lit("I cannot help with that | sorry")) \
        .when(kind == 9, F.concat(F.lit("<think>1|no\n2|no</think>\nHere:\n"), F.col("rows"))).otherwise(F.col("rows"))
    return got.select("vid", "batch", content.alias("content"))


LINE_BREAK = K.LINE_BREAK
REPLY_SQL = BATCH_SQL + f"""
,src AS (SELECT vid, batch, id, regexp_replace(en, '["\\n]', ' ', 'g') AS en FROM grid WHERE id % 13 <> 5),
rw AS (SELECT vid, batch, string_agg(CASE id % 7 WHEN 1 THEN ' - ' || id || ' | ' || en WHEN 2 THEN id || '|42| ' || en
    WHEN 3 THEN id || '|"' || en || '"' || chr(10) || id || '|again ' || en ELSE id || '|' || en END, chr(10) ORDER BY id) AS rows,
  to_json(list({{'id': id, 'en': en}} ORDER BY id)) AS items FROM src GROUP BY vid, batch),
rep AS (SELECT vid, batch, (vid + batch) % 10 AS kind, CASE (vid + batch) % 10 WHEN 7 THEN '{{"lines":' || items || '}}' WHEN 8 THEN 'I cannot help with that | sorry'
    WHEN 9 THEN '<think>1|no' || chr(10) || '2|no</think>' || chr(10) || 'Here:' || chr(10) || rows ELSE rows END AS content FROM rw),
raw0 AS (SELECT vid, batch, kind, unnest(string_split(c, chr(10))) AS l, unnest(range(len(string_split(c, chr(10))))) AS pos
   FROM (SELECT *, trim(regexp_replace(content, '(?s)<think>.*?</think>', '', 'g'), {STRIP}) AS c FROM rep)),
trimmed AS (SELECT vid, batch, kind, pos, trim(ltrim(trim(l, {STRIP}), '-*• '), {STRIP}) AS l, l AS whole FROM raw0),
hit AS (SELECT vid, batch, pos, CAST(regexp_extract(l, '^(\\d{{1,7}})[{WS}]*\\|[{WS}]*(.*)$', 1) AS BIGINT) AS id,
   trim(trim(regexp_extract(l, '^(\\d{{1,7}})[{WS}]*\\|[{WS}]*(.*)$', 2), {STRIP}), '"') AS t FROM trimmed WHERE regexp_matches(l, '^\\d{{1,7}}[{WS}]*\\|')),
fixd AS (SELECT vid, batch, pos, id, CASE WHEN regexp_matches(t, '^\\d{{1,5}}[{WS}]*\\|') THEN trim(regexp_replace(t, '^\\d{{1,5}}[{WS}]*\\|', ''), {STRIP}) ELSE t END AS en FROM hit),
js AS (SELECT vid, batch, 0 AS pos, id, trim(en, {STRIP}) AS en FROM src WHERE (vid + batch) % 10 = 7),
parsed AS (SELECT vid, batch, id, max_by(en, pos) AS en FROM (SELECT * FROM fixd UNION ALL SELECT vid, batch, pos, id, en FROM js) GROUP BY vid, batch, id)
"""


@query("r01_strip_think", sql(f"SELECT vid, batch, trim(regexp_replace(content, '(?s)<think>.*?</think>', '', 'g'), {STRIP}) AS content FROM rep", REPLY_SQL))
def _(spark, sf_dir):
    return _replies(spark, sf_dir).select("vid", "batch", X.strip_think(F.col("content")).alias("content"))


@query("r02_parse_reply", sql("SELECT vid, batch, id, en FROM parsed", REPLY_SQL))
def _(spark, sf_dir):
    return R.parse_reply(_replies(spark, sf_dir))


@query("r03_echoed_budget", sql("SELECT vid, batch, id, en FROM fixd", REPLY_SQL))
def _(spark, sf_dir):
    return R.reply_rows(_replies(spark, sf_dir)).select("vid", "batch", "id", "en")


@query("r04_json_reply", sql("SELECT vid, batch, id, en FROM js", REPLY_SQL))
def _(spark, sf_dir):
    return R.parse_reply(_replies(spark, sf_dir).where("content LIKE '{%'"))


@query("r05_rejects", sql("SELECT vid, batch, content FROM rep WHERE (vid, batch) NOT IN (SELECT (vid, batch) FROM parsed)", REPLY_SQL))
def _(spark, sf_dir):
    return R.rejects(_replies(spark, sf_dir))


REPAIR_ROW = f"regexp_extract(whole, '^[{WS}]*[-*• ]*(\\d{{1,7}})[{WS}]*\\|(.*)$', 2)"


@query("r06_parse_repair", sql(f"""SELECT vid, batch, id, max_by(t, pos) AS new FROM (SELECT vid, batch, pos,
  CAST(regexp_extract(whole, '^[{WS}]*[-*• ]*(\\d{{1,7}})[{WS}]*\\|(.*)$', 1) AS BIGINT) AS id,
  trim(trim(list_extract(string_split({REPAIR_ROW}, '|'), -1), {STRIP}), '"') AS t
  FROM trimmed WHERE regexp_matches(whole, '^[{WS}]*[-*• ]*\\d{{1,7}}[{WS}]*\\|')) WHERE t <> '' GROUP BY vid, batch, id""", REPLY_SQL))
def _(spark, sf_dir):
    return R.parse_repair(_replies(spark, sf_dir))


@query("r07_apply_reply", sql(f"""SELECT l.vid, l.id, CASE WHEN a.batch IS NULL THEN l.en ELSE coalesce(trim(p.en, {STRIP}), '') END AS en FROM grid l
  LEFT JOIN (SELECT DISTINCT vid, batch FROM parsed) a ON l.vid = a.vid AND l.batch = a.batch LEFT JOIN parsed p ON p.vid = l.vid AND p.batch = l.batch AND p.id = l.id""", REPLY_SQL))
def _(spark, sf_dir):
    parsed = settle(R.parse_reply(_replies(spark, sf_dir)))  # read four times below
    stray = parsed.where("id % 30 = 1").select("vid", (F.col("batch") + 1).alias("batch"), "id", F.lit("stray").alias("en"))
    parsed = parsed.unionByName(stray.join(parsed.select("vid", "batch").distinct(), ["vid", "batch"], "left_semi"))
    return R.apply_reply(V.lines(spark, sf_dir), parsed, parsed.select("vid", "batch").distinct()).select("vid", "id", "en")


@query("r08_apply_edits", sql(f"""SELECT vid, id, CASE WHEN id % 4 = 1 AND text IS DISTINCT FROM en THEN trim(text, {STRIP}) ELSE en END AS en,
  id % 4 = 1 AND text IS DISTINCT FROM en AS changed FROM lines"""))
def _(spark, sf_dir):
    ln = V.lines(spark, sf_dir)
    return R.apply_edits(ln, ln.where("id % 4 = 1").select("vid", "id", F.col("text").alias("en"))).select("vid", "id", "en", "changed")


@query("r09_reset_translation", sql("SELECT vid, id, '' AS en FROM lines"))
def _(spark, sf_dir):
    return R.reset_translation(V.lines(spark, sf_dir)).select("vid", "id", "en")


@query("r10_line_request", sql("""SELECT vid, id, '{"translate":[{"id":' || id || ',"text":' || to_json(text) || ',"max_chars":' || budget || '}]}' AS request FROM grid"""))
def _(spark, sf_dir):
    return V.lines(spark, sf_dir).select("vid", "id", R.line_request(F.col("id"), F.col("text"), B.budget()).alias("request"))


# ---- cast ---------------------------------------------------------------------------------
def _words():
    """The first three words of a line, the rest of the text is not parted; 'x' where there is none."""
    first = F.filter(F.split("text", f"[{WS}]+", 5), lambda w: w != "")
    at = lambda w, i: F.coalesce(F.get(w, F.lit(i)), F.lit("x"))
    return X.let(first, lambda w: X.rec(a=at(w, 0), b=at(w, 1), c=at(w, 2)))


def _word(n):
    return _words()["abc"[n - 1]]


RELATIONS = ("his sister", "her father", "a reporter", "", "the sect elder's wife and husband")
ENGLISH = ("You", "the elder", "Wife", "Yun Niang", "")


def _nth(values, n):
    """The n-th of some values, from the end below zero; NULL for the 0th, which the remainder of a vid below zero can ask for."""
    n = n.cast("int")
    return F.when(n != 0, F.try_element_at(F.array(*[F.lit(x) for x in values]), n))


def _cast_lines(spark, sf_dir):
    """Every stretch of forty lines, numbered as a video of its own."""
    return V.lines(spark, sf_dir).withColumns({"vid": F.col("vid") * 100_000 + F.floor(F.col("id") / 40).cast("bigint"), "id": F.col("id") % 40})


def _cast_replies(spark, sf_dir):
    """Cast answers, one for every forty lines of a video (see `_cast_lines`)."""
    k, w1, w2, w3 = F.col("id"), F.col("w.a"), F.col("w.b"), F.col("w.c")
    role = F.when(k.isin(1, 5), "mc").when(k == 9, "EXTRA").otherwise("NPC")
    en = F.when(k % 7 == 3, _nth(ENGLISH, F.col("vid") % 5 + 1)) \
        .when(k % 7 == 4, w1).otherwise(w3)
    relation = _nth(RELATIONS, (k + F.col("vid")) % 5 + 1)
    row = F.concat(F.when(k % 4 == 0, "- ").otherwise(""), role, F.lit("|"), w1, F.lit(", "), w2, F.lit(",|"), en,
                   F.when(k % 6 == 2, F.lit("")).otherwise(F.concat(F.lit("|"), F.element_at(F.array(F.lit("f"), F.lit("male"), F.lit("?")), (k % 3 + 1).cast("int")),
                                                                 F.lit("|"), relation)))
    row = F.coalesce(row, F.lit("-"))  # no cast row, but the ones after it keep their numbers
    # Exploding one record parts a line into words once.
    parted = _cast_lines(spark, sf_dir).select("vid", "id", F.explode(F.array(_words())).alias("w"))
    return parted.select("vid", "id", row.alias("row")).groupBy("vid").agg(B.ordered_text("id", F.col("row"), "\n").alias("content"))


def _in(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


W = f"list_filter(regexp_split_to_array(text, '[{WS}]+'), lambda w: w <> '')"
CAST_SQL = f"""
wd AS (SELECT vid, id, coalesce(({W})[1], 'x') AS w1, coalesce(({W})[2], 'x') AS w2, coalesce(({W})[3], 'x') AS w3 FROM (SELECT vid * 100000 + id // 40 AS vid, id % 40 AS id, text FROM lines)),
cr AS (SELECT vid, id, CASE WHEN id % 4 = 0 THEN '- ' ELSE '' END || CASE WHEN id IN (1, 5) THEN 'mc' WHEN id = 9 THEN 'EXTRA' ELSE 'NPC' END
  || '|' || w1 || ', ' || w2 || ',|' || CASE WHEN id % 7 = 3 THEN ([{_in(ENGLISH)}])[vid % 5 + 1] WHEN id % 7 = 4 THEN w1 ELSE w3 END
  || CASE WHEN id % 6 = 2 THEN '' ELSE '|' || (['f', 'male', '?'])[id % 3 + 1] || '|' || ([{_in(RELATIONS)}])[(id + vid) % 5 + 1] END AS l FROM wd),
cl AS (SELECT vid, id AS ord, ltrim(trim(l, {STRIP}), '-*• ') AS l FROM cr),
cf AS (SELECT vid, ord, list_transform(string_split(l, '|'), lambda p: trim(p, {STRIP})) AS f FROM cl WHERE contains(l, '|') AND length(l) <= 200),
cs AS (SELECT vid, ord, upper(f[1]) AS role, list_filter(list_transform(string_split(f[2], ','), lambda p: trim(p, {STRIP})), lambda p: p <> '') AS names,
  f[3] AS en, coalesce(f[4], '') AS said, coalesce(f[5], '') AS relation FROM cf WHERE len(f) >= 3 AND upper(f[1]) IN ('MC', 'NPC')),
flags AS (SELECT *, trim(trim(names[1], {STRIP}), '的') IN ({_in(K.PRONOUNS_SOURCE)}) OR lower(trim(en, {STRIP})) IN ({_in(K.PRONOUNS_ENGLISH)}) AS pronoun,
  trim(lower(trim(en, {STRIP})), '.,') IN ('', {_in(K.GENERIC_NAMES)}) OR ltrim(trim(lower(trim(en, {STRIP})), '.,'), 'the ') IN ({_in(K.GENERIC_NAMES)})
  OR en = names[1] OR regexp_matches(en, '[{K.SOURCE_SCRIPT_CLASS}]') AS generic FROM cs WHERE len(names) > 0 AND en <> ''),
rel AS (SELECT *, list_has_any(regexp_extract_all(lower(relation), '[a-z]+'), [{_in(K.FEMALE_WORDS)}]) AS fw,
  list_has_any(regexp_extract_all(lower(relation), '[a-z]+'), [{_in(K.MALE_WORDS)}]) AS mw FROM flags WHERE NOT pronoun AND NOT generic),
castt AS (SELECT vid, ord, CASE WHEN ord = min(CASE WHEN role = 'MC' THEN ord END) OVER (PARTITION BY vid) THEN 'MC' ELSE 'NPC' END AS role,
  array_to_string(names[1:6], ', ') AS names, en, CASE WHEN fw AND NOT mw THEN 'f' WHEN mw AND NOT fw THEN 'm'
  WHEN lower(left(said, 1)) IN ('f', 'm') THEN lower(left(said, 1)) ELSE '' END AS sex, substr(relation, 1, 80) AS relation FROM rel)
"""


def _cast(spark, sf_dir):
    return C.parse_cast(_cast_replies(spark, sf_dir))


@query("c01_parse_cast", V.with_lines(CAST_SQL + "SELECT vid, ord, role, names, en, sex, relation FROM castt"))
def _(spark, sf_dir):
    return _cast(spark, sf_dir).withColumn("names", F.array_join("names", ", "))


@query("c02_is_pronoun", V.with_lines(CAST_SQL + f"SELECT vid, id, lower(w1) IN ({_in(K.PRONOUNS_SOURCE)}) OR lower(w2) IN ({_in(K.PRONOUNS_ENGLISH)}) AS pronoun FROM wd"))
def _(spark, sf_dir):
    return _cast_lines(spark, sf_dir).select("vid", "id", C.is_pronoun(F.lower(_word(1)), _word(2)).alias("pronoun"))


@query("c03_is_generic", V.with_lines(CAST_SQL + f"""SELECT vid, id, e IN ('', {_in(K.GENERIC_NAMES)}) OR ltrim(e, 'the ') IN ({_in(K.GENERIC_NAMES)}) OR w = w2 AS generic
  FROM (SELECT *, trim(lower(trim(w, {STRIP})), '.,') AS e FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'The elder' WHEN 1 THEN w1 WHEN 2 THEN 'the Sister.' ELSE w2 END AS w FROM wd))"""))
def _(spark, sf_dir):
    k = F.col("id") % 4
    en = F.when(k == 0, "The elder").when(k == 1, _word(1)).when(k == 2, "the Sister.").otherwise(_word(2))
    return _cast_lines(spark, sf_dir).select("vid", "id", C.is_generic(_word(2), en).alias("generic"))


def _chars_in(t, chars):
    return f"(length({t}) - length(translate({t}, '{chars}', '')))"


NAME_POOL = ("苏婉柔", "江河", "龙峰丽", "强", "宋景年", "李梅兰虎")


@query("c04_gender_from_name", V.with_lines(CAST_SQL + f"""SELECT vid, id, CASE WHEN {_chars_in('n', K.FEMALE_NAME_CHARS)} > {_chars_in('n', K.MALE_NAME_CHARS)} THEN 'f'
  WHEN {_chars_in('n', K.MALE_NAME_CHARS)} > {_chars_in('n', K.FEMALE_NAME_CHARS)} THEN 'm' ELSE '' END AS sex FROM
  (SELECT vid, id, w1 || ([{_in(NAME_POOL)}])[(id * 3 + vid) % 6 + 1] AS n FROM wd)"""))
def _(spark, sf_dir):
    name = _nth(NAME_POOL, (F.col("id") * 3 + F.col("vid")) % 6 + 1)
    return _cast_lines(spark, sf_dir).select("vid", "id", C.gender_from_name(F.array(_word(1), name)).alias("sex"))


@query("c05_settle_gender", V.with_lines(CAST_SQL + "SELECT vid, ord, sex FROM castt"))
def _(spark, sf_dir):
    return _cast(spark, sf_dir).select("vid", "ord", "sex")


@query("c06_pick_lead", V.with_lines(CAST_SQL + "SELECT vid, ord, en FROM castt WHERE role = 'MC'"))
def _(spark, sf_dir):
    return _cast(spark, sf_dir).where("role = 'MC'").select("vid", "ord", "en")


CHART_SQL = CAST_SQL + """
,lead AS (SELECT vid, 'THE MAIN CHARACTER is ' || en || ' - written in the source as ' || names || '. ' || CASE WHEN relation = '' THEN 'the narrator' ELSE relation END
  || '. Narration is "I", "me", "my"; others speak of them as ' || CASE sex WHEN 'f' THEN 'she/her' ELSE 'he/him' END || '.' AS lead FROM castt WHERE role = 'MC'),
rest AS (SELECT vid, chr(10) || 'EVERYONE ELSE:' || chr(10) || string_agg('  ' || names || ' = ' || en || ' (' || CASE sex WHEN 'f' THEN 'female - she/her' WHEN 'm' THEN 'male - he/him' ELSE '?' END || ')'
  || CASE WHEN relation = '' THEN '' ELSE ' - ' || relation END, chr(10) ORDER BY ord) AS rest
  FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY ord) AS k FROM castt WHERE role = 'NPC') WHERE k <= 30 GROUP BY vid),
chart AS (SELECT v.vid, v.lang, concat_ws(chr(10), coalesce(lead, CASE WHEN v.vid % 2 = 0 THEN 'The narrator and main character of this video is never named; every narration line is theirs.' END), rest) AS chart
  FROM (SELECT DISTINCT vid, lang FROM lines) v LEFT JOIN lead ON lead.vid = v.vid LEFT JOIN rest ON rest.vid = v.vid)
"""


def _charts(spark, sf_dir):
    told = V.lines(spark, sf_dir).where("id = 0").select("vid", (F.col("vid") % 2 == 0).alias("narrated"))
    return C.format_cast(_cast(spark, sf_dir), told)


@query("c07_format_cast", V.with_lines(CHART_SQL + "SELECT vid, chart FROM chart"))
def _(spark, sf_dir):
    return _charts(spark, sf_dir)


@query("c08_choose_cast", V.with_lines(CHART_SQL + """SELECT vid, CASE WHEN vid % 3 = 0 THEN 'second: ' ELSE 'first: ' END || chart AS chart FROM chart WHERE vid % 3 = 0 OR chart <> ''"""))
def _(spark, sf_dir):
    charts = _charts(spark, sf_dir)
    first = charts.select("vid", F.lit(0).alias("priority"), F.when((F.col("vid") % 3 == 0) | (F.col("chart") == ""), "").otherwise(F.concat(F.lit("first: "), "chart")).alias("chart"))
    second = charts.where("vid % 3 = 0").select("vid", F.lit(1).alias("priority"), F.concat(F.lit("second: "), "chart").alias("chart"))
    return C.choose_cast(first.unionByName(second))


@query("c09_build_brief", V.with_lines(CHART_SQL + """SELECT vid, concat_ws(chr(10) || chr(10), 'Translate ' || CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German'
  WHEN 'es' THEN 'Spanish' ELSE 'the source language' END || ' into English.', CASE WHEN lang = 'fr' THEN 'ABOUT THIS LANGUAGE. Mind tu and vous.' END,
  CASE WHEN chart <> '' THEN 'CAST LIST.' || chr(10) || chart END) AS brief FROM chart"""))
def _(spark, sf_dir):
    langs = V.lines(spark, sf_dir).where("id = 0").select("vid", "lang")
    return C.build_brief(_charts(spark, sf_dir).join(langs, "vid"), "Translate {language} into English.", {"fr": "Mind tu and vous."})
