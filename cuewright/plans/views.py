"""Canonical timed-text views over the given tables, and the same in DuckDB SQL.

One row of ``documents`` is one video, so its lines are built inside that row
with array functions and only then exploded: no shuffle, no window.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal out a scan that has fewer splits than there are cores.

    A big table has splits enough and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2, *keys) if df.rdd.getNumPartitions() < cores else df


def english(text, position):
    """A deterministic 'translation' with every kind of fault, by position."""
    k = position % 8
    return (F.when(k == 0, F.lit(""))
            .when(k == 1, F.substring(text, 1, 10))
            .when(k == 2, F.concat(text, F.lit(" and")))
            .when(k == 3, F.concat(F.lit('"'), text))
            .when(k == 4, F.concat(F.lit("You said "), text))
            .when(k == 5, F.concat(text, F.lit('."')))
            .when(k == 6, F.concat(F.lit("his wives "), text))
            .otherwise(F.concat(text, F.lit("."))))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vid, lang, id, start_ms, end_ms, text, en, total_ms. A document without a piece has no lines."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vid"), "lang", "text"), "vid")
    pieces = F.filter(F.transform(F.split("text", r"\. "), lambda p: F.trim(p)), lambda p: p != "")
    seen = F.struct(F.lit(0).cast("bigint").alias("cum"),
                    F.array().cast("array<bigint>").alias("ends"))
    ends = F.aggregate(
        "pieces", seen,
        lambda acc, p: F.struct((acc["cum"] + F.length(p)).alias("cum"),
                                F.concat(acc["ends"], F.array(acc["cum"] + F.length(p))).alias("ends")),
        lambda acc: acc["ends"])
    rows = docs.select("vid", "lang", pieces.alias("pieces")) \
        .select("vid", "lang", F.explode(F.arrays_zip(
            "pieces", ends.alias("cum"), F.transform("pieces", lambda _, i: i).alias("id"),
            F.array_repeat(F.aggregate("pieces", F.lit(0), lambda a, p: a + F.length(p)),
                           F.size("pieces")).alias("chars"))).alias("r"))
    r = F.col("r")
    rid = r["id"].cast("bigint")
    return rows.select(
        "vid", "lang", rid.alias("id"),
        ((r["cum"] - F.length(r["pieces"])) * 66).cast("bigint").alias("start_ms"),
        (r["cum"] * 66 - F.when(rid % 5 == 0, 500).otherwise(0)).cast("bigint").alias("end_ms"),
        r["pieces"].alias("text"), english(r["pieces"], rid).alias("en"),
        (r["chars"] * 66).cast("bigint").alias("total_ms"))


LINES_SQL = """
s AS (SELECT doc_id AS vid, lang, unnest(string_split(text, '. ')) AS p,
             unnest(range(len(string_split(text, '. ')))) AS pos FROM documents),
n AS (SELECT vid, lang, CAST(row_number() OVER (PARTITION BY vid ORDER BY pos) - 1 AS BIGINT) AS id,
             trim(p) AS text, CAST(length(trim(p)) AS BIGINT) AS n FROM s WHERE length(trim(p)) > 0),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY vid ORDER BY id) AS BIGINT) AS cum,
             CAST(sum(n) OVER (PARTITION BY vid) AS BIGINT) AS chars FROM n),
lines AS MATERIALIZED (SELECT vid, lang, id, (cum - n) * 66 AS start_ms,
       cum * 66 - CASE WHEN id % 5 = 0 THEN 500 ELSE 0 END AS end_ms, text,
       CASE id % 8 WHEN 0 THEN '' WHEN 1 THEN substr(text, 1, 10) WHEN 2 THEN text || ' and'
            WHEN 3 THEN '"' || text WHEN 4 THEN 'You said ' || text WHEN 5 THEN text || '."'
            WHEN 6 THEN 'his wives ' || text ELSE text || '.' END AS en,
       chars * 66 AS total_ms FROM c)
"""


def with_lines(sql: str, recursive: bool = False) -> str:
    """A DuckDB statement that starts from the ``lines`` view."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{LINES_SQL.strip()},\n{sql.strip()}" \
        if not sql.lstrip().upper().startswith("SELECT") else \
        f"WITH {LINES_SQL.strip()}\n{sql.strip()}"


# ---- raw recogniser output ------------------------------------------------------
def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the recogniser returns them: chunk-relative, lead-in heard twice."""
    base = lines(spark, sf_dir)
    chunk = F.floor(F.col("start_ms") / 900_000).cast("bigint")
    nxt = F.when(F.col("start_ms") >= (chunk + 1) * 900_000 - 2_500, chunk + 1)
    heard = base.withColumn("chunk", F.explode(F.array_compact(F.array(chunk, nxt))))
    lead = F.when(F.col("chunk") > 0, 2_500).otherwise(0).cast("bigint")
    offset = F.col("chunk") * 900_000 - lead
    return heard.select(
        "vid", "chunk", (F.col("chunk") * 900_000).alias("chunk_ms"), lead.alias("lead_ms"),
        F.col("id").alias("seq"), (F.col("start_ms") - offset).alias("rel_start_ms"),
        (F.col("end_ms") - offset).alias("rel_end_ms"), "text", "lang",
        F.col("total_ms").alias("duration_ms"))


RAW_SQL = """
heard AS (SELECT *, CAST(floor(start_ms / 900000.0) AS BIGINT) AS chunk FROM lines
  UNION ALL SELECT * FROM (SELECT *, CAST(floor(start_ms / 900000.0) AS BIGINT) + 1 AS chunk FROM lines)
  WHERE start_ms >= chunk * 900000 - 2500),
raw AS (SELECT vid, chunk, chunk * 900000 AS chunk_ms, CASE WHEN chunk > 0 THEN 2500 ELSE 0 END AS lead_ms,
  id AS seq, start_ms - (chunk * 900000 - CASE WHEN chunk > 0 THEN 2500 ELSE 0 END) AS rel_start_ms,
  end_ms - (chunk * 900000 - CASE WHEN chunk > 0 THEN 2500 ELSE 0 END) AS rel_end_ms, text, lang,
  total_ms AS duration_ms FROM heard)
"""


# ---- renders ------------------------------------------------------------------------
def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural spoken length of every non-blank line: 60 ms a character."""
    return lines(spark, sf_dir).where(F.trim("en") != "").select(
        "vid", "id", (F.length("en") * 60).cast("bigint").alias("natural_ms"))


# ---- relational views -----------------------------------------------------------------
def epoch_s(col):
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return (F.datediff(F.to_date(col), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400
            + F.hour(col) * 3_600 + F.minute(col) * 60 + F.second(col)).cast("bigint")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ready") \
        .when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 2 == 0, "processing").otherwise("downloading")) \
        .otherwise(F.when(F.col("o_orderkey") % 3 == 0, "queued").when(F.col("o_orderkey") % 3 == 1, "failed")
                   .otherwise("downloaded"))
    return o.select(
        F.col("o_orderkey").alias("vid"), F.concat(F.lit("Video "), F.col("o_orderpriority"), F.lit(" "),
                                                  F.col("o_orderkey").cast("string")).alias("title"),
        status.alias("status"), epoch_s(F.col("o_orderdate")).alias("created_at"),
        F.floor(F.col("o_totalprice") / 100).cast("bigint").alias("duration_s"),
        F.col("o_custkey").alias("viewer"))


VIDEOS_SQL = """
videos AS (SELECT o_orderkey AS vid, 'Video ' || o_orderpriority || ' ' || o_orderkey AS title,
  CASE o_orderstatus WHEN 'F' THEN 'ready'
    WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'processing' ELSE 'downloading' END
    ELSE CASE o_orderkey % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'failed' ELSE 'downloaded' END END AS status,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at, CAST(floor(o_totalprice / 100) AS BIGINT) AS duration_s,
  o_custkey AS viewer FROM orders)
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log: three keys, five models, errors become refusals."""
    e = table(spark, sf_dir, "events")
    kind, v = F.col("event_type"), F.col("value")
    status = F.when(kind == "error", F.when(F.col("event_id") % 5 == 0, 413).when(F.col("event_id") % 5 == 1, 503)
                    .when(F.col("event_id") % 5 == 2, 400).otherwise(429)).otherwise(200)
    tokens = F.floor(v * 10).cast("bigint")
    secs = F.floor(v).cast("bigint")
    message = F.when(kind != "error", "").when(
        F.col("event_id") % 10 == 3,
        F.concat(F.lit("rate limit on tokens per day (TPD). Please try again in "), (secs % 60).cast("string"),
                 F.lit("m"), (secs % 50).cast("string"), F.lit(".5s."))) \
        .when(F.col("event_id") % 5 >= 3, F.concat(F.lit("on tokens per minute (TPM). Please try again in "),
                                                 (secs % 60).cast("string"), F.lit(".25s."))).otherwise("refused")
    return e.select(
        "event_id", epoch_s(F.col("ts")).alias("ts_s"), (F.col("user_id") % 3).alias("key_id"),
        kind.alias("model"), status.cast("bigint").alias("http_status"), tokens.alias("total_tokens"),
        (F.lit(8000).cast("bigint") - tokens % 8000).alias("remaining"),
        F.concat((secs % 3).cast("string"), F.lit("m"), (secs % 60).cast("string"), F.lit(".5s")).alias("reset_after"),
        message.alias("message"), (F.element_at(F.array(F.lit(1), F.lit(3), F.lit(6)),
                                               (F.col("event_id") % 3 + 1).cast("int"))).cast("bigint").alias("streams"))


REQUESTS_SQL = """
requests AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, user_id % 3 AS key_id, event_type AS model,
  CAST(CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 413 WHEN 1 THEN 503 WHEN 2 THEN 400 ELSE 429 END
       ELSE 200 END AS BIGINT) AS http_status,
  CAST(floor(value * 10) AS BIGINT) AS total_tokens, 8000 - CAST(floor(value * 10) AS BIGINT) % 8000 AS remaining,
  (CAST(floor(value) AS BIGINT) % 3) || 'm' || (CAST(floor(value) AS BIGINT) % 60) || '.5s' AS reset_after,
  CASE WHEN event_type <> 'error' THEN ''
    WHEN event_id % 10 = 3 THEN 'rate limit on tokens per day (TPD). Please try again in '
      || (CAST(floor(value) AS BIGINT) % 60) || 'm' || (CAST(floor(value) AS BIGINT) % 50) || '.5s.'
    WHEN event_id % 5 >= 3 THEN 'on tokens per minute (TPM). Please try again in '
      || (CAST(floor(value) AS BIGINT) % 60) || '.25s.' ELSE 'refused' END AS message,
  CAST(CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 6 END AS BIGINT) AS streams FROM events)
"""
