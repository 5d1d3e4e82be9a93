"""Reading model replies back into lines."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X

_WS = f"[{K.WHITESPACE_CLASS}]"
_BULLETS = "-*• "


def _unquote(text: Column) -> Column:
    return F.btrim(X.strip(text), F.lit('"'))


def reply_rows(replies: DataFrame) -> DataFrame:
    """(vid, batch, pos, id, en): every row of every reply that has an id and a bar."""
    body = replies.select("vid", "batch", F.posexplode(X.split_lines(X.strip_think(F.col("content")))).alias("pos", "raw"))
    line = X.strip(F.ltrim(X.strip(F.col("raw")), F.lit(_BULLETS)))
    pattern = rf"^(\d{{1,7}}){_WS}*\|{_WS}*(.*)$"
    rows = body.withColumn("_l", line).where(F.col("_l").rlike(pattern))
    text = _unquote(F.regexp_extract("_l", pattern, 2))
    echoed = rf"^\d{{1,5}}{_WS}*\|{_WS}*(.*)$"
    first = F.substring_index(text, "|", 1)
    undone = F.when(text.rlike(echoed) & ~first.rlike("[A-Za-z]"), X.strip(F.regexp_extract(text, echoed, 1))).otherwise(text)
    return rows.select("vid", "batch", F.col("pos").cast("bigint").alias("pos"),
                       F.regexp_extract("_l", pattern, 1).cast("bigint").alias("id"), undone.alias("en"))


def _json_rows(replies: DataFrame) -> DataFrame:
    """Replies that are one JSON object with a list of lines."""
    body = X.strip_think(F.col("content"))
    span = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    shape = "STRUCT<lines: ARRAY<STRUCT<id: STRING, en: STRING>>>"
    return replies.where(F.ltrim(body).startswith("{")).select(
        "vid", "batch", F.posexplode(F.from_json(span, shape)["lines"]).alias("pos", "r")) \
        .select("vid", "batch", F.col("pos").cast("bigint").alias("pos"), F.col("r.id").try_cast("bigint").alias("id"),
                X.strip(F.coalesce("r.en", F.lit(""))).alias("en")).where("id IS NOT NULL")


def parse_reply(replies: DataFrame) -> DataFrame:
    """(vid, batch, id, en): rows first, JSON where a reply has none; the last duplicate wins."""
    rows = reply_rows(replies)
    rest = replies.where(F.ltrim(X.strip_think(F.col("content"))).startswith("{")) \
        .join(rows.select("vid", "batch").distinct(), ["vid", "batch"], "left_anti")
    return rows.unionByName(_json_rows(rest)).groupBy("vid", "batch", "id").agg(F.max_by("en", "pos").alias("en"))


def rejects(replies: DataFrame) -> DataFrame:
    """Replies from which nothing could be read."""
    return replies.join(parse_reply(replies).select("vid", "batch").distinct(), ["vid", "batch"], "left_anti")


def parse_repair(replies: DataFrame) -> DataFrame:
    """Repair rows: the last field is the text, blank ones are skipped, the last duplicate wins."""
    pattern = rf"^{_WS}*[-*• ]*(\d{{1,7}}){_WS}*\|(.*)$"
    body = replies.select("vid", "batch", F.posexplode(X.split_lines(X.strip_think(F.col("content")))).alias("pos", "raw"))
    rows = body.where(F.col("raw").rlike(pattern))
    text = _unquote(F.substring_index(F.regexp_extract("raw", pattern, 2), "|", -1))
    return rows.select("vid", "batch", "pos", F.regexp_extract("raw", pattern, 1).cast("bigint").alias("id"), text.alias("new")) \
        .where("new <> ''").groupBy("vid", "batch", "id").agg(F.max_by("new", "pos").alias("new"))


def apply_reply(lines: DataFrame, parsed: DataFrame, answered: DataFrame) -> DataFrame:
    """Write replies to the lines of answered batches; ids a reply lacks become blank.

    An id that a reply gives for a line of another batch is not taken.
    """
    size = K.BATCH_LINES
    got = lines.withColumn("batch", F.floor(F.col("id") / size).cast("bigint")) \
        .join(answered.select("vid", "batch", F.lit(True).alias("_a")), ["vid", "batch"], "left") \
        .join(parsed.select("vid", "batch", "id", F.col("en").alias("_new")), ["vid", "batch", "id"], "left")
    return got.withColumn("en", F.when(F.col("_a"), X.strip(F.coalesce("_new", F.lit("")))).otherwise(F.col("en"))).drop("_a", "_new", "batch")


def apply_edits(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace edited text; ``changed`` marks lines whose text really differed.

    Of several edits of one line the last wins: by ``at`` where the edits have it, else by text.
    """
    last = F.max_by("en", "at") if "at" in edits.columns else F.max("en")
    got = lines.join(edits.groupBy("vid", "id").agg(last.alias("_new")), ["vid", "id"], "left")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("en"))
    return got.withColumn("changed", changed) \
        .withColumn("en", F.when(F.col("changed"), X.strip(F.col("_new"))).otherwise(F.col("en"))).drop("_new")


def reset_translation(lines: DataFrame) -> DataFrame:
    return lines.withColumn("en", F.lit(""))


def line_request(id_: Column, text: Column, budget: Column) -> Column:
    """Request for one line alone, as JSON."""
    return F.to_json(X.rec(translate=F.array(X.rec(id=id_, text=text, max_chars=budget))))
