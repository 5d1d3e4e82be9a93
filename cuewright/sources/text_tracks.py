"""Line arrays, recogniser parts and subtitle text as sources and sinks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..plans.blocks import positions

SEGMENT = "id BIGINT, start DOUBLE, end DOUBLE, text STRING, en STRING, fixed BOOLEAN, crowded BOOLEAN, clipped BOOLEAN"
PART = "STRUCT<language: STRING, segments: ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING>>>"


def _ms(seconds: Column) -> Column:
    return F.floor(seconds * 1000 + F.lit(0.5)).cast("bigint")


def _line_columns(s: str = "") -> list[Column]:
    c = lambda n: F.col(f"{s}{n}")
    return [c("id").alias("id"), _ms(c("start")).alias("start_ms"), _ms(c("end")).alias("end_ms"), c("text").alias("text"),
            F.coalesce(c("en"), F.lit("")).alias("en"), *[F.coalesce(c(f), F.lit(False)).alias(f) for f in ("fixed", "crowded", "clipped")]]


def lines_from_json(docs: DataFrame, column: str = "json") -> DataFrame:
    """Lines of videos whose array is a JSON string; a corrupt array has no rows."""
    shape = "ARRAY<STRUCT<" + ", ".join(f.replace(" ", ": ", 1) for f in SEGMENT.split(", ")) + ">>"
    parsed = docs.select("vid", F.explode(F.from_json(column, shape, {"mode": "PERMISSIVE"})).alias("s"))
    return parsed.where("s.id IS NOT NULL").select("vid", *_line_columns("s."))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One segments.json per video folder; missing or corrupt files give no rows."""
    raw = spark.read.schema(SEGMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    vid = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return raw.withColumn("vid", vid).where("id IS NOT NULL").select("vid", *_line_columns())


def write_lines(lines: DataFrame, path: str, buckets: int = 64, files: int = 16) -> None:
    """Checkpoint lines; only the buckets that occur are replaced.

    Rows are dealt to ``files`` files per bucket by line, so one huge video does
    not become one writer, and a bucket does not become a file per task.
    """
    lines.withColumn("bucket", F.pmod(F.xxhash64("vid"), F.lit(buckets)).cast("int")) \
        .repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(files))) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def parts_from_json(blobs: DataFrame) -> DataFrame:
    """Cached recogniser parts (vid, chunk, json) as rows; an unreadable part is absent."""
    p = F.from_json("json", PART)
    return blobs.select("vid", "chunk", p.alias("p")).where("p.segments IS NOT NULL").select(
        "vid", "chunk", F.col("p.language").alias("language"), F.posexplode_outer("p.segments").alias("pos", "s")) \
        .select("vid", "chunk", "language", F.col("pos").cast("bigint").alias("pos"),
                _ms(F.col("s.start")).alias("start_ms"), _ms(F.col("s.end")).alias("end_ms"), F.col("s.text").alias("text"))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return parts_from_json(files.select(F.element_at(F.split("file", "/"), -3).alias("vid"),
                                        F.regexp_extract("file", r"([^/]+)\.json$", 1).alias("chunk"), F.col("value").alias("json")))


def ingest_asr(responses: DataFrame) -> DataFrame:
    """Raw responses (vid, chunk, json) to lines, blank ones dropped, language lower-cased."""
    rows = parts_from_json(responses)
    return rows.withColumn("text", X.strip(F.coalesce("text", F.lit("")))).where("text <> ''") \
        .withColumn("language", F.lower(X.strip(F.coalesce("language", F.lit("")))))


# ---- subtitles --------------------------------------------------------------------
def cues(lines: DataFrame, field: str = "en") -> DataFrame:
    """Numbered cues (vid, n, start_ms, end_ms, cue): blank lines are skipped first."""
    shown = lines.withColumn("_t", X.strip(F.coalesce(field, F.lit("")))).where("_t <> ''")
    numbered = positions(shown.select("vid", "id", "start_ms", "end_ms", "_t"), "_k", ("id",))
    return numbered.select("vid", (F.col("_k") + 1).alias("n"), "start_ms", "end_ms", X.wrap_cue(F.col("_t")).alias("cue"))


def to_srt(lines: DataFrame, field: str = "en") -> DataFrame:
    """(vid, n, text), a row per cue; in order of n, each with a line break after it, they are the file."""
    gap = F.when(F.col("n") > 1, "\n").otherwise("")
    text = F.concat(gap, F.col("n").cast("string"), F.lit("\n"), X.cue_clock(F.col("start_ms")), F.lit(" --> "),
                    X.cue_clock(F.col("end_ms")), F.lit("\n"), "cue")
    return cues(lines, field).select("vid", "n", text.alias("text"))


def to_vtt(lines: DataFrame, field: str = "en") -> DataFrame:
    """As ``to_srt``; row 0 is the header, which a video without cues has too."""
    text = F.concat(F.lit("\n"), X.cue_clock(F.col("start_ms"), "."), F.lit(" --> "), X.cue_clock(F.col("end_ms"), "."), F.lit("\n"), "cue")
    head = lines.select("vid").distinct().select("vid", F.lit(0).cast("bigint").alias("n"), F.lit("WEBVTT").alias("text"))
    return head.unionByName(cues(lines, field).select("vid", "n", text.alias("text")))


def write_subtitles(rows: DataFrame, path: str) -> None:
    """Text files partitioned by video; a long video's files, in order of their names, are one after the other its text."""
    rows.repartitionByRange("vid", "n").sortWithinPartitions("vid", "n").select("vid", F.col("text").alias("value")) \
        .write.mode("overwrite").partitionBy("vid").text(path)
