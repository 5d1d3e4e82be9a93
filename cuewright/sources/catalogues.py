"""Format lists, download logs, voices, clones, the library table and stage stamps."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X

FORMAT = ("STRUCT<format_id: STRING, ext: STRING, height: INT, fps: DOUBLE, vcodec: STRING, acodec: STRING, "
          "abr: DOUBLE, tbr: DOUBLE, filesize: BIGINT, filesize_approx: BIGINT>")


def read_formats(probes: DataFrame) -> DataFrame:
    """Format catalogues (vid, json with a ``formats`` list) as one row per format."""
    listed = F.from_json("json", f"STRUCT<formats: ARRAY<{FORMAT}>>")["formats"]
    return probes.select("vid", F.posexplode(listed).alias("pos", "f")).select("vid", F.col("pos").cast("bigint").alias("pos"), "f.*")


def progress_of(lines: DataFrame) -> DataFrame:
    """Progress lines of a download log: percent (97 at most, 98 when joining), speed, time left.

    lines: value, plus any columns to keep. Other lines are dropped.
    """
    line = X.strip(F.col("value"))
    spaced = F.regexp_replace(line, r"^([^%]*)%", "$1% ")
    pattern = rf"^DL[{K.WHITESPACE_CLASS}]+([\d.]+)%[{K.WHITESPACE_CLASS}]+([^{K.WHITESPACE_CLASS}]*)[{K.WHITESPACE_CLASS}]*([^{K.WHITESPACE_CLASS}]*)"
    hit, merging = spaced.rlike(pattern), line.startswith("[Merger]")
    pct = F.least(F.lit(97).cast("bigint"), F.floor(F.regexp_extract(spaced, pattern, 1).try_cast("double")).cast("bigint"))
    eta = F.regexp_extract(spaced, pattern, 3)
    return lines.where(hit | merging).withColumns({
        "pct": F.when(hit, pct).otherwise(98),
        "speed": F.when(hit, F.coalesce(F.nullif(F.regexp_extract(spaced, pattern, 2), F.lit("")), F.lit("-"))).otherwise(""),
        "eta": F.when(hit & (eta != "Unknown"), eta).otherwise("")}).drop("value")


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The same over log files as they grow: a streaming DataFrame."""
    log = spark.readStream.schema("value STRING").text(folder).withColumn("file", F.col("_metadata.file_path"))
    return progress_of(log)


def voice_dim(raw: DataFrame, clones: DataFrame) -> DataFrame:
    """English voices with derived names and a shelf order; clones come first.

    raw: short_name, locale, gender, personalities; clones: id, name, gender.
    """
    last = F.element_at(F.split("short_name", "-"), -1)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in K.LOCALE_ORDER]), F.col("locale")), F.lit(0))
    multi = F.contains("short_name", F.lit("Multilingual"))
    stock = raw.where(F.col("locale").startswith("en-")).select(
        F.col("short_name").alias("id"), F.replace(last, F.lit("Neural"), F.lit("")).alias("name"), "locale", "gender",
        multi.alias("multilingual"), F.coalesce("personalities", F.array().cast("array<string>")).alias("personalities"),
        F.lit(False).alias("clone"), F.when(rank == 0, 9).otherwise(rank - 1).cast("bigint").alias("locale_rank"))
    own = clones.select("id", "name", F.lit("clone").alias("locale"), F.coalesce("gender", F.lit("Unknown")).alias("gender"),
                        F.lit(False).alias("multilingual"), F.array().cast("array<string>").alias("personalities"),
                        F.lit(True).alias("clone"), F.lit(-1).cast("bigint").alias("locale_rank"))
    return own.unionByName(stock).orderBy(~F.col("clone"), "locale_rank", ~F.col("multilingual"), "name", "id")


def clone_dim(files: DataFrame) -> DataFrame:
    """Cloned voices with defaults; folders without a model or readable metadata are dropped.

    files: dir, name, content.
    """
    per = files.groupBy("dir").agg(F.bool_or(F.col("name") == "model.pth").alias("model"),
                                   F.max(F.when(F.col("name") == "voice.json", F.col("content"))).alias("meta"))
    m = F.from_json("meta", "STRUCT<id: STRING, name: STRING, gender: STRING, base_voice: STRING, _corrupt_record: STRING>",
                    {"columnNameOfCorruptRecord": "_corrupt_record"})
    return per.where("model AND meta IS NOT NULL").withColumn("m", m).where("m._corrupt_record IS NULL").select(
        F.coalesce("m.id", "dir").alias("id"), F.coalesce("m.name", F.initcap("dir")).alias("name"),
        F.coalesce("m.gender", F.lit("Unknown")).alias("gender"), F.coalesce("m.base_voice", F.lit(K.DEFAULT_BASE_VOICE)).alias("base_voice"))


def base_voice(jobs: DataFrame, clones: DataFrame) -> DataFrame:
    """The stock voice that speaks for each job: a clone's base, or the voice itself."""
    base = clones.select(F.col("id").alias("voice"), F.col("base_voice").alias("_b"))
    return jobs.join(base, "voice", "left").withColumn("base_voice", F.coalesce("_b", "voice")).drop("_b")


def upgrade_videos(videos: DataFrame) -> DataFrame:
    """Columns added later default to zero; applying this twice changes nothing."""
    for name in ("position_s", "watched_at"):
        known = F.col(name) if name in videos.columns else F.lit(None)
        videos = videos.withColumn(name, F.coalesce(known.cast("double"), F.lit(0.0)))
    return videos


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    return upgrade_videos(spark.read.option("mergeSchema", True).parquet(path))


def current_stages(log: DataFrame) -> DataFrame:
    """Stage stamps in force: the latest entry wins and a clear removes it.

    log: vid, stage, op ('mark' | 'clear'), ts, stamp, size_bytes.
    """
    last = log.groupBy("vid", "stage").agg(F.max_by(F.struct("op", "stamp", "size_bytes"), F.struct("ts", "op")).alias("x"))
    return last.where("x.op = 'mark'").select("vid", "stage", "x.stamp", "x.size_bytes")


def mark_stage(videos: DataFrame, stage: str, ts) -> DataFrame:
    """Log rows for a finished stage (vid, stamp, size_bytes), to be appended."""
    return videos.select("vid", F.lit(stage).alias("stage"), F.lit("mark").alias("op"), F.lit(ts).alias("ts"), "stamp", "size_bytes")


def clear_stages(videos: DataFrame, stages: list[str], ts) -> DataFrame:
    return videos.select("vid", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"), F.lit("clear").alias("op"),
                         F.lit(ts).alias("ts"), F.lit(None).cast("string").alias("stamp"), F.lit(None).cast("bigint").alias("size_bytes"))
