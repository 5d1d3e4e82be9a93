"""Which picture and sound to download."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X

_FIELDS = ("format_id", "ext", "height", "fps", "vcodec", "acodec", "abr", "tbr", "filesize", "filesize_approx", "pos")


def _fmt() -> Column:
    return F.struct(*_FIELDS)


def _size(f: str = "") -> Column:
    n = lambda c: F.nullif(F.col(f"{f}{c}"), F.lit(0))
    return F.coalesce(n("filesize"), n("filesize_approx"), F.lit(0)).cast("bigint")


def video_formats(formats: DataFrame) -> DataFrame:
    """Video-only mp4 and webm streams whose size is known, without the -drc copies."""
    return formats.where(
        (F.coalesce("height", F.lit(0)) > 0) & (F.coalesce("acodec", F.lit("none")) == "none")
        & F.col("ext").isin("mp4", "webm") & ~F.col("format_id").endswith("-drc") & (_size() > 0))


def best_per_height(formats: DataFrame) -> DataFrame:
    """One stream per height: codec rank, then bitrate, then listing order.

    A keyed minimum, combined before the shuffle, so a title listed a million
    times costs no more than any other.
    """
    codec = F.coalesce("vcodec", F.lit(""))
    rank = F.lit(len(K.VIDEO_CODEC_RANK))
    for i, name in reversed(list(enumerate(K.VIDEO_CODEC_RANK))):
        rank = F.when(codec.startswith(name), i).otherwise(rank)
    order = F.struct(rank, -F.coalesce("tbr", F.lit(0.0)), F.col("pos"))
    return video_formats(formats).groupBy("vid", "height").agg(F.min_by(_fmt(), order).alias("v"))


def pair_audio(formats: DataFrame) -> DataFrame:
    """(vid, large, small): the sound to pair with pictures from 360p up, and below.

    Only two bitrates are ever asked for, so each title needs two answers rather
    than a comparison of every picture with every sound.
    """
    audio = formats.where((F.col("vcodec") == "none") & (F.coalesce("acodec", F.lit("none")) != "none")
                          & (F.coalesce("abr", F.lit(0.0)) != 0) & ~F.col("format_id").endswith("-drc"))
    m4a = F.col("ext") == "m4a"
    up, down = F.struct("abr", "pos"), F.struct(F.col("abr"), -F.col("pos"))

    def pick(target: int) -> Column:
        enough = F.col("abr") >= target - 1
        closest = lambda c: F.min_by(F.when(c, _fmt()), F.when(c, up))
        biggest = lambda c: F.max_by(F.when(c, _fmt()), F.when(c, down))
        return F.when(F.bool_or(m4a), F.coalesce(closest(m4a & enough), biggest(m4a))) \
            .otherwise(F.coalesce(closest(enough), biggest(F.lit(True))))

    return audio.groupBy("vid").agg(pick(K.AUDIO_KBPS_LARGE).alias("large"), pick(K.AUDIO_KBPS_SMALL).alias("small"))


def quality_menu(formats: DataFrame) -> DataFrame:
    """One row per title and height: label, format, codec, container and total size."""
    both = best_per_height(formats).join(pair_audio(formats), "vid", "left") \
        .withColumn("a", F.when(F.col("height") >= K.AUDIO_LARGE_FROM_HEIGHT, F.col("large")).otherwise(F.col("small")))
    has = F.col("a").isNotNull()
    fps = F.coalesce("v.fps", F.lit(0.0))
    mp4 = (F.col("v.ext") == "mp4") & (~has | (F.col("a.ext") == "m4a"))
    return both.select(
        "vid", F.col("height").cast("bigint").alias("height"),
        F.concat(F.col("height").cast("string"), F.lit("p"), F.when(fps > 35, F.floor(fps).cast("string")).otherwise("")).alias("label"),
        F.when(has, F.concat("v.format_id", F.lit("+"), "a.format_id")).otherwise(F.col("v.format_id")).alias("format"),
        F.substring_index(F.coalesce("v.vcodec", F.lit("")), ".", 1).alias("vcodec"),
        F.when(has, F.bround("a.abr", 0).cast("bigint")).otherwise(0).alias("abr"),
        F.when(mp4, "mp4").otherwise("mkv").alias("ext"),
        (_size("v.") + F.when(has, _size("a.")).otherwise(0)).alias("size"))


def explain_error(detail: Column, cookies: Column) -> Column:
    """What a download error means; NULL when it speaks for itself."""
    locked = detail.rlike("(?i)could not copy|cookie database|could not find .* cookies")
    wall = detail.rlike("(?i)confirm you.{0,3}re not a bot|sign in to confirm")
    return F.when(locked, "cookies_locked: close the browser or pick another under Settings") \
        .when(wall & cookies, "refused_with_cookies: sign in with that browser or pick another under Settings") \
        .when(wall, "bot_check: pick a signed-in, closed browser under Settings")
