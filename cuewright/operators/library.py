"""The library of videos: rows, shelves, labels and admission."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X

DOWNLOAD_STATES = ("downloading", "downloaded")


def create_videos(new: DataFrame, now) -> DataFrame:
    """New rows with defaults filled in, to be appended. new: vid, title, [status, stage, progress]."""
    have = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) if c in new.columns else F.lit(d)
    progress = F.coalesce("progress", F.lit(0)) if "progress" in new.columns else F.lit(0)
    return new.withColumns({"status": have("status", "queued"), "stage": have("stage", "Waiting to start"),
                            "progress": progress.cast("bigint"), "created_at": F.lit(now), "updated_at": F.lit(now)})


def update_videos(videos: DataFrame, patch: DataFrame, now) -> DataFrame:
    """Patched fields replace old ones and stamp ``updated_at``.

    ``patch``: one row per video. NULL leaves a field alone, unless the optional array column
    ``set_fields`` names it: then the field is cleared.
    """
    fields = [c for c in patch.columns if c not in ("vid", "set_fields")]
    named = F.col("set_fields") if "set_fields" in patch.columns else F.array().cast("array<string>")
    p = patch.select("vid", *[F.col(c).alias(f"_{c}") for c in fields], F.coalesce(named, F.array().cast("array<string>")).alias("_set"), F.lit(True).alias("_hit"))
    out = videos.join(p, "vid", "left")
    return out.withColumns({c: F.when(F.array_contains("_set", c), F.col(f"_{c}")).otherwise(F.coalesce(f"_{c}", c)) for c in fields}) \
        .withColumn("updated_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("updated_at"))) \
        .drop("_hit", "_set", *[f"_{c}" for c in fields])


def get_video(videos: DataFrame, vid) -> DataFrame:
    return videos.where(F.col("vid") == F.lit(vid))


def list_videos(videos: DataFrame) -> DataFrame:
    return videos.orderBy(F.col("created_at").desc(), "vid")


def delete_videos(videos: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, refusals): videos still processing are not deleted, unknown ids are refused."""
    known = ids.select("vid").distinct().join(videos.select("vid", "status"), "vid", "left")
    refused = known.where("status IS NULL OR status = 'processing'") \
        .select("vid", F.when(F.col("status").isNull(), "not found").otherwise("still processing").alias("reason"))
    gone = known.where("status <> 'processing'").select("vid")
    return videos.join(gone, "vid", "left_anti"), refused


def decorate(videos: DataFrame, files: DataFrame) -> DataFrame:
    """Flags from the file manifest (vid, name) and parsed ``stats``; bad JSON counts as empty."""
    sources = [f"source{e}" for e in K.SOURCE_EXTENSIONS]
    have = files.groupBy("vid").agg(F.bool_or(F.col("name") == "dubbed.mp4").alias("has_output"),
                                    F.bool_or(F.col("name") == "thumb.jpg").alias("has_thumb"),
                                    F.bool_or(F.col("name").isin(*sources)).alias("has_source"))
    return videos.join(have, "vid", "left").na.fill(False, ["has_output", "has_thumb", "has_source"]) \
        .withColumn("stats", F.coalesce(F.try_parse_json("stats"), F.parse_json(F.lit("{}"))))


def shelf(videos: DataFrame, section: str = "dubbed", search: str = "") -> DataFrame:
    mine = F.col("status").isin(*DOWNLOAD_STATES) == F.lit(section == "downloads")
    found = F.lit(True) if not search else F.contains(F.lower("title"), F.lit(search.lower()))
    return videos.where(mine & found)


def shelf_counts(videos: DataFrame) -> DataFrame:
    down = F.col("status").isin(*DOWNLOAD_STATES)
    return videos.agg(F.count_if(~down).alias("dubbed"), F.count_if(down).alias("downloads"))


def status(videos: DataFrame) -> DataFrame:
    return videos.select("vid", "status", "stage", "progress", "error", "line_count", "duration_s")


def effective_opts(videos: DataFrame, settings: dict[str, str], keys: list[str]) -> DataFrame:
    """Option overlay, later wins: settings, the video's columns, its stats, the request.

    videos: option columns by name, ``stats`` and ``request`` as string maps.
    """
    out = []
    for k in keys:
        column = F.col(k).cast("string") if k in videos.columns else F.lit(None).cast("string")
        out.append(F.coalesce(F.try_element_at("request", F.lit(k)), F.try_element_at("stats", F.lit(k)),
                              F.nullif(column, F.lit("")), F.lit(settings.get(k))).alias(k))
    return videos.select("vid", *out)


def admit(videos: DataFrame, action: str) -> DataFrame:
    """Adds ``refusal``: why the action cannot start now, or NULL.

    videos: status, has_source, line_count.
    """
    busy = F.col("status").isin("queued", "processing") if action == "translate" else F.col("status") == "processing"
    refusal = F.when(busy, "already in flight")
    if action in ("revoice", "retranslate"):
        refusal = refusal.when(F.coalesce("line_count", F.lit(0)) == 0, "no transcript")
    if action == "translate":
        refusal = refusal.when(~F.coalesce("has_source", F.lit(False)), "no source")
    return videos.withColumn("refusal", refusal)


def line_at(lines: DataFrame, moments: DataFrame, step_ms: int = 10_000) -> DataFrame:
    """The line on screen at each moment (vid, at_ms): the first that covers it, NULL where none does.

    An interval join made equal on ten-second buckets, so it never compares all pairs.
    """
    spans = lines.where("end_ms > start_ms").withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("start_ms") / step_ms), F.floor((F.col("end_ms") - 1) / step_ms))))
    asked = moments.withColumn("_b", F.floor(F.col("at_ms") / step_ms))
    pairs = asked.join(spans.select("vid", "_b", "id", "start_ms", "end_ms"), ["vid", "_b"], "left")
    covers = (F.col("at_ms") >= F.col("start_ms")) & (F.col("at_ms") < F.col("end_ms"))
    return pairs.groupBy(*moments.columns).agg(F.min(F.when(covers, F.col("id"))).alias("id"))


def line_marks(lines: DataFrame) -> DataFrame:
    """Badges: the rate above 1.05, a rewrite, a cut. lines: dub_speedup_milli, fixed, clipped."""
    rate = F.format_string("%.2fx", F.col("dub_speedup_milli") / 1000)
    return lines.withColumn("marks", F.array_compact(F.array(
        F.when(F.col("dub_speedup_milli") > 1050, rate), F.when(F.col("fixed"), "rewritten"), F.when(F.col("clipped"), "cut short"))))


def stat_grid(videos: DataFrame) -> DataFrame:
    """Watch-page numbers from the stats VARIANT, with what to show where one is missing."""
    get = lambda path, kind: F.try_variant_get("stats", f"$.{path}", kind)
    voice = F.replace(F.element_at(F.split(F.coalesce("voice", F.lit("")), "-"), -1), F.lit("Neural"), F.lit(""))
    return videos.select(
        "vid", X.hhmmss(F.col("duration_s").cast("double")).alias("length"), F.coalesce(get("lines", "bigint"), F.col("line_count")).alias("lines"),
        F.coalesce(F.nullif(voice, F.lit("")), F.lit("-")).alias("voice"), F.coalesce(get("compressed", "bigint"), F.lit(0)).cast("bigint").alias("compressed"),
        F.coalesce(get("max_rate_milli", "bigint"), F.lit(1000)).cast("bigint").alias("peak_milli"),
        F.coalesce(get("clipped", "bigint"), F.lit(0)).cast("bigint").alias("clipped"))


def validate_uploads(files: DataFrame, *, title_chars: int | None = 200) -> DataFrame:
    """Adds title and refusal. files: filename, size_bytes, title.

    A title is cut after ``title_chars`` characters; None leaves it whole.
    """
    ext = F.lower(F.regexp_extract("filename", r"(\.[^./]+)$", 1))
    stem = F.regexp_replace("filename", r"\.[^./]+$", "")
    title = F.coalesce(F.nullif(X.strip(F.coalesce("title", F.lit(""))), F.lit("")), stem)
    title = title if title_chars is None else F.substring(title, 1, title_chars)
    return files.withColumn("title", title).withColumn(
        "refusal", F.when(~ext.isin(*K.VIDEO_EXTENSIONS), "format not supported").when(F.col("size_bytes") == 0, "empty file"))


# ---- viewing and recovery -----------------------------------------------------------
def latest_position(positions: DataFrame) -> DataFrame:
    """Where each viewer stopped, in tenths of a second, and when; the last report wins."""
    return positions.groupBy("vid").agg(F.max_by("at_s", F.struct("ts_s", "event_id")).alias("at_s"), F.max("ts_s").alias("watched_at")) \
        .select("vid", X.half_up(F.greatest(F.lit(0.0), "at_s") * 10).alias("at_tenths"), "watched_at")


def watched(position_s: Column, duration_s: Column) -> Column:
    """Share watched in thousandths; NULL up to 20 s in; 1000 counts as watched (above 97 %)."""
    share = F.least(F.lit(1.0), position_s / duration_s)
    return F.when((position_s > 20) & (duration_s > 0), F.when(share > 0.97, 1000).otherwise(F.floor(share * 1000))).cast("bigint")


def usable_artifacts(manifest: DataFrame) -> DataFrame:
    """Files worth reusing: audio above 4096 bytes and half a second, renders above 512 bytes."""
    return manifest.where(((F.col("kind") == "audio") & (F.col("size_bytes") > 4096) & (F.col("duration_ms") > 500))
                          | ((F.col("kind") == "render") & (F.col("size_bytes") > 512)))


def recovery_plan(videos: DataFrame) -> DataFrame:
    """What a restart does with unfinished videos, oldest first."""
    action = F.when(F.col("status") == "downloading", "fail").when(F.col("status").isin("processing", "queued"), "resume")
    return videos.withColumn("action", action).where("action IS NOT NULL").orderBy("created_at", "vid")


def stages_to_run(stamps: DataFrame, inputs: DataFrame) -> DataFrame:
    """Stages (vid, stage, stamp) whose inputs differ from those they last finished for."""
    return inputs.join(stamps.select("vid", "stage", "stamp"), ["vid", "stage", "stamp"], "left_anti")
