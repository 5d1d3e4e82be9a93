"""How fast each line has to be spoken to fit its slot.

``lines`` carry ``total_ms``, the length of their video (``with_total`` adds it).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..plans.blocks import BLOCK, neighbours, running


def with_total(lines: DataFrame, videos: DataFrame) -> DataFrame:
    return lines.join(videos.select("vid", F.col("duration_ms").alias("total_ms")), "vid", "left")


def breath_after(en: Column) -> Column:
    """Pause a speaker would leave after this line, in milliseconds."""
    t = X.strip(F.coalesce(en, F.lit("")))
    last = X.last_char(t)
    return F.when(t == "", K.MIN_GAP_MS).when(last.isin(*".!?…"), K.BREATH_SENTENCE_MS) \
        .when(last.isin(*",;:—-"), K.BREATH_CLAUSE_MS).otherwise(K.BREATH_RUNON_MS).cast("bigint")


def slots(lines: DataFrame) -> DataFrame:
    """Adds next_ms (NULL on the last line), breath_ms and slot_ms."""
    seen = neighbours(lines, lambda w: {"next_ms": F.lead("start_ms").over(w)}, before=0, after=1)
    return seen.withColumn("breath_ms", F.when(F.col("next_ms").isNull(), F.lit(K.MIN_GAP_MS).cast("bigint"))
                           .otherwise(breath_after(F.col("en")))) \
        .withColumn("slot_ms", F.greatest(F.lit(K.MIN_SLOT_MS).cast("bigint"),
                                          F.coalesce("next_ms", "total_ms") - F.col("breath_ms") - F.col("start_ms")))


def native_rate(natural_ms: Column, slot_ms: Column) -> Column:
    """Rate asked of the voice itself; 1 where the line already fits."""
    need = natural_ms / slot_ms
    return F.when(need <= F.lit(K.NATIVE_FIT), F.lit(1.0)).otherwise(F.least(need, F.lit(K.NATIVE_CAP)))


def rate_percent(rate: Column, speed: int = 0) -> Column:
    return F.bround((F.lit(1.0 + speed / 100.0) * rate - 1.0) * 100, 0).cast("bigint")


def rendered(slotted: DataFrame, renders: DataFrame, speed: int = 0) -> DataFrame:
    """Renders after the voice's own speed-up: duration_ms and native_rate per line."""
    both = slotted.select("vid", "id", "slot_ms").join(renders, ["vid", "id"])
    rate = native_rate(F.col("natural_ms"), F.col("slot_ms"))
    return both.withColumn("native_rate", rate).withColumn("rate_pct", rate_percent(F.col("native_rate"), speed)) \
        .withColumn("duration_ms", F.col("natural_ms") / F.col("native_rate"))


def plan_columns(max_speedup: float = K.DEFAULT_MAX_SPEEDUP) -> dict[str, Column]:
    """Plan over start_ms, next_ms, total_ms, breath_ms, duration_ms, native_rate.

    Apply in order with withColumn: each uses the ones before it.
    """
    d, native = F.col("duration_ms"), F.col("native_rate")
    room = F.coalesce("next_ms", "total_ms") - F.col("start_ms")
    wide = F.greatest(F.lit(K.MIN_PLAN_GAP_MS), room - F.col("breath_ms")).cast("double")
    relaxed = F.greatest(F.lit(float(K.MIN_GAP_MS)), d / F.lit(K.BREATH_TEMPO))
    handed = F.greatest(F.lit(float(K.MIN_PLAN_GAP_MS)), F.least(room - K.MIN_GAP_MS, relaxed))
    gap = F.when(d / wide > F.lit(K.BREATH_TEMPO), handed).otherwise(wide)
    ceiling = F.greatest(F.lit(1.0), F.least(F.lit(K.TEMPO_CEIL), F.lit(float(max_speedup)) / native))
    clamp = F.least(F.greatest(F.lit(1.0), d / F.col("gap_ms")), ceiling)
    limit = F.when(F.col("next_ms").isNotNull(), F.greatest(
        F.lit(K.MIN_LIMIT_MS).cast("bigint"), room - K.SEPARATION_MS))
    crowded = F.coalesce(d / F.col("plain_tempo") > F.col("limit_ms"), F.lit(False))
    rescue = F.least(F.lit(K.RESCUE_TEMPO), F.lit(K.RESCUE_TOTAL) / native)
    plain = F.col("plain_tempo")
    hurried = F.least(F.greatest(plain, d / F.col("limit_ms")), F.greatest(plain, rescue))
    return {
        "gap_ms": gap,
        "plain_tempo": clamp,
        "limit_ms": limit,
        "crowded": crowded,
        "tempo": F.when(F.col("crowded"), hurried).otherwise(plain),
        "clipped": F.col("crowded") & (d / F.col("tempo") > F.col("limit_ms") + K.CLIP_SLACK_MS),
    }


def dub_plan(lines: DataFrame, renders: DataFrame, max_speedup: float = K.DEFAULT_MAX_SPEEDUP) -> DataFrame:
    """Tempo, limit and flags for every rendered line. renders: vid, id, duration_ms, native_rate."""
    plan = slots(lines).join(renders.select("vid", "id", "duration_ms", "native_rate"), ["vid", "id"])
    for name, value in plan_columns(max_speedup).items():
        plan = plan.withColumn(name, value)
    return plan


def dub_times(plan: DataFrame) -> DataFrame:
    """Where each line is heard: played length is cut at the limit."""
    length = F.col("duration_ms") / F.col("tempo")
    played = F.coalesce(F.least(length, F.col("limit_ms")), length)
    return plan.withColumn("dub_start_ms", F.col("start_ms")) \
        .withColumn("dub_end_ms", X.half_up(F.col("start_ms") + played)) \
        .withColumn("dub_speedup_milli", X.half_up(F.col("tempo") * F.col("native_rate") * 1000))


def overlapped(timed: DataFrame) -> DataFrame:
    """Flag lines that start before the last placed line has ended (20 ms grace)."""
    before = running(timed, {"_prev": ("max", X.rec(id=F.col("id"), e=F.col("dub_end_ms")))})
    return before.withColumn("overlapped", F.coalesce(F.col("start_ms") < F.col("_prev")["e"] - 20, F.lit(False))).drop("_prev")


def dub_stats(plan: DataFrame) -> DataFrame:
    return plan.groupBy("vid").agg(
        F.count("*").alias("lines"), F.count_if(F.col("tempo") > 1.01).alias("compressed"),
        F.count_if("crowded").alias("crowded"), F.count_if("clipped").alias("clipped"),
        F.greatest(F.lit(1000).cast("bigint"), F.max(X.half_up(F.col("tempo") * F.col("native_rate") * 1000))).alias("max_rate_milli"))


def with_failed(stats: DataFrame, lines: DataFrame, renders: DataFrame) -> DataFrame:
    """Adds the number of spoken lines that have no render, each counted once."""
    silent = lines.where(X.strip(F.col("en")) != "").join(renders, ["vid", "id"], "left_anti")
    return stats.join(silent.groupBy("vid").agg(F.count("*").alias("failed")), "vid", "full") \
        .na.fill(0, ["lines", "compressed", "crowded", "clipped", "failed"]).na.fill(1000, ["max_rate_milli"])


# ---- renders and stamps ----------------------------------------------------------
def render_fingerprint(voice: Column, pitch: Column, speed: Column, volume: Column, spoken: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", voice, pitch.cast("string"), speed.cast("string"),
                                          volume.cast("string"), spoken)), 1, 10)


def with_fingerprint(lines: DataFrame, voice="en-US-AndrewMultilingualNeural", pitch=0, speed=0, volume=0) -> DataFrame:
    return with_print(lines.withColumn("spoken", X.clean_for_speech(F.col("en"))), voice, pitch, speed, volume)


def with_print(spoken: DataFrame, voice="en-US-AndrewMultilingualNeural", pitch=0, speed=0, volume=0) -> DataFrame:
    """Adds the fingerprint of the text in ``spoken``."""
    return spoken.withColumn("fingerprint", render_fingerprint(F.lit(voice), F.lit(pitch), F.lit(speed), F.lit(volume), F.col("spoken")))


def to_render(lines: DataFrame, renders: DataFrame, **voice) -> DataFrame:
    """Spoken lines without a usable render (more than 512 bytes) of this fingerprint."""
    usable = renders.where("size_bytes > 512").select("vid", "id", "fingerprint")
    spoken = F.explode(F.array(X.clean_for_speech(F.col("en"))))  # once: no filter is pushed below a generator
    wanted = lines.drop("spoken").withColumn("spoken", spoken).where("spoken <> ''")
    return with_print(wanted, **voice).join(usable, ["vid", "id", "fingerprint"], "left_anti")


def ordered_text(order: str, value: Column, separator: str) -> Column:
    """Aggregate: values joined in order. Only for groups of a bounded size."""
    rows = F.sort_array(F.collect_list(X.rec(o=F.col(order), t=value)))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


STAMP_BLOCK = 4096


def dub_stamp(lines: DataFrame, options: list, block: int = STAMP_BLOCK) -> DataFrame:
    """Digest of the settings and of every line's id, start and text.

    Lines are digested in blocks of ``block`` and the ordered block digests once more, for every
    length, so no task holds a whole transcript. ``block`` is part of the stamp's format: it does
    not follow the block size that work is cut by.
    """
    blocks = lines.groupBy("vid", F.floor(F.col("id") / block).alias("b")).agg(ordered_text(
        "id", F.concat_ws(":", F.col("id").cast("string"), F.col("start_ms").cast("string"), F.coalesce("en", F.lit(""))), "\x1f").alias("t")) \
        .select("vid", "b", X.digest(F.col("t")).alias("d"))
    whole = blocks.groupBy("vid").agg(ordered_text("b", F.col("d"), "\x1f").alias("ds"))
    inner = X.digest(F.col("ds"))
    return whole.select("vid", X.digest(*[F.lit(o) for o in options], inner).alias("stamp"))


def reuse_track(stamps: DataFrame, now: DataFrame) -> DataFrame:
    """Videos whose finished track still fits: same stamp and same file size."""
    return now.join(stamps.where("stage = 'dub'").select("vid", "stamp", "size_bytes"), ["vid", "stamp", "size_bytes"], "left_semi")


def final_stats(lines: DataFrame, settings: dict) -> DataFrame:
    pairs = [F.lit(str(x)) for kv in settings.items() for x in kv]
    return lines.groupBy("vid").agg(
        F.count("*").alias("line_count"), F.count_if(X.strip(F.col("en")) != "").alias("translated_lines")) \
        .withColumn("stats", F.map_concat(F.create_map(*pairs), F.create_map(
            F.lit("translated_lines"), F.col("translated_lines").cast("string"))))
