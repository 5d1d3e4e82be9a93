"""Reports over a request log: concurrency, throughput, limits, models."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K


def _levels(requests: DataFrame) -> DataFrame:
    ok = F.col("http_status") == 200
    return requests.groupBy("streams").agg(
        (F.max("ts_s") - F.min("ts_s") + 1).alias("seconds"), F.count_if(ok).alias("ok"),
        F.count_if(F.col("http_status") == 429).alias("retries"), F.coalesce(F.sum(F.when(ok, F.col("total_tokens"))), F.lit(0)).alias("tokens"))


def concurrency_report(requests: DataFrame) -> DataFrame:
    """Per concurrency level, with its speed-up over the lowest level and whether it is fastest."""
    levels = _levels(requests)
    ends = levels.agg(F.min_by("seconds", "streams").alias("base"), F.min_by("streams", F.struct("seconds", "streams")).alias("best"))
    row = ends.select(F.struct("base", "best")).scalar()
    return levels.withColumn("speedup_milli", F.floor(row["base"] * 1000 / F.col("seconds") + F.lit(0.5)).cast("bigint")) \
        .withColumn("fastest", F.col("streams") == row["best"])


def throughput_report(requests: DataFrame) -> DataFrame:
    return _levels(requests).select("streams", "seconds", "ok", F.col("retries").alias("refused"), "tokens",
                                    F.floor(F.col("tokens") * 1000 / F.col("seconds") + F.lit(0.5)).cast("bigint").alias("tokens_per_ks"))


def shared_bucket(bursts: DataFrame, samples: DataFrame, slot_s: int = 3_600) -> DataFrame:
    """Does another key's budget fall while one key bursts?

    bursts: burst, model, from_s, to_s, base; samples: model, ts_s, http_status,
    remaining. Joined on hour slots, then reduced before anything else.
    """
    spans = bursts.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("from_s") / slot_s), F.floor(F.col("to_s") / slot_s))))
    seen = samples.withColumn("_slot", F.floor(F.col("ts_s") / slot_s))
    hits = spans.join(seen, ["model", "_slot"]).where("ts_s BETWEEN from_s AND to_s").groupBy("burst").agg(
        F.min(F.when(F.col("remaining") >= 0, F.col("remaining"))).alias("lowest"),
        F.count_if(F.col("http_status") == 429).alias("refused"), F.count("*").alias("probes"))
    drained = F.col("base") - F.col("lowest")
    return bursts.join(hits, "burst", "left").select(
        "burst", "lowest", F.coalesce("refused", F.lit(0)).alias("refused"), F.coalesce("probes", F.lit(0)).alias("probes"),
        F.when(F.col("lowest").isNull(), "inconclusive").when((F.col("refused") > 0) | (drained > F.col("base") * 0.3), "shared")
        .when(drained < F.col("base") * 0.05, "separate").otherwise("unclear").alias("verdict"))


def lines_per_minute(runs: DataFrame) -> DataFrame:
    """runs: streams, lines, seconds. Rate per level, its ratio to the lowest level's rate, unequal work flagged."""
    per = runs.groupBy("streams").agg(F.sum("lines").alias("lines"), F.sum("seconds").alias("seconds"))
    base = per.agg(F.min_by(F.struct("lines", "seconds"), "streams").alias("b")).scalar()
    fair = (F.col("lines") / F.col("seconds")) / (base["lines"] / base["seconds"])
    gap = F.abs(F.col("lines") - base["lines"])
    return per.select("streams", "lines", "seconds", F.floor(F.col("lines") * 60 / F.col("seconds") + F.lit(0.5)).cast("bigint").alias("per_minute"),
                      F.floor(fair * 1000 + F.lit(0.5)).cast("bigint").alias("fair_milli"),
                      (gap > F.greatest(F.lit(2.0), base["lines"] * 0.05)).alias("unequal"))


def est_throughput(models: DataFrame) -> DataFrame:
    """Estimated lines and tokens a minute per pool. models: pool, model."""
    rate = F.when(F.col("model").rlike(K.REASONING_MODEL), 50).otherwise(110)
    return models.groupBy("pool").agg(F.sum(rate).alias("lines_per_minute"), (F.count("*") * 8000).alias("tokens_per_minute"))


def _has_any(col: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(col), F.lit(w))
    return out


def model_dim(ids: DataFrame) -> DataFrame:
    """Catalogue of usable models: kind, preference rank, fit to help. ids: model."""
    m = F.col("model")
    rank = F.lit(len(K.MODEL_PREFERENCE))
    for i, p in reversed(list(enumerate(K.MODEL_PREFERENCE))):
        rank = F.when(F.contains(F.lower(m), F.lit(p)), i).otherwise(rank)
    speech = F.contains(F.lower(m), F.lit("whisper"))
    return ids.where(~_has_any(m, K.MODEL_SKIP)).select("model").distinct().select(
        "model", F.when(speech, "speech").otherwise("chat").alias("kind"),
        F.when(~speech, rank).cast("bigint").alias("rank"), (~speech & ~_has_any(m, K.MODEL_UNFIT_HELPER)).alias("helper"))


def usage_vs_limits(requests: DataFrame, limits: DataFrame) -> DataFrame:
    """Tokens and requests per (key, model, day) and the busiest minute, against limits.

    limits: model, tokens_per_day, requests_per_day, tokens_per_minute.
    """
    minute = requests.groupBy("key_id", "model", F.floor(F.col("ts_s") / 86_400).cast("bigint").alias("day"),
                              F.floor(F.col("ts_s") / 60).alias("minute")) \
        .agg(F.sum("total_tokens").alias("t"), F.count("*").alias("r"))
    day = minute.groupBy("key_id", "model", "day").agg(F.sum("t").alias("tokens"), F.sum("r").alias("requests"), F.max("t").alias("peak_minute"))
    share = lambda a, b: F.floor(F.col(a) * 1000 / F.col(b)).cast("bigint")
    return day.join(limits, "model").select(
        "key_id", "model", "day", "tokens", "requests", "peak_minute", share("tokens", "tokens_per_day").alias("day_tokens_milli"),
        share("requests", "requests_per_day").alias("day_requests_milli"), share("peak_minute", "tokens_per_minute").alias("minute_tokens_milli"))
