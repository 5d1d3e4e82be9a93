"""Secret scans over every version of every transcript, with built-in functions only.

A blob is a text, addressed by its SHA-256. The ledger has one row per blob that was ever
scanned: which rules, in which version, and what they found. A scan looks only at pairs of blob
and rule version that the ledger lacks, and the report joins the findings back to every path
that holds the blob.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_sha
from .spans import spans


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    least: int = 0      # a match (or its last part, see `tail`) shorter than this is dropped
    tail: str = ""      # regex of the part before the secret itself
    gate: str = ""      # literal that a text must hold before the regex is tried
    version: int = 1


ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
RULES = (
    Rule("assign", ASSIGN + r"[A-Za-z0-9+/_.=-]+", 8, "^" + ASSIGN),
    Rule("access", r"AKIA[A-Z0-9]+", 16, gate="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", gate="eyJ"),
    Rule("hubtoken", r"gh[pousr]_[A-Za-z0-9]{36,}", gate="gh"),
    Rule("chattoken", r"xox[abprs]-[A-Za-z0-9-]{10,}", gate="xox"),
    Rule("mapskey", r"AIza[A-Za-z0-9_-]{35}", gate="AIza"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", gate="PRIVATE KEY-----"),
    Rule("urlcred", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@", gate="://"),
)
BASE = ("assign", "access", "hex")
FOUND = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _found(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one rule, empty where the gate or the regex says no."""
    regex = F.lit(rule.regex)
    hit = spans(text, regex)
    if rule.least:
        hit = F.filter(hit, lambda h: F.length(F.regexp_replace(h["match"], rule.tail, "") if rule.tail else h["match"])
                       >= rule.least)
    gate = text.contains(rule.gate) & text.rlike(rule.regex) if rule.gate else text.rlike(rule.regex)
    shaped = F.transform(hit, lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"),
                                                 F.lit(rule.kind).alias("kind"), h["end"].alias("end")))
    return F.when(gate, shaped).otherwise(F.array().cast(FOUND))


def _versioned(rules) -> Column:
    return F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])


def blob_of(text: Column) -> Column:
    return hex_sha(F.coalesce(text, F.lit("")))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """The ledger after these versions: ``blob, done array<string>, findings``.

    ``versions``: one row per version of a transcript with ``text`` (NULL: empty); repeated texts
    are one blob and are scanned once. Ledger rows that are complete for ``rules`` are passed on
    untouched; where a rule has a new version, its old findings go and only that rule runs.
    An empty table gives an unchanged ledger. Equal texts are dropped within each map task before
    the shuffle, so a text that fills a third of the table reaches one task once per map task.
    """
    fresh = versions.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", hex_sha(F.col("text"))) \
        .groupBy("blob").agg(F.first("text").alias("text"))
    none, empty = F.array().cast("array<string>"), F.array().cast(FOUND)
    if ledger is None:
        work = fresh.select("blob", "text", none.alias("was"), empty.alias("findings"))
        rest = None
    else:
        known = ledger.select("blob", "done", "findings")
        work = fresh.join(known, "blob", "left").select(
            "blob", "text", F.coalesce("done", none).alias("was"), F.coalesce("findings", empty).alias("findings")) \
            .where(F.size(F.array_except(_versioned(rules), F.col("was"))) > 0)
        rest = known.join(work.select("blob"), "blob", "left_anti")
    kept = F.filter("findings", lambda f: F.exists(F.col("was"), lambda d: F.startswith(d, F.concat(f["kind"], F.lit("@")))
                                                   & F.array_contains(_versioned(rules), d)))
    new = [F.when(F.array_contains("was", f"{r.kind}@{r.version}"), empty).otherwise(_found(F.col("text"), r, n))
           for n, r in enumerate(rules)]
    scanned = work.select("blob", _versioned(rules).alias("done"), F.array_sort(F.concat(kept, *new)).alias("findings"))
    return scanned if rest is None else rest.unionByName(scanned)


def report(versions: DataFrame, ledger: DataFrame, *, keys: tuple[str, ...] = ("vid",)) -> DataFrame:
    """``keys, blob, findings`` for every row of ``versions``, clean ones with an empty list.

    Findings are ordered by start, then by the order of the rules. Repeated rows each get theirs,
    a NULL key is passed on.
    """
    paths = versions.select(*keys, blob_of(F.col("text")).alias("blob"))
    return paths.join(ledger.select("blob", "findings"), "blob", "left").select(
        *keys, "blob", F.coalesce("findings", F.array().cast(FOUND)).alias("findings"))


def redact(versions: DataFrame, ledger: DataFrame, *, mask: str = "[secret]") -> DataFrame:
    """All columns of ``versions``; every found span of ``text`` is replaced by ``mask``.

    Overlapping spans become one mask. A text without findings, NULL included, is left as it is.
    """
    blob, found = "_blob", "_found"
    while {blob, found} & set(versions.columns):  # names that no column has
        blob, found = blob + "_", found + "_"
    rows = versions.withColumn(blob, blob_of(F.col("text"))) \
        .join(ledger.where(F.size("findings") > 0).select(F.col("blob").alias(blob), F.col("findings").alias(found)), blob, "left")
    text = F.col("text")

    def step(acc, f):
        gap = F.substring(text, acc["at"] + 1, F.greatest(f["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], f["end"]).alias("at"),
                        F.when(f["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask)))
                        .otherwise(acc["out"]).alias("out"))
    done = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return rows.withColumn("text", F.when(F.col(found).isNotNull(), done).otherwise(text)).select(*versions.columns)


def span_list(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(
        ":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
