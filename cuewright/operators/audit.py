"""Which finished lines look wrong, and which rewrites are worth keeping."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..plans.blocks import BLOCK, in_blocks, positions
from ..session import settle
from .timing import ordered_text

# Fault codes, in the order in which they are reported.
FAULTS = ("gender_clash", "second_person", "unfinished", "source_script", "too_long", "dropped")
NARRATOR_SOURCE = {"zh": ("你", "他|她")}


def _en() -> Column:
    return X.strip(F.coalesce("en", F.lit("")))


def _stepped(rows: DataFrame, size: int) -> DataFrame:
    """Rows in their blocks with ``_odds`` (odd lines before, in the block), ``_since`` (those before the last even one)
    and, where the rows have ``en``, the ``_next`` line's."""
    spread, own, w = in_blocks(rows, before=0, after=1, size=size)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    more = {"_next": F.lead(F.coalesce("en", F.lit(""))).over(w)} if "en" in rows.columns else {}
    seen = spread.withColumns({**more, "_odds": F.coalesce(F.sum(F.col("_odd").cast("bigint")).over(past), F.lit(0))})
    return seen.withColumn("_since", F.max(F.when(F.col("_even"), F.col("_odds"))).over(past)).where(F.col("_blk") == own)


def _with_quotes(lines: DataFrame, scope: Column, size: int, *columns: str) -> DataFrame:
    """``columns`` of lines (all) with ``_next`` and ``_in``: does a quotation reach in?

    A non-blank line with an odd number of marks opens a quotation unless one reached in; any other
    line leaves none. So a line's step is one of two tables over the states (closed, open): even lines
    send both to closed, odd ones swap them. Chained over a block they give the block's own table,
    which is constant if it has an even line and else a swap or nothing; a state is then the parity
    of the odd lines since the last constant. Lines outside ``scope`` leave the state alone.
    """
    en = _en()
    marked = X.quote_marks(en) % 2 == 1
    rows = lines.withColumns({"_odd": scope & (en != "") & marked, "_even": scope & (en != "") & ~marked})
    rows = rows.select(*columns, "_odd", "_even") if columns else rows
    blocks = _stepped(rows.select("vid", "id", "_odd", "_even"), size).groupBy("vid", "_blk").agg(
        F.max(F.col("_odds") + F.col("_odd").cast("bigint")).alias("odds"), F.max(F.when(F.col("_even"), F.col("_odds"))).alias("since"))
    before = Window.partitionBy("vid").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_sum", F.coalesce(F.sum(F.col("odds") - F.coalesce("since", F.lit(0))).over(before), F.lit(0)))
    entry = F.col("_sum") - F.coalesce(F.max(F.when(F.col("since").isNotNull(), F.col("_sum"))).over(before), F.lit(0))
    seen = _stepped(rows, size).join(blocks.select("vid", "_blk", entry.alias("_entry")), ["vid", "_blk"])
    steps = F.when(F.col("_since").isNull(), F.col("_odds") + F.col("_entry")).otherwise(F.col("_odds") - F.col("_since"))
    return seen.withColumn("_in", (F.col("_odd") | F.col("_even")) & (steps % 2 == 1)).drop("_blk", "_odds", "_since", "_entry")


def quote_carry(lines: DataFrame, *, size: int = BLOCK) -> DataFrame:
    """(vid, id, inside) of non-blank lines: does a quotation reach in from before?

    A line with an odd number of marks flips the state, and an open quotation is
    honoured for one line only. Ids are dense within the video.
    """
    return _with_quotes(lines, F.lit(True), size, "vid", "id").where("_odd OR _even").select("vid", "id", F.col("_in").alias("inside"))


def continues(en: Column, following: Column) -> Column:
    """Does the next subtitle carry this one's sentence on? NULL following: no next."""
    nxt = X.strip(following)
    c = X.first_char(nxt)
    picked_up = (nxt != "") & (((F.lower(c) == c) & (F.upper(c) != c)) | c.isin(*'.,…"”'))
    return following.isNotNull() & ((X.quote_marks(en) % 2 == 1) | picked_up)


def is_narrated(lines: DataFrame, charts: DataFrame | None = None, markers: dict | None = None) -> DataFrame:
    """(vid, narrated): is the video told at its main character as 'you'?

    A chart that names a narrator settles it; else the share of source lines
    with the second-person pronoun of the language does. lines need ``lang``.
    """
    markers = NARRATOR_SOURCE if markers is None else markers
    text = F.coalesce("text", F.lit(""))
    you, them = F.lit(False), F.lit(False)
    for lang, (second, third) in markers.items():
        you = F.when(F.col("lang") == lang, text.rlike(second)).otherwise(you)
        them = F.when(F.col("lang") == lang, text.rlike(third)).otherwise(them)
    spoken = X.strip(text) != ""
    counts = lines.groupBy("vid").agg(
        F.count_if(spoken).alias("n"), F.count_if(spoken & you).alias("you"), F.count_if(spoken & them).alias("them"))
    shown = (F.col("n") >= K.NARRATED_MIN_LINES) & (F.col("you") / F.col("n") >= F.lit(K.NARRATED_SHARE)) \
        & (F.col("you") >= F.col("them"))
    if charts is None:
        return counts.select("vid", shown.alias("narrated"))
    said = F.lit(False)
    for marker in K.NARRATED_MARKERS:
        said = said | F.contains("chart", F.lit(marker))
    return counts.join(charts.select("vid", said.alias("_said")), "vid", "left") \
        .select("vid", (F.coalesce("_said", F.lit(False)) | shown).alias("narrated"))


def line_faults(en: Column, source: Column, budget: Column, inside: Column, carried_on: Column, narrated: Column) -> Column:
    """Fault codes of one stripped line; empty when it is fine or blank. The texts are stripped once, not once a fault."""
    return X.let(X.rec(en=en, source=source, budget=budget), lambda line: _faults_of(
        line["en"], line["source"], line["budget"], inside, carried_on, narrated))


def _faults_of(en: Column, source: Column, budget: Column, inside: Column, carried_on: Column, narrated: Column) -> Column:
    narration = X.narration_of(en, inside)
    too_long = X.over_budget(en, budget)
    found = (X.clash(en),
             narrated & X.second_person(narration) & ~en.endswith("?"),
             X.dangling(en) & ~carried_on,
             X.source_left(en),
             too_long,
             ~too_long & X.dropped_content(en, source, budget))
    codes = F.array_compact(F.array(*[F.when(flag, F.lit(code)) for flag, code in zip(found, FAULTS)]))
    return F.when(en == "", F.array().cast("array<string>")).otherwise(codes)


def audit(lines: DataFrame, narrated: DataFrame, window: tuple[int, int] | None = None, *,
          every: bool = False, size: int = BLOCK) -> DataFrame:
    """Faulty lines with ``faults``. A window restarts the quotation state at its first line.

    ``every``: all lines, fine ones with an empty list, and the video's ``narrated`` (what ``accept_repairs`` takes).
    """
    scope = F.lit(True) if window is None else F.col("id").between(window[0], window[1] - 1)
    seen = _with_quotes(lines, scope, size).where(scope).join(narrated, "vid", "left") \
        .withColumn("narrated", F.coalesce("narrated", F.lit(False)))
    faults = line_faults(_en(), X.strip(F.col("text")), X.budget_chars(F.col("start_ms"), F.col("end_ms")),
                         F.col("_in"), continues(_en(), F.col("_next")), F.col("narrated"))
    if every:
        return seen.withColumn("faults", faults).drop("_next", "_in", "_odd", "_even")
    # Exploding the one non-empty list judges a line once, where a filter would judge it twice.
    found = F.explode(F.filter(F.array(faults), lambda f: F.size(f) > 0))
    return seen.withColumn("faults", found).drop("_next", "_in", "_odd", "_even", "narrated")


def polish_groups(faults: DataFrame) -> DataFrame:
    """Repair groups of twenty faulty lines, by id."""
    return positions(settle(faults), "_n", ("id",)).withColumn("grp", F.floor(F.col("_n") / K.REPAIR_GROUP).cast("bigint")).drop("_n")


def polish_payload(groups: DataFrame, wording: dict[str, str] | None = None) -> DataFrame:
    """One request text per group: id|budget|faults|source|current."""
    wording = wording or {}
    why = F.array_join(F.transform("faults", lambda f: F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for c in FAULTS for x in (c, wording.get(c, c))]), f), f)), "; ")
    row = F.concat_ws("|", F.col("id").cast("string"), X.budget_chars(F.col("start_ms"), F.col("end_ms")).cast("string"),
                      why, F.coalesce("text", F.lit("")), F.col("en"))
    return groups.groupBy("vid", "grp").agg(ordered_text("id", row, "\n").alias("payload"))


def polish_tokens(groups: DataFrame) -> DataFrame:
    chars = F.sum(X.budget_chars(F.col("start_ms"), F.col("end_ms")))
    need = F.greatest(F.lit(400.0), chars / F.lit(3.2) + F.count("*") * 6 + 80) * 2.0
    return groups.groupBy("vid", "grp").agg(F.floor(F.least(F.lit(2600.0), need)).cast("bigint").alias("max_tokens"))


def accept_repairs(lines: DataFrame, faults: DataFrame | None, fixes: DataFrame, narrated: DataFrame | None = None) -> DataFrame:
    """Lines with accepted rewrites applied and ``fixed`` set.

    A rewrite must have strictly fewer faults, judged alone: no neighbours, no
    open quotation. ``faults`` None: the lines come from ``audit(..., every=True)`` and carry their faults.
    fixes: vid, id, new and, if replies of several groups are at hand, batch: then a group's reply
    counts only for the group's own lines. Of a line's rewrites the one with the largest ``seq`` is tried, if
    fixes have that column, else the last in the alphabet.
    """
    if faults is not None:
        own = [c for c in lines.columns if c not in ("faults", "narrated")]
        lines = lines.select(*own).join(faults.select("vid", "id", "faults"), ["vid", "id"], "left").join(narrated, "vid", "left") \
            .withColumns({"faults": F.coalesce("faults", F.array().cast("array<string>")), "narrated": F.coalesce("narrated", F.lit(False))})
    if "batch" in fixes.columns:
        groups = polish_groups(lines.where(F.size("faults") > 0).select("vid", "id"))
        fixes = fixes.join(groups.select("vid", "id", F.col("grp").alias("batch")), ["vid", "batch", "id"])
    fixes = fixes.groupBy("vid", "id").agg((F.max_by("new", "seq") if "seq" in fixes.columns else F.max("new")).alias("_new"))
    new = X.strip(F.col("_new"))
    after = line_faults(new, X.strip(F.col("text")), X.budget_chars(F.col("start_ms"), F.col("end_ms")),
                        F.lit(False), F.lit(False), F.col("narrated"))
    better = (F.size("faults") > 0) & (new != "") & (new != F.col("en")) & (F.size(after) < F.size("faults"))
    return lines.join(fixes, ["vid", "id"], "left").withColumn("_new", F.when(better, new)) \
        .withColumn("fixed", F.col("_new").isNotNull()).withColumn("en", F.coalesce("_new", "en")).drop("_new", "narrated", *(() if faults is None else ("faults",)))


def polish_stats(faults: DataFrame | None, repaired: DataFrame) -> DataFrame:
    """Per video with faults: lines ``checked`` and ``fixed``. ``faults`` None: ``repaired`` carries them."""
    if faults is None:
        return repaired.where(F.size("faults") > 0).groupBy("vid").agg(F.count("*").alias("checked"), F.count_if("fixed").alias("fixed"))
    checked = faults.groupBy("vid").agg(F.count("*").alias("checked"))
    fixed = repaired.where("fixed").groupBy("vid").agg(F.count("*").alias("fixed"))
    return checked.join(fixed, "vid", "left").na.fill(0, ["fixed"])
