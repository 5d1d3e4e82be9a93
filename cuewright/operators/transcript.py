"""From raw recogniser output to clean, numbered subtitle lines.

Times are whole milliseconds. A line is (vid, id, start_ms, end_ms, text).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as X
from ..plans.blocks import BLOCK, neighbours, positions, running
from ..plans.ranking import ranked
from ..session import Steps, settle

TIME_BUCKET_MS = 600_000


def _same(df: DataFrame) -> DataFrame:
    return df


# ---- chunk planning -----------------------------------------------------------
def pause_points(events: DataFrame) -> DataFrame:
    """Midpoints of pauses: the n-th start goes with the n-th end, if it is later.

    events: vid, level_db, kind ('start' | 'end'), at_ms.
    """
    keys = ("vid", "level_db", "kind")
    numbered = settle(positions(events, "n", ("at_ms",), keys=keys,
                                bucket=F.floor(F.col("at_ms") / TIME_BUCKET_MS)))
    starts = numbered.where("kind = 'start'").select("vid", "level_db", "n", F.col("at_ms").alias("s"))
    ends = numbered.where("kind = 'end'").select("vid", "level_db", "n", F.col("at_ms").alias("e"))
    return starts.join(ends, ["vid", "level_db", "n"]).where("e > s").select(
        "vid", "level_db", F.floor((F.col("s") + F.col("e")) / 2).cast("bigint").alias("at_ms"))


def quiet_points(points: DataFrame) -> DataFrame:
    """Pauses of the strictest level that found any."""
    best = points.groupBy("vid").agg(F.min("level_db").alias("level_db"))
    return points.join(best, ["vid", "level_db"], "left_semi").select("vid", "at_ms")


def plan_chunks(videos: DataFrame, points: DataFrame) -> DataFrame:
    """Chunk starts and lengths of about fifteen minutes, cut at pauses.

    Each target depends on the cut before it, so a video's cuts are one fold. A
    step only looks at pauses within 45 s, so the pauses are kept as a map from
    45 s bucket to the pauses in it and three buckets are read per cut; the map
    is one row per video and holds pauses that can be near a target at all.
    """
    bucket = F.floor(F.col("at_ms") / K.SNAP_MS).cast("bigint")
    # Cut k lies within 45 s * k of 900 s * k; outside those bands no pause matters.
    k = F.floor(F.col("at_ms") / K.CHUNK_MS + F.lit(0.5))
    near = F.abs(F.col("at_ms") - k * K.CHUNK_MS) < K.SNAP_MS * F.greatest(k, F.lit(1))
    grid = points.where(near).groupBy("vid", bucket.alias("b")).agg(
        F.array_sort(F.collect_set("at_ms")).alias("at"))
    maps = grid.groupBy("vid").agg(F.map_from_entries(F.collect_list(F.struct("b", "at"))).alias("pauses"))
    steps = F.sequence(F.lit(1), F.floor(F.col("duration_ms") / (K.CHUNK_MS - K.SNAP_MS)).cast("int") + 1)
    none = F.array().cast("array<bigint>")

    def step(cuts, _):
        target = F.element_at(cuts, -1) + K.CHUNK_MS
        b = F.floor(target / K.SNAP_MS).cast("bigint")
        found = F.concat(*[F.coalesce(F.try_element_at("pauses", b + d), none) for d in (-1, 0, 1)])
        found = F.filter(found, lambda q: F.abs(q - target) < K.SNAP_MS)
        best = F.array_min(F.transform(found, lambda q: X.rec(d=F.abs(q - target), q=q)))
        cut = F.coalesce(best["q"], target)
        return F.when(target < F.col("duration_ms") - K.TAIL_MS, F.concat(cuts, F.array(cut))).otherwise(cuts)

    cuts = F.when(F.col("duration_ms") <= K.CHUNK_MS, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.aggregate(steps, F.array(F.lit(0).cast("bigint")), step))
    planned = videos.select("vid", "duration_ms").join(maps, "vid", "left").select("vid", "duration_ms", cuts.alias("cuts"))
    edges = F.concat("cuts", F.array("duration_ms"))
    return planned.select("vid", F.posexplode("cuts").alias("no", "start_ms"), edges.alias("edges")).select(
        "vid", F.col("no").cast("bigint").alias("chunk"), "start_ms",
        (F.element_at("edges", F.col("no") + 2) - F.col("start_ms")).alias("length_ms"))


def with_lead(chunks: DataFrame) -> DataFrame:
    """Every chunk after the first starts 2.5 s early."""
    lead = F.when(F.col("start_ms") > 50, K.LEAD_MS).otherwise(0).cast("bigint")
    return chunks.withColumn("lead_ms", lead) \
        .withColumn("offset_ms", F.col("start_ms") - F.col("lead_ms")) \
        .withColumn("span_ms", F.col("length_ms") + F.col("lead_ms"))


def split_oversize(chunks: DataFrame, limit: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """Halve chunks until each fits; ``rejected`` marks those whose halves get too short.

    The bitrate is constant, so size follows length and the depth is known at once.
    """
    times = F.ceil(F.col("size_bytes") / F.lit(limit)).cast("bigint")
    depth = F.when(times <= 1, 0).otherwise(F.length(F.bin(times - 1)))
    pieces = F.expr("shiftleft(1L, _depth)")
    rejected = (F.col("_depth") > 0) & (F.col("length_ms") / pieces < K.MIN_CHUNK_MS)
    rows = chunks.withColumn("_depth", depth.cast("int")).withColumn("rejected", rejected) \
        .withColumn("_n", F.when(F.col("rejected"), F.lit(1).cast("bigint")).otherwise(pieces)) \
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    lo = F.floor(F.col("length_ms") * F.col("part") / F.col("_n")).cast("bigint")
    hi = F.floor(F.col("length_ms") * (F.col("part") + 1) / F.col("_n")).cast("bigint")
    return rows.withColumn("start_ms", F.col("start_ms") + lo).withColumn("length_ms", hi - lo).drop("_depth", "_n")


def _seconds3(ms: Column) -> Column:
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def chunk_key(model: Column, language: Column, offset_ms: Column, span_ms: Column) -> Column:
    return X.digest(model, language, _seconds3(offset_ms), _seconds3(span_ms))


def pending_chunks(planned: DataFrame, parts: DataFrame) -> DataFrame:
    """Planned chunks without a cached result under the same key."""
    return planned.join(parts.select("chunk_key").distinct(), "chunk_key", "left_anti")


# ---- raw lines ------------------------------------------------------------------
def globalise(raw: DataFrame) -> DataFrame:
    """Chunk-relative times to whole-file times."""
    offset = F.col("chunk_ms") - F.col("lead_ms")
    return raw.withColumn("start_ms", F.col("rel_start_ms") + offset) \
        .withColumn("end_ms", F.col("rel_end_ms") + offset).drop("rel_start_ms", "rel_end_ms")


def drop_lead_dupes(raw: DataFrame) -> DataFrame:
    """Drop lines whose midpoint lies in the lead-in: the chunk before heard them."""
    dupe = (F.col("lead_ms") > 0) & (F.col("start_ms") + F.col("end_ms") < F.col("chunk_ms") * 2)
    return raw.where(~dupe)


def vote_language(chunks: DataFrame, requested: str | None = None) -> DataFrame:
    """One vote per chunk; a tie goes to the language heard first."""
    heard = chunks.where(F.coalesce(F.trim("language"), F.lit("")) != "").groupBy(
        "vid", F.lower(F.trim("language")).alias("language")).agg(
        F.count("*").alias("votes"), F.min("chunk").alias("first"))
    won = heard.groupBy("vid").agg(
        F.max_by("language", F.struct(F.col("votes"), -F.col("first"))).alias("language"))
    everyone = chunks.select("vid").distinct()
    return everyone.join(won, "vid", "left").select(
        "vid", language_code(F.coalesce("language", F.lit(requested or ""))).alias("language"))


def language_code(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.LANGUAGE_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), name)


# ---- collapsed lines ----------------------------------------------------------------
def fragment_ratio(text: Column) -> Column:
    w = X.words(text)
    short = F.size(F.filter(w, lambda x: F.length(x) <= 2))
    return F.when(F.size(w) < K.COLLAPSED_MIN_WORDS, F.lit(0.0)).otherwise(short / F.size(w))


def is_collapsed(span_ms: int = K.COLLAPSED_MS, ratio: float = K.COLLAPSED_RATIO) -> Column:
    return (F.col("end_ms") - F.col("start_ms") >= span_ms) & (fragment_ratio(F.col("text")) > ratio)


def repair_plan(lines: DataFrame, limit: int = K.MAX_REPAIRS, **limits) -> DataFrame:
    """Spans to hear again: the first ``limit`` collapsed lines of each video."""
    from pyspark.sql import Window

    w = Window.partitionBy("vid").orderBy("start_ms", "seq")
    first = lines.where(is_collapsed(**limits)).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return first.select(
        "vid", "seq", F.col("n").cast("bigint").alias("n"),
        F.greatest(F.lit(0).cast("bigint"), F.col("start_ms") - K.REPAIR_LEAD_MS).alias("offset_ms"),
        (F.col("end_ms") - F.col("start_ms") + K.REPAIR_PAD_MS).alias("span_ms"))


def apply_repairs(lines: DataFrame, fixes: DataFrame, *, legacy_drop: bool = False,
                  limit: int = K.MAX_REPAIRS, **limits) -> DataFrame:
    """Replace collapsed lines by what was recovered; keep them where nothing was.

    lines: vid, seq, start_ms, end_ms, text, ...; fixes: vid, seq (of the broken
    line), part, start_ms, end_ms, text. With ``legacy_drop`` collapsed lines past
    the first ``limit`` disappear, as they once did.
    """
    flagged = lines.withColumn("_bad", is_collapsed(**limits))
    good = flagged.where(~F.col("_bad")).drop("_bad").withColumn("part", F.lit(0).cast("bigint"))
    broken = flagged.where("_bad").drop("_bad")
    if legacy_drop:
        broken = broken.join(repair_plan(lines, limit, **limits).select("vid", "seq"), ["vid", "seq"], "left_semi")
    new = fixes.where(X.strip(F.col("text")) != "").select(
        "vid", "seq", "part", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"), F.col("text").alias("_t"))
    mended = broken.join(new, ["vid", "seq"], "left") \
        .withColumn("start_ms", F.coalesce("_s", "start_ms")).withColumn("end_ms", F.coalesce("_e", "end_ms")) \
        .withColumn("text", F.coalesce(X.strip(F.col("_t")), F.col("text"))) \
        .withColumn("part", F.coalesce("part", F.lit(0).cast("bigint"))).drop("_s", "_e", "_t")
    return good.unionByName(mended)


# ---- cleaning -------------------------------------------------------------------------
def _flat(text: Column) -> Column:
    return F.regexp_replace(text, f"[{K.WHITESPACE_CLASS}{K.ARTEFACT_CLASS}]", "")


def drop_artefacts(lines: DataFrame) -> DataFrame:
    """Drop known filler, empty lines, and one character repeated over a whole line."""
    ignored = K.WHITESPACE + K.ARTEFACT_CLASS
    fillers = ["".join(c for c in line if c not in ignored) for line in K.FILLER_LINES]

    def spoken(flat):
        repeated = (F.length(flat) > 6) & (F.replace(flat, F.substring(flat, 1, 1), F.lit("")) == "")
        return (flat != "") & ~repeated & ~flat.isin(*fillers)

    return lines.where(X.let(_flat(F.col("text")), spoken)).withColumn("text", X.strip(F.col("text")))


def fix_overlaps(lines: DataFrame, pos: str = "id", block: int = BLOCK, steps: Steps | None = None) -> DataFrame:
    """Clamp to the video, keep 0.2 s at least, and push starts past the line before.

    The pushed end of a line is its own end, or the end before it plus 0.4 s, so
    an upper bound of it is a running maximum. Where that bound is too low to
    reach a line, the line's end is settled without looking back; only runs of
    lines that do overlap that deeply are folded, and runs longer than ``block``
    lines block by block (``_push_long``).
    lines: vid, <pos> dense by start, start_ms, end_ms, duration_ms, ... With ``steps``, whose last one is
    ``lines``, rows are also written between two shuffles, and what is read no more is removed.
    """
    settled_rows, keep, last = (steps.last, steps.keep, steps.last) if steps else (settle, settle, _same)
    zero = F.lit(0).cast("bigint")
    s = F.greatest(zero, F.least("start_ms", "duration_ms"))
    clamped = lines.withColumn("_s", s).withColumn(
        "_e", F.greatest(F.col("_s") + 200, F.least("end_ms", "duration_ms")))
    bound = running(clamped, {"_m": ("max", F.col("_e") - F.col(pos) * 400)}, order=(pos,))
    settled = F.col("_m").isNull() | (F.col("_m") + (F.col(pos) - 1) * 400 < _threshold(F.col("_s"), F.col("_e")))
    marked = neighbours(
        last(bound.withColumn("_settled", settled)),
        lambda w: {"_prev_ok": F.lag("_settled").over(w), "_prev_e": F.lag("_e").over(w)}, pos=pos)
    # A line after a settled one only needs that line's own end.
    marked = settled_rows(marked.withColumn("_easy", F.coalesce("_prev_ok", F.lit(True)))
                          .withColumn("_at", F.when(F.col("_easy"), F.col(pos))))
    start = F.greatest("_s", "_prev_e")
    direct = F.col("_easy") & F.col("_settled")
    others = [c for c in lines.columns if c not in ("start_ms", "end_ms")]
    plain = marked.where(direct).select(
        *others, start.alias("start_ms"),
        F.when((start > F.col("_s")) & (F.col("_e") <= start + 150), start + 400)
        .otherwise(F.col("_e")).alias("end_ms"))

    item = X.rec(i=F.col(pos), s=F.col("_s"), e=F.col("_e"), row=F.struct(*others))
    runs = keep(running(marked, {"_run": ("max", F.col("_at"))}, order=(pos,)).where(~direct).select(
        "vid", F.coalesce("_at", "_run").alias("_run"), F.when(F.col("_easy"), F.col("_prev_e")).alias("_seed"), item.alias("x")))
    long_runs = runs.groupBy("vid", "_run").agg(F.count("*").alias("n")).where(F.col("n") > block).select("vid", "_run")
    short = runs.join(long_runs, ["vid", "_run"], "left_anti").groupBy("vid", "_run").agg(
        F.sort_array(F.collect_list("x")).alias("xs"), F.max("_seed").alias("_seed"))
    pushed = short.select(F.explode(_pushed(F.col("xs"), F.col("_seed"))).alias("r")).unionByName(
        _push_long(runs.join(long_runs, ["vid", "_run"], "left_semi"), block, steps))
    return plain.unionByName(pushed.select("r.row.*", F.col("r.s").alias("start_ms"), F.col("r.e").alias("end_ms")))


def _threshold(s: Column, e: Column) -> Column:
    """Ends before this leave a line's own end alone; later ones push it."""
    return F.greatest(s + 1, e - 150)


def _push(p: Column, x: Column) -> Column:
    """End of a line after an end at ``p`` (NULL: nothing before it)."""
    return F.when(p >= _threshold(x["s"], x["e"]), p + 400).otherwise(x["e"])


def _pushed(xs: Column, seed: Column) -> Column:
    """Sorted lines (i, s, e, row) with starts and ends settled one after another."""
    none = F.slice(F.transform(xs, lambda x: X.rec(s=x["s"], e=x["e"])), 1, 0)
    times = F.aggregate(xs, X.rec(p=seed, out=none), lambda acc, x: X.rec(
        p=_push(acc["p"], x), out=F.concat(acc["out"], F.array(X.rec(s=F.greatest(x["s"], acc["p"]), e=_push(acc["p"], x))))),
        lambda acc: acc["out"])
    return F.zip_with(xs, times, lambda x, t: X.rec(row=x["row"], s=t["s"], e=t["e"]))


def _push_long(runs: DataFrame, block: int, steps: Steps | None = None) -> DataFrame:
    """The same for very long runs, without a run ever being in one task.

    A block takes an incoming end p to an outgoing one. Line k of it keeps its own
    end iff p + 400 k is below its threshold, and from there on p is forgotten. So
    a block is described by the few lines whose threshold less 400 k is a new
    maximum, each with the end it leads to; past all of them p grows by 400 a line.
    """
    by = F.floor(F.col("x.i") / block).cast("bigint")
    keep = steps.keep if steps else settle
    blocks = keep(runs.groupBy("vid", "_run", by.alias("_blk")).agg(
        F.sort_array(F.collect_list("x")).alias("xs"), F.max("_seed").alias("_seed")))
    depth = F.transform("xs", lambda x, k: X.rec(k=k, d=_threshold(x["s"], x["e"]) - k * 400))
    nothing = F.slice(depth, 1, 0)
    records = F.aggregate(depth, nothing, lambda acc, r: F.when(
        (F.size(acc) == 0) | (r["d"] > F.element_at(acc, -1)["d"]), F.concat(acc, F.array(r))).otherwise(acc))
    leads = F.transform(records, lambda r: X.rec(d=r["d"], out=F.aggregate(
        F.slice("xs", r["k"] + 2, F.size("xs")), F.get("xs", r["k"])["e"], _push)))
    chain = blocks.select("vid", "_run", "_seed", X.rec(b=F.col("_blk"), n=F.size("xs"), leads=leads).alias("b")) \
        .groupBy("vid", "_run").agg(F.sort_array(F.collect_list("b")).alias("bs"), F.max("_seed").alias("_seed"))

    def follow(done, b):
        p = F.element_at(done, -1)["out"]
        lead = F.get(F.filter(b["leads"], lambda r: p.isNull() | (r["d"] > p)), F.lit(0))
        return F.concat(done, F.array(X.rec(b=b["b"], p=p, out=F.coalesce(lead["out"], p + b["n"] * 400))))

    first = F.array(X.rec(b=F.lit(-1).cast("bigint"), p=F.col("_seed"), out=F.col("_seed")))
    ends = chain.select("vid", "_run", F.explode(F.aggregate("bs", first, follow)).alias("w")) \
        .select("vid", "_run", F.col("w.b").alias("_blk"), F.col("w.p").alias("_p"))
    return blocks.join(ends, ["vid", "_run", "_blk"]).select(F.explode(_pushed(F.col("xs"), F.col("_p"))).alias("r"))


# ---- splitting --------------------------------------------------------------------------
def split_pieces(text: Column, span_ms: Column) -> Column:
    """Pieces (part, a, b) of an over-long line as character ranges.

    Near each even point the strongest break wins, then the closest one.
    """
    size = X.rec(n=F.length(text), parts=(F.floor(span_ms / K.MERGE_SPAN_MS) + 1).cast("int"))
    return X.let(size, lambda of: _pieces_of(text, of["n"], of["parts"]))


def _pieces_of(text: Column, n: Column, parts: Column) -> Column:
    """Every value that the next step uses more than once is bound by a ``let``, so none is computed twice."""
    def cut(k, reach):
        want = F.floor(k * (n / parts)).cast("int")
        edges = lambda w: X.rec(want=w, lo=F.greatest(F.lit(1), w - reach), hi=F.least(n - 1, w + reach))
        return X.let(X.let(want, edges), beside)

    def beside(at):
        # places left of the point end before ``near``, those from it on start at ``far``
        near, far = F.least(at["want"], at["hi"]), F.greatest(at["want"], at["lo"])
        return X.let(X.rec(want=at["want"], lo=at["lo"], far=far, left=F.substr(text, at["lo"] + 1, F.greatest(F.lit(0), near - at["lo"])),
                           right=F.substr(text, far + 1, F.greatest(F.lit(0), at["hi"] - far))), strongest)

    def strongest(side):
        def closest(group):
            before = side["lo"] + F.length(F.regexp_extract(side["left"], rf"(?s)^.*[{group}]", 0)) - 1
            after = side["far"] + F.length(F.regexp_extract(side["right"], rf"^[^{group}]*[{group}]", 0)) - 1
            return X.let(X.rec(b=before, a=after), lambda at: F.when(
                (at["b"] >= side["lo"]) & ((at["a"] < side["far"]) | (side["want"] - at["b"] <= at["a"] - side["want"])), at["b"])
                .when(at["a"] >= side["far"], at["a"]))
        return F.coalesce(F.coalesce(*[closest(g) for g in (K.BREAK_SENTENCE, K.BREAK_CLAUSE, K.BREAK_SPACE)]) + 1, side["want"])

    reach = F.greatest(F.lit(2), F.floor(n / (parts * 5)).cast("int"))
    cuts = X.let(reach, lambda r: F.transform(F.sequence(F.lit(1), parts - 1), lambda k: cut(k, r)))
    cuts = F.filter(cuts, lambda c: (c > 0) & (c < n))
    bounds = F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0)), cuts, F.array(n))))
    ranges = X.let(bounds, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: X.rec(
        part=i, a=F.get(b, i), b=F.get(b, i + 1))))
    return F.when((parts < 2) | (n < 8), F.array(X.rec(part=F.lit(0), a=F.lit(0), b=n))).otherwise(ranges)


def split_long(lines: DataFrame) -> DataFrame:
    """Break lines of seven seconds or more; time follows the characters.

    Adds ``part`` (0-based); pieces that are blank are left out.
    """
    span = F.col("end_ms") - F.col("start_ms")
    n = F.length("text")
    whole = (F.floor(span / K.MERGE_SPAN_MS) < 1) | (n < 8)
    cut = lines.withColumn("_p", F.explode(split_pieces(F.col("text"), span)))
    a, b = F.col("_p.a"), F.col("_p.b")

    def place(c):
        return (X.half_up((F.col("start_ms") + span * (c / n)) / 10) * 10).cast("bigint")

    out = cut.select(
        *[c for c in lines.columns if c not in ("start_ms", "end_ms", "text")],
        F.col("_p.part").cast("bigint").alias("part"),
        F.when(whole, F.col("start_ms")).otherwise(place(a)).alias("start_ms"),
        F.when(whole, F.col("end_ms")).otherwise(place(b)).alias("end_ms"),
        F.when(whole, F.col("text")).otherwise(X.strip(F.substr("text", a + 1, b - a))).alias("text"))
    return out.where(F.col("text") != "")


# ---- merging ------------------------------------------------------------------------------
def sentence_final(text: Column) -> Column:
    return text.rlike(f"[。！？!?…][{K.WHITESPACE_CLASS}]*$")


def _joined(done, x):
    """Fold step over lines: extend the last group or open a new one."""
    last = F.element_at(done, -1)
    joins = ((x["s"] - last["e"] <= K.MERGE_GAP_MS) & (x["e"] - last["s"] <= K.MERGE_SPAN_MS)
             & (F.length(last["t"]) + F.length(x["t"]) <= K.MERGE_CHARS) & ~sentence_final(last["t"]))
    glue = F.when(X.has_cjk(last["t"]) | X.has_cjk(x["t"]), "").otherwise(" ")
    longer = X.rec(i=last["i"], s=last["s"], e=x["e"], t=F.concat(last["t"], glue, x["t"]))
    return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))


def _groups(xs: Column) -> Column:
    """Greedy groups of a sorted array of lines, the first line opening the first group."""
    return F.when(F.size(xs) <= 1, xs).otherwise(F.aggregate(F.slice(xs, F.lit(2), F.size(xs)), F.slice(xs, 1, 1), _joined))


def merge_lines(lines: DataFrame, carry: tuple[str, ...] = (), block: int = BLOCK, steps: Steps | None = None) -> DataFrame:
    """Join short neighbours into sentence-sized lines; ``id`` is that of the first.

    Whether a line may join depends on everything joined before it, but several
    reasons not to join are visible from two neighbours alone. Those hard breaks
    cut a video into runs, and a run is one fold. Runs longer than ``block`` lines
    are folded block by block (``_merge_long``).
    lines: vid, id dense by start, start_ms, end_ms, text. With ``steps``, whose last one is ``lines``, rows are also written
    between two shuffles, and what is read no more is removed; nothing can be carried then.
    """
    if steps and carry:
        raise ValueError("steps that are removed carry nothing")
    last = steps.last if steps else _same
    seen = neighbours(lines.select("vid", "id", "start_ms", "end_ms", "text"), lambda w: {
        "_ps": F.lag("start_ms").over(w), "_pe": F.lag("end_ms").over(w), "_pt": F.lag("text").over(w)})
    hard = (F.col("_ps").isNull() | (F.col("start_ms") - F.col("_pe") > K.MERGE_GAP_MS)
            | (F.col("end_ms") - F.col("_ps") > K.MERGE_SPAN_MS)
            | (F.length("_pt") + F.length("text") > K.MERGE_CHARS) | sentence_final(F.col("_pt")))
    starts = last(seen.withColumn("_at", F.when(hard, F.col("id"))).drop("_ps", "_pe", "_pt"))
    item = X.rec(i=F.col("id"), s=F.col("start_ms"), e=F.col("end_ms"), t=F.col("text"))
    runs = (steps.last if steps else settle)(running(starts, {"_run": ("max", F.col("_at"))}).select(
        "vid", F.coalesce("_at", "_run").alias("_run"), item.alias("x")))
    long_runs = runs.groupBy("vid", "_run").agg(F.count("*").alias("n")).where(F.col("n") > block).select("vid", "_run")
    short = runs.join(long_runs, ["vid", "_run"], "left_anti").groupBy("vid", "_run").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    merged = short.select("vid", F.explode(_groups(F.col("xs"))).alias("r")) \
        .unionByName(_merge_long(runs.join(long_runs, ["vid", "_run"], "left_semi"), block, steps))
    out = merged.select("vid", F.col("r.i").alias("id"), F.col("r.s").alias("start_ms"), F.col("r.e").alias("end_ms"), F.col("r.t").alias("text"))
    return out.join(lines.select("vid", "id", *carry), ["vid", "id"]) if carry else out


def _merge_long(runs: DataFrame, block: int, steps: Steps | None = None) -> DataFrame:
    """Greedy groups of very long runs, without a run ever being in one task.

    A group has at most 44 characters, so at most 44 lines: the first group that
    starts in a block starts within its first 45 lines. For each of those entries
    a block tells where the first group of the next block would start; chaining
    these few numbers from block to block gives every block its true entry.
    """
    reach = K.MERGE_CHARS
    pos, own = F.col("x.i"), F.floor(F.col("x.i") / block).cast("bigint")
    homes = F.array_compact(F.array(own, F.when((pos % block < reach) & (own > 0), own - 1)))
    keep = steps.keep if steps else settle
    blocks = keep(runs.withColumn("_blk", F.explode(homes)).groupBy("vid", "_run", "_blk")
                  .agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.get("xs", F.lit(0))["i"] < (F.col("_blk") + 1) * block))
    end = (F.col("_blk") + 1) * block
    first = F.get("xs", F.lit(0))["i"]
    entries = F.when(first == F.col("_run"), F.array(first)).otherwise(F.sequence(first, first + reach))
    after = lambda e: F.get(F.filter(_groups(F.filter("xs", lambda x: x["i"] >= e)), lambda g: g["i"] >= end), F.lit(0))["i"]
    exits = blocks.select("vid", "_run", "_blk", F.transform(entries, lambda e: X.rec(entry=e, exit=after(e))).alias("ways"))
    chain = exits.groupBy("vid", "_run").agg(F.sort_array(F.collect_list(X.rec(b=F.col("_blk"), ways=F.col("ways")))).alias("bs"))
    shape = "array<struct<b:bigint,entry:bigint,exit:bigint>>"

    def follow(done, b):
        at = F.coalesce(F.element_at(done, -1)["exit"], F.col("_run"))
        way = F.get(F.filter(b["ways"], lambda w: w["entry"] == at), F.lit(0))
        return F.concat(done, F.array(X.rec(b=b["b"], entry=at, exit=way["exit"])))

    seed = F.array(X.rec(b=F.lit(-1).cast("bigint"), entry=F.col("_run"), exit=F.col("_run"))).cast(shape)
    found = chain.select("vid", "_run", F.explode(F.aggregate("bs", seed, follow)).alias("w")) \
        .select("vid", "_run", F.col("w.b").alias("_blk"), F.col("w.entry").alias("_in"), F.col("w.exit").alias("_out"))
    inside = F.filter("xs", lambda x: (x["i"] >= F.col("_in")) & (F.col("_out").isNull() | (x["i"] < F.col("_out"))))
    return blocks.join(found, ["vid", "_run", "_blk"]).select("vid", F.explode(_groups(inside)).alias("r"))


def renumber(lines: DataFrame, order: tuple[str, ...] = ("start_ms", "seq"), name: str = "id",
             steps: Steps | None = None) -> DataFrame:
    """Number lines 0..n-1 by start, by sample sort; ``order`` must leave no ties. With ``steps``, their last one is ``lines``."""
    return ranked(lines.drop(name), name, order, keep=steps.last if steps else settle)



def assemble(raw: DataFrame, fixes: DataFrame | None = None, **repair) -> DataFrame:
    """Raw recogniser lines to final transcript lines.

    raw: vid, chunk, chunk_ms, lead_ms, seq, rel_start_ms, rel_end_ms, text,
    duration_ms. Splitting comes before merging, so a split that was not needed
    is healed by the merge.
    """
    heard = drop_lead_dupes(globalise(raw)).where(X.strip(F.col("text")) != "")
    heard = heard.select("vid", "seq", "start_ms", "end_ms", X.strip(F.col("text")).alias("text"), "duration_ms")
    if fixes is not None:
        heard = apply_repairs(heard, fixes, **repair)
    else:
        heard = heard.withColumn("part", F.lit(0).cast("bigint"))
    steps = Steps(raw.sparkSession)
    cleaned = steps.last(drop_artefacts(heard))
    ranked = steps.last(renumber(cleaned, ("start_ms", "seq", "part"), steps=steps).select("vid", "id", "start_ms", "end_ms", "text", "duration_ms"))
    clean = fix_overlaps(ranked, steps=steps)
    pieces = steps.last(split_long(clean.withColumnRenamed("id", "seq").drop("duration_ms")))
    numbered = steps.last(renumber(pieces, ("start_ms", "seq", "part"), steps=steps).select("vid", "id", "start_ms", "end_ms", "text"))
    merged = steps.last(merge_lines(numbered, steps=steps).withColumnRenamed("id", "seq"))
    return renumber(merged, ("start_ms", "seq"), steps=steps).select("vid", "id", "start_ms", "end_ms", "text")
