"""Cases that once went wrong: stray ids, silent stretches, cleared fields, a second day, long transcripts."""
import hashlib

from pyspark.sql import functions as F

from cuewright.operators import audit as Q
from cuewright.operators import batching as B
from cuewright.operators import library as L
from cuewright.operators import replies as R
from cuewright.operators import signal as M
from cuewright.operators import timing as D


def lines(spark, n):
    return spark.range(n).select(F.lit("v").alias("vid"), "id", (F.col("id") * 2000).alias("start_ms"), (F.col("id") * 2000 + 1500).alias("end_ms"),
                                 F.lit("a line of some length").alias("text"), F.lit("").alias("en"))


def test_a_stray_id_of_another_batch_is_not_taken(spark):
    parsed = spark.createDataFrame([("v", 0, 1, "one"), ("v", 1, 1, "stray"), ("v", 1, 31, "thirty-one")], "vid string, batch long, id long, en string")
    answered = parsed.select("vid", "batch").distinct()
    got = {r["id"]: r["en"] for r in R.apply_reply(lines(spark, 40), parsed, answered).collect()}
    assert len(got) == 40 and got[1] == "one" and got[31] == "thirty-one" and got[2] == ""
    assert R.apply_reply(lines(spark, 40), parsed, answered).count() == 40
    blank = spark.createDataFrame([("v", 0, i, "" if i == 3 else "x") for i in range(30)] + [("v", 1, 3, "")], "vid string, batch long, id long, en string")
    assert [(r["id"], r["batch"]) for r in B.blank_real_lines(lines(spark, 30), blank).collect()] == [(3, 0)]
    assert B.missing_lines(lines(spark, 40), parsed).count() == 38


def test_several_edits_of_a_line_leave_one_row(spark):
    edits = spark.createDataFrame([("v", 1, "first", 1), ("v", 1, "second", 2)], "vid string, id long, en string, at long")
    got = R.apply_edits(lines(spark, 3), edits).orderBy("id").collect()
    assert [(r["en"], r["changed"]) for r in got] == [("", False), ("second", True), ("", False)]


def test_rewrites_of_two_groups_do_not_multiply_a_line(spark):
    base = lines(spark, 2).withColumn("en", F.lit("worse text that if"))
    faults = base.withColumn("faults", F.array(F.lit("unfinished"), F.lit("pov")))
    fixes = spark.createDataFrame([("v", 0, 1, "A line of text."), ("v", 7, 1, "Stray.")], "vid string, batch long, id long, new string")
    told = spark.createDataFrame([("v", False)], "vid string, narrated boolean")
    got = Q.accept_repairs(base, faults, fixes, told).orderBy("id").collect()
    assert [r["en"] for r in got] == ["worse text that if", "A line of text."]


def test_a_mix_has_its_silent_blocks_and_starts_at_zero(spark):
    clips = spark.createDataFrame([("v", -2, [0.5] * 3), ("v", 20, [1.0] * 2)], "vid string, start_sample long, samples array<double>")
    got = M.mix_timeline(clips, 4).orderBy("block").collect()
    assert [r["block"] for r in got] == list(range(6)) and got[0]["samples"] == [.5, .5, .5, 0] and got[5]["samples"] == [1, 1, 0, 0]
    tracks = spark.createDataFrame([("v", 21), ("w", 5)], "vid string, length long")
    cut = {(r["vid"], r["block"]): r["samples"] for r in M.mix_timeline(clips, 4, tracks).collect()}
    assert len(cut) == 8 and cut["v", 5] == [1, 0, 0, 0] and cut["w", 1] == [0] * 4


def test_a_field_can_be_cleared(spark):
    videos = spark.createDataFrame([("a", "boom", 1), ("b", "boom", 1)], "vid string, error string, updated_at long")
    patch = spark.createDataFrame([("a", None, ["error"]), ("b", None, None)], "vid string, error string, set_fields array<string>")
    got = {r["vid"]: r["error"] for r in L.update_videos(videos, patch, 2).collect()}
    assert got == {"a": None, "b": "boom"}


def test_a_refusal_for_the_day_ends_with_the_day(spark):
    day = 86_400
    log = [(1, 10, "k", "m", 429, None, None, "tokens per day, try again in 5m"), (2, 2 * day, "k", "m", 200, 50, "1m0s", ""),
           (3, 2 * day + 5, "k", "n", 429, None, None, "tokens per day, try again in 5m")]
    df = spark.createDataFrame(log, "event_id long, ts_s long, key_id string, model string, http_status long, remaining long, reset_after string, message string")
    got = {r["model"]: r["exhausted"] for r in B.bucket_state(df).collect()}
    assert got["m"] is None and got["n"] is not None


def test_stamp_has_one_rule_for_every_length(spark):
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()[:16]
    for n in (10, 4096, 5000):
        rows = [f"{i}:{i * 2000}:" for i in range(n)]
        blocks = [sha("\x1f".join(rows[i:i + 4096])) for i in range(0, n, 4096)]
        assert D.dub_stamp(lines(spark, n), ["x"]).first()["stamp"] == sha("x|" + sha("\x1f".join(blocks)))


def test_a_line_is_cleaned_for_speech_once(spark):
    """The filter on the spoken text is not pushed below it, where the text would be cleaned again."""
    from cuewright.operators import timing

    texts = ["  ... a  b\tc\n", "plain words, one space", "Ça — va…  déjà", "", " \t ", None, "…", "a\x1fb  c"]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "vid long, id long, en string")
    done = spark.createDataFrame([], "vid long, id long, fingerprint string, size_bytes long")
    out = timing.to_render(lines, done)
    assert {r.id: r.spoken for r in out.collect()} == {0: "a b c", 1: "plain words, one space", 2: "Ca - va deja", 7: "a b c"}
    assert {(r.id, r.fingerprint) for r in out.collect()} == {(r.id, r.fingerprint) for r in timing.with_fingerprint(lines).where("spoken <> ''").collect()}
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("trim(") == 1
