"""Steps of a chain leave the disk when the next one is written."""
import os

from pyspark.sql import functions as F

from cuewright.operators import transcript as T
from cuewright.session import Steps, shared_folder


def raw(spark, n):
    """Two videos of n lines; some too long, some that overlap, some fillers."""
    k = F.col("id")
    return spark.range(n).select(
        F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("vid"), F.lit(0).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("chunk_ms"),
        F.lit(0).cast("bigint").alias("lead_ms"), k.alias("seq"), (k * 2000).alias("rel_start_ms"), (k * 2000 + 1000 + k % 4 * 3000).alias("rel_end_ms"),
        F.concat(F.lit("some words, and more "), k.cast("string")).alias("text"), F.lit(n * 2000).cast("bigint").alias("duration_ms"))


def on_disk(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder.removeprefix("file:")) for f in names}


def test_the_assembly_leaves_one_step_behind(spark):
    """Every step holds all lines; before, a checkpoint of each stayed until the driver ended."""
    folder = shared_folder(spark).removeprefix("file:")
    before = set(on_disk(folder))
    out = T.assemble(raw(spark, 3000))
    rows = {(r.vid, r.id): r.text for r in out.collect()}
    assert {v for v, _ in rows} == {1, 2} and sorted(i for v, i in rows if v == 1) == list(range(len(rows) // 2))
    new = {f for f in on_disk(folder) if f not in before and not f.endswith(".crc")}
    assert new and len({os.path.dirname(f) for f in new}) == 1, "only the last step, which the result still reads"


def test_a_step_is_read_until_the_next_is_written(spark):
    steps = Steps(spark)
    a = steps.last(spark.range(10))
    b = steps.keep(a.where("id > 3"))
    assert a.count() == 10 and b.count() == 6
    c = steps.last(b.select((F.col("id") * 2).alias("id")))
    assert [r.id for r in c.orderBy("id").collect()] == [8, 10, 12, 14, 16, 18] and len(steps.steps) == 1
    steps.only()
    assert not steps.steps


def test_steps_and_checkpoints_give_the_same_lines(spark):
    """Long runs too: blocks of 16 lines."""
    k = F.col("id")
    lines = spark.range(300).select(F.lit(7).cast("bigint").alias("vid"), "id", (k * 100).alias("start_ms"), (k * 100 + 900 - k % 7 * 100).alias("end_ms"),
                                    F.concat(F.lit("w"), k.cast("string")).alias("text"), F.lit(60_000).cast("bigint").alias("duration_ms"))
    for call in (T.fix_overlaps, T.merge_lines):
        steps = Steps(spark)
        got = call(steps.last(lines), block=16, steps=steps).collect()
        assert sorted(got) == sorted(call(lines, block=16).collect()) and got
