"""The table a stream keeps: newest row per key, repeated and failed batches, files bounded by the keys."""
import pathlib
import random

from cuewright.streaming.keyed import KeyedTable
from cuewright.streaming.positions import latest_position_table

SCHEMA = "k long, t long, v string"


def table(spark, folder, **options):
    frame = spark.createDataFrame([], SCHEMA)
    return KeyedTable(spark, str(folder), frame.schema, ("k",), ("t",), **options)


def test_upserts_are_the_newest_rows(spark, tmp_path):
    r, seen = random.Random(1), {}
    out = table(spark, tmp_path / "t", buckets=4)
    assert out.read().count() == 0
    for epoch in range(6):
        rows = [(r.choice([None, *range(40)]), epoch * 100 + i, f"e{epoch}-{i}") for i in range(30 if epoch != 3 else 0)]
        rows.append((7, -1 - epoch, "late"))  # an old report never wins
        for k, t, v in rows:
            seen[k] = max(seen.get(k, (-10**9, "")), (t, v))
        out.upsert(spark.createDataFrame(rows, SCHEMA).repartition(3), epoch)
        assert {x.k: (x.t, x.v) for x in out.read().collect()} == seen
    assert len(out.read().collect()) == len(seen)


def test_a_repeated_epoch_changes_nothing_and_a_failed_one_is_not_read(spark, tmp_path):
    out = table(spark, tmp_path / "t", buckets=4)
    out.upsert(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], SCHEMA), 0)
    out.upsert(spark.createDataFrame([(1, 9, "other")], SCHEMA), 0)
    spark.createDataFrame([(1, 9, "lost")], SCHEMA).selectExpr("*", "0 AS bucket").write.partitionBy("bucket").parquet(str(tmp_path / "t/rows/epoch=1"))
    assert sorted(map(tuple, out.read().collect())) == [(1, 1, "a"), (2, 1, "b")]
    out.upsert(spark.createDataFrame([(1, 5, "again")], SCHEMA), 1)
    out.upsert(spark.createDataFrame([], SCHEMA), 2)
    assert sorted(map(tuple, out.read().collect())) == [(1, 5, "again"), (2, 1, "b")]


def test_files_follow_the_keys_and_not_the_batches(spark, tmp_path):
    out = table(spark, tmp_path / "t", buckets=3)
    for epoch in range(8):
        out.upsert(spark.createDataFrame([(k, epoch, "x") for k in range(epoch % 2, 30, 2)], SCHEMA), epoch)
    files = list(pathlib.Path(tmp_path / "t/rows").rglob("*.parquet"))
    assert len(files) <= 2 * 3 and len(list((tmp_path / "t/log").iterdir())) == 2
    assert out.read().count() == 30


def test_a_stream_that_is_started_again_goes_on(spark, tmp_path):
    schema = "vid long, ts_s long, event_id long, at_s double"
    say = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: {r.vid: (r.at_tenths, r.watched_at) for r in latest_position_table(
        spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), buckets=2).collect()}
    say([(1, 10, 1, 4.0), (2, 10, 2, -3.0)])
    assert run() == {1: (40, 10), 2: (0, 10)} == run()
    say([(1, 5, 3, 99.0), (2, 11, 4, 7.5)])
    assert run() == {1: (40, 10), 2: (75, 11)}


def test_the_state_of_a_whole_video_ends(spark, tmp_path):
    from cuewright.streaming.prefix import prefix_stream, state_on_disk

    schema, provider = "vid string, window_no long, until_ms long, windows long", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        with state_on_disk(spark):
            q = prefix_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")) \
                .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        out = spark.read.parquet(str(tmp_path / "out"))
        return {r.vid: r.m for r in out.groupBy("vid").agg({"ready_ms": "max"}).toDF("vid", "m").collect()}, q.lastProgress["stateOperators"][0]["numRowsTotal"]

    got, rows = run([("v1", 0, 10, 3), ("v1", 2, 30, 3), ("v2", 1, 20, 2), ("v3", 0, 10, 1)])
    assert got == {"v1": 10, "v3": 10} and rows > 0  # what waits, and where v1 is, are kept over the restart
    got, rows = run([("v1", 1, 20, 3), ("v1", 0, 10, 3), ("v2", 0, 10, 2)])
    assert got == {"v1": 30, "v2": 20, "v3": 10} and rows == 0
    assert spark.conf.get(provider) == before


def test_a_prefix_kept_without_python_workers(spark, tmp_path):
    """Windows out of order, again, and over several batches; nothing of the stream runs in Python."""
    from cuewright.streaming.prefix import prefix_table

    schema = "vid string, window_no long, until_ms long"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = prefix_table(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path))
        assert "Python" not in out._jdf.queryExecution().toString() and "State" not in out._jdf.queryExecution().toString()
        return {r.vid: r.ready_ms for r in out.collect()}

    assert run([("v1", 0, 10), ("v1", 2, 30), ("v1", 2, 30), ("v2", 1, 20), ("v3", 0, 10), ("v1", 4, 50)]) == {"v1": 10, "v3": 10}
    assert run([("v1", 1, 20), ("v1", 0, 10), ("v2", 0, 10), (None, 0, 5)]) == {"v1": 30, "v2": 20, "v3": 10, None: 5}
    assert run([("v1", 3, 40), ("v2", 1, 20)]) == {"v1": 50, "v2": 20, "v3": 10, None: 5}
    import glob

    kept = spark.read.parquet(*[f for f in glob.glob(str(tmp_path / "table/rows/epoch=2/bucket=*"))])
    assert {r.vid: len(r.waiting) for r in kept.collect()}["v1"] == 0  # what no longer waits is not kept
