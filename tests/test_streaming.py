"""Run log with cursors, and state kept from a stream of written translations."""

from pyspark.sql import functions as F

from glossweave.schemas import RUN_EVENT
from glossweave.streaming import events, state


def test_cursor_replay_and_live_view(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("r1", i, "info" if i < 3 else "completed", f"m{i}", i, 4) for i in range(4)] + [("r2", 0, "info", "other", 0, 1)]
    events.append(spark.createDataFrame(rows[:2], RUN_EVENT), log)
    first, done = events.read_from(spark, log, "r1")
    assert [r.event_id for r in first.orderBy("event_id").collect()] == [0, 1] and not done.first().complete
    q = events.follow(spark, log, "r1").writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
    events.append(spark.createDataFrame(rows[2:], RUN_EVENT), log)
    q.processAllAvailable()
    q.stop()
    assert sorted(r.message for r in spark.table("live").collect()) == ["m0", "m1", "m2", "m3"]
    later, done = events.read_from(spark, log, "r1", cursor=1)
    assert sorted(r.event_id for r in later.collect()) == [2, 3] and done.first().complete


def test_state_from_stream(spark, tmp_path):
    source, root, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    schema = "lang string, key string, source_hash string, translation_hash string, seq long"

    def feed(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        state.start(stream, root, check).awaitTermination()

    feed([("de", "A", "s1", "t1", 1), ("de", "A", "s2", "t2", 2), ("fr", "A", "s1", "f1", 1)])
    feed([("fr", "A", "s3", "f3", 3), ("es", "B", "s1", "e1", 1)])
    rows = state.read_version(spark, root, 1).select("lang", "key", "source_hash", "translation_hash").collect()
    assert {(r.lang, r.key): (r.source_hash, r.translation_hash) for r in rows} == {
        ("de", "A"): ("s2", "t2"), ("fr", "A"): ("s3", "f3"), ("es", "B"): ("s1", "e1")}
    assert state.read_version(spark, root, -1).filter(F.lit(True)).count() == 0
