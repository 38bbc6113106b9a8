import datetime as dt

from palaver.streaming.activity import first_copies, windowed

SCHEMA = "chat string, datetime timestamp_ntz, message_type string, kind string, text_masked string"


def test_stream_agrees_with_batch(spark, tmp_path):
    at = lambda d, h: dt.datetime(2026, 3, d, h)
    rows = [("c", at(1, 9), "user", "text", "a"), ("c", at(1, 10), "user", "media", "b"), ("c", at(2, 1), "system", "", "c"), ("c", at(2, 2), "user", "text", "a"), ("c", at(9, 1), "user", "deleted", "d")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for name, df, mode in (("days", windowed(stream), "complete"), ("firsts", first_copies(stream, "30 days"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    got = sorted((r["start"].day, r["text_messages"], r["media_rows"], r["deleted_rows"], r["system_rows"]) for r in spark.table("days").collect())
    assert got == [(1, 1, 1, 0, 0), (2, 1, 0, 0, 1), (9, 0, 0, 1, 0)]
    assert sorted(r["text_masked"] for r in spark.table("firsts").collect()) == ["a", "b", "c", "d"]
