from pyspark.sql import functions as F

from quarry.streaming import events as E


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def split(spark, sf, path, parts=3):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(parts):
        e.where(F.pmod("event_id", F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(path)
    return e


def test_windows_as_in_one_batch(spark, sf, tmp_path):
    e = split(spark, sf, str(tmp_path / "in"))
    stream = lambda: E.read(spark, str(tmp_path / "in"), e.schema, 1)
    got = {(r.window.start, r.event_type): r.n for r in drain(E.tumbling(stream(), late="60 days"), "tumbling", "complete").collect()}
    assert got == {(r.window.start, r.event_type): r.n for r in e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).collect()}
    got = {r.window.start: r.n for r in drain(E.sliding(stream(), late="60 days"), "sliding", "complete").collect()}
    assert sum(got.values()) == 2 * e.count()
    assert drain(E.distinct_events(stream().union(stream()), late="60 days"), "once", "append").count() == e.count()
    assert drain(E.sessions(stream(), late="60 days"), "sessions", "complete").agg(F.sum("n").alias("n")).first().n == e.count()


def test_running_totals(spark, sf, tmp_path):
    e = split(spark, sf, str(tmp_path / "in"))
    rows = drain(E.running_totals(E.read(spark, str(tmp_path / "in"), e.schema, 1)), "totals", "update")
    last = {r.user_id: r.n for r in rows.groupBy("user_id").agg(F.max("n").alias("n")).collect()}
    assert last == {r.user_id: r["count"] for r in e.groupBy("user_id").count().collect()}


def test_follower_ends_like_one_batch(spark, tmp_path):
    schema = "path string, hash string, content string, order int"
    batches = [[("a", "1", "A", 1), ("b", "1", "B", 2)], [("a", "2", "A2", 3), ("c", "1", "C", 4), ("c", "2", "C2", 5)], [("b", None, None, 6)]]
    f = E.Follower(spark, str(tmp_path / "table"))
    for k, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = f.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ck"), {"availableNow": True})
        q.awaitTermination(120)
        assert q.exception() is None
    want = {("a", "2", "A2"), ("c", "2", "C2")}
    assert {tuple(r) for r in f.table().collect()} == want
    f.apply(spark.createDataFrame(batches[2], schema), f.versions()[-1])  # a batch that runs again
    assert {tuple(r) for r in f.table().collect()} == want
