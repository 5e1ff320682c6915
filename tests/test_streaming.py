"""Streams give what the same operators give on a table."""

from pyspark.sql import functions as F

from graphloom.streaming import events as E


def events(spark):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", k, float(i)) for i, (s, k) in enumerate([(0, "a"), (3, "a"), (4, "b"), (9, "a"), (20, "a"), (58, "b")])]
    return spark.createDataFrame(rows, "event_id long, t string, path string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "path", "value")


def replay(spark, tmp_path, transform, name):
    src = str(tmp_path / "src")
    events(spark).write.mode("overwrite").parquet(src)
    stream = E.event_time(spark.readStream.schema(events(spark).schema).parquet(src), late="0 seconds")
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]


def test_tumbling_matches_table(spark, tmp_path):
    got = replay(spark, tmp_path, lambda s: E.tumbling(s, "10 seconds", "path"), "tumbling")
    want = {tuple(r) for r in E.tumbling(events(spark), "10 seconds", "path").collect()}
    assert set(got) <= want and len(got) >= len(want) - 1  # the last window closes with the next event


def test_debounce(spark, tmp_path):
    want = {(r.path, r.n) for r in E.debounced(events(spark), gap=5, cap=30).collect()}
    assert want == {("a", 2), ("a", 1), ("b", 1)}
    assert E.debounced(events(spark), gap=60, cap=8).where("path = 'a'").count() == 3
    got = replay(spark, tmp_path, lambda s: E.debounced(s, gap=5, cap=30), "debounced")
    assert {(p, n) for p, _, _, n in got} <= want and got


def test_latest_and_parking(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark).write.parquet(src)
    seen, parked = [], []

    def apply(batch, epoch):
        seen.append(epoch)
        raise RuntimeError("no")

    q = E.apply_changes(spark.readStream.schema(events(spark).schema).parquet(src), apply, lambda b, e, err: parked.append(b.count()), str(tmp_path / "cp"), keys=("path",), attempts=3)
    q.awaitTermination()
    assert len(seen) == 3 and parked == [2]
