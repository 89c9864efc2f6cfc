"""The incremental forms agree with the batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.operators import archive
from newsloom.streaming import pipelines

RUNS = "feed string, run_at timestamp, ok boolean, error string"


def test_feed_health_over_batches(spark, tmp_path):
    at = lambda i: dt.datetime(2026, 8, 1) + dt.timedelta(hours=i)
    rows = [("a", at(i), i == 2, None if i == 2 else f"e{i}") for i in range(11)] + [("b", at(i), i % 2 == 0, "x") for i in range(4)]
    for k in range(3):
        spark.createDataFrame([r for r in rows if (r[1].hour // 4) == k], RUNS).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    found = {}
    stream = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    pipelines.run_once(pipelines.feed_health(stream), str(tmp_path / "cp"), lambda df, _: found.update({r["feed"]: r for r in df.collect()}), "update")
    want = {r["feed"]: r for r in archive.feed_health(spark.createDataFrame(rows, RUNS).withColumn("n", F.lit(0))).collect()}
    for feed, w in want.items():
        assert (found[feed]["total_runs"], found[feed]["consecutive_failures"], found[feed]["last_ok"], found[feed]["dead"]) == (w["total_runs"], w["consecutive_failures"], w["last_ok"], w["dead"])


def test_first_seen_and_snapshots(spark, tmp_path):
    day = dt.datetime(2026, 8, 17)
    rows = [("https://a.example/x", day), ("http://a.example/x/?q", day), ("https://b.example", day + dt.timedelta(days=1))]
    spark.createDataFrame(rows, "url string, published_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = pipelines.read_new(spark, str(tmp_path / "in"), "url string, published_at timestamp")
    out = pipelines.first_seen(stream).withColumn("date", F.to_date("published_at"))
    for _ in range(2):  # the second run finds nothing new
        pipelines.run_once(out, str(tmp_path / "cp"), pipelines.snapshot_sink(str(tmp_path / "out")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_windows_close_behind_the_watermark(spark, tmp_path):
    rows = [(dt.datetime(2026, 8, 17, h), "k") for h in (1, 2, 7, 20)]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    got = []
    pipelines.run_once(pipelines.windowed_counts(pipelines.read_new(spark, str(tmp_path / "in"), "ts timestamp, event_type string")), str(tmp_path / "cp"), lambda df, _: got.extend(df.collect()))
    assert sorted((r["window"]["start"].hour, r["n"]) for r in got) == [(0, 2), (6, 1)]


def test_a_silent_feed_dies_by_time_and_is_forgotten(spark, tmp_path):
    """Three runs of the same query over batches: feed b stops, the others' runs move the clock; a restart loses nothing."""
    at = lambda h: dt.datetime(2026, 8, 1) + dt.timedelta(hours=h)
    batches = [[("a", at(0), True, None), ("b", at(0), True, None), ("c", at(0), False, "e0")], [("a", at(20), False, "e1"), ("c", at(20), False, "e2")], [("a", at(40), True, None)], [("a", at(90), True, None)], [("a", at(140), True, None), ("b", at(140), False, "late")], [("a", at(141), True, None)]]
    told = []
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            watched = pipelines.feed_watch(stream, silence_hours=24, forget_hours=72)
            pipelines.run_once(watched, str(tmp_path / "cp"), lambda df, _: told.extend((i, r) for r in df.collect()), "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    silent = {r.feed: (i, r.total_runs, r.last_run) for i, r in told if r.silent}
    assert silent["b"][1:] == (1, at(0)) and silent["c"][1:] == (2, at(20)) and "a" not in {r.feed for i, r in told if r.silent and i < 3}
    assert all(r.dead for _, r in told if r.silent)
    a = [r for _, r in told if r.feed == "a" and not r.silent]
    assert [r.total_runs for r in a] == [1, 2, 3, 4, 5, 6] and [r.consecutive_failures for r in a] == [0, 1, 0, 0, 0, 0] and not a[-1].dead
    back = [r for i, r in told if r.feed == "b" and not r.silent and i == 4]
    assert [(r.total_runs, r.consecutive_failures) for r in back] == [(1, 1)]  # its state of 72 hours before was gone
