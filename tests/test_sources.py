"""Feeds, documents and sinks."""

import datetime as dt
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from newsloom.plans.harvest import harvest
from newsloom.sources import documents, feeds, sinks

RSS = "<rss><channel><item><title><![CDATA[Big &amp; small <b>news</b>]]></title><link>https://a.example/1</link><pubDate>Mon, 17 Aug 2026 10:00:00 GMT</pubDate><description>&lt;p&gt;Body&lt;/p&gt;</description></item><item><title>No link</title></item><item><link>https://a.example/2</link></item></channel></rss>"
ATOM = """<feed><entry><title type="html">One</title><link rel="self" href="https://self.example"/><link rel='alternate' href='https://alt.example'/><updated>2026-08-17T10:00:00Z</updated><summary>s</summary></entry>
<entry><title>Two</title><link href="https://plain.example"/><link rel="edit" href="https://edit.example"/><published>bad date</published><content>c</content></entry></feed>"""


def test_parse_feed(spark):
    raw = spark.createDataFrame([(0, RSS), (1, ATOM), (2, ""), (3, None), (4, "not xml <item>")], "feed int, xml string")
    got = [tuple(r) for r in feeds.parse_feed(raw).orderBy("feed", "pos").collect()]
    ten = dt.datetime(2026, 8, 17, 10)
    assert got == [
        (0, 0, "Big & small news", "https://a.example/1", ten, "<p>Body</p>"),
        (1, 0, "One", "https://alt.example", ten, "s"),
        (1, 1, "Two", "https://plain.example", None, "c"),
    ]


def test_top_by_feed_and_harvest(spark):
    item = "<item><title>t{0}</title><link>https://x.example/{0}?a={1}</link></item>"
    raw = spark.createDataFrame([(0, "s", False, "".join(item.format(i, 0) for i in range(45))), (1, "r", False, item.format(3, 1))], "feed_pos int, source string, discovery_only boolean, xml string")
    got = harvest(raw).collect()
    assert len(got) == 40 and sum(r["url"].startswith("https://x.example/3?") for r in got) == 1
    assert next(r for r in got if r["url"].startswith("https://x.example/3?"))["source"] == "s"


def test_leads(spark):
    said = 'Here:\n```json\n[{"title":"AI one","url":"https://a.example","date":"2026-08-01"},{"title":"AI two","url":"http://b.example"},{"title":"AI one again","url":"https://a.example"},{"title":"cooking","url":"https://c.example"},{"title":"AI","url":"https://search.example/q","date":"soon"}]\n``` bye'
    got = feeds.clean_leads(spark.createDataFrame([(said,), ("none",), (None,)], "said string"), "said", "2026-08-18", r"(?i)\bai\b", ["search.example"]).collect()
    assert [(r["title"], r["url"], r["published_at"], r["discovery_only"]) for r in got] == [("AI one", "https://a.example", dt.datetime(2026, 8, 1, 12), True)]


def test_feed_source_isolates_failures(spark):
    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 403)
            self.end_headers()
            self.wfile.write(b"<rss/>" if self.path == "/ok" else b"")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    got = {r["source"]: r for r in feeds.read_feeds(spark, [("a", at + "/ok"), ("b", at + "/no"), ("c", "nonsense")], 5).collect()}
    server.shutdown()
    assert got["a"]["ok"] and got["a"]["xml"] == "<rss/>" and not got["b"]["ok"] and "403" in got["b"]["error"] and not got["c"]["ok"]


def test_documents(spark, tmp_path):
    for name, text in {"2026-08-17.json": '{"n": 1}', "2026-08-18.json": '{"n": 2}', "2026-08-19.json": "{broken", "notes.json": '{"n": 9}'}.items():
        (tmp_path / name).write_text(text)
    docs = documents.read_documents(spark, str(tmp_path), "n int")
    assert docs.count() == 3
    assert documents.latest(docs.where("doc.n is not null")).first()["doc"]["n"] == 2
    assert [r["doc"]["n"] for r in documents.before(docs, "2026-08-18").collect()] == [1]
    assert [r["date"].day for r in documents.newest_first(docs).collect()] == [19, 18, 17]
    with pytest.raises(ValueError):
        documents.checked_date("18 Aug")


def test_dated_writes(spark, tmp_path):
    path = str(tmp_path / "wire")
    rows = lambda day, t: spark.createDataFrame([(day, t, "u", "s", None)], "date string, title string, url string, source string, published_at timestamp")
    assert sinks.upsert_snapshot(rows("2026-08-17", "a"), path) and sinks.upsert_snapshot(rows("2026-08-18", "b"), path) and sinks.upsert_snapshot(rows("2026-08-17", "c"), path)
    assert not sinks.upsert_snapshot(rows(None, "d"), path) and not sinks.upsert_snapshot(rows("2026-08-17", "e").where("false"), path)
    back = spark.read.parquet(path)
    assert sorted(r["title"] for r in back.collect()) == ["b", "c"]
    assert sinks.retained(back, "2026-09-01").count() == 1 and sinks.expired_dates(back, "2026-09-01").count() == 1
    (tmp_path / "wire" / "notes").mkdir()
    assert sinks.prune_dated(spark, path, "2026-09-01") == ["2026-08-17"] and sinks.prune_dated(spark, path, "2026-09-01") == []
    assert (tmp_path / "wire" / "notes").is_dir() and sinks.prune_dated(spark, path + "-none", "2026-09-01") == []
    assert sinks.upsert_snapshot(rows("2026-08-17", "c"), path)
    back = spark.read.parquet(path + "/date=*")
    bad = spark.createDataFrame([("E",)], "severity string")
    with pytest.raises(ValueError):
        sinks.gated_write(back, bad, str(tmp_path / "gate"))
    sinks.gated_write(back.withColumn("date", F.lit("2026-08-17")), bad.withColumn("severity", F.lit("W")), str(tmp_path / "gate"))
    assert spark.read.parquet(str(tmp_path / "gate")).count() == 2


def test_leads_of_many_answers_keep_the_first(spark):
    said = lambda *x: "Sure: [" + ", ".join(f'{{"title": "the {t}", "url": "{u}", "date": "{d}"}}' for t, u, d in x) + "] done"
    rows = [(3, said(("late", "https://a.example/1", ""))), (1, said(("second", "https://a.example/2", "2026-08-01"), ("first", "https://a.example/1", "soon"), ("again", "https://a.example/1", ""))), (2, said(("x", "https://a.example/2", ""), ("http", "http://a.example/3", ""), ("found", "https://search.example/4", ""))), (4, "no array"), (5, None)]
    df = spark.createDataFrame(rows, "n int, said string")
    for parts in (1, 5):
        got = {r["url"]: (r["title"], r["published_at"]) for r in feeds.clean_leads(df.repartition(parts), "said", "2026-08-17", "the", ["search.example"], ["n"]).collect()}
        assert got == {"https://a.example/1": ("the first", dt.datetime(2026, 8, 17, 12)), "https://a.example/2": ("the second", dt.datetime(2026, 8, 1, 12))}


def test_lock_and_orphans(spark):
    df = lambda rows: spark.createDataFrame(rows, "id string, hash long")
    got = {r["id"]: r["state"] for r in sinks.lock_changes(df([("a", 1), ("b", 2), ("c", 3)]), df([("b", 2), ("c", 4), ("d", 5)])).collect()}
    assert got == {"a": "added", "b": "same", "c": "changed", "d": "gone"}
