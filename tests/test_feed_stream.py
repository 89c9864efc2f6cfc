"""Feeds as a stream: a restarted query loses nothing and hands nothing on twice."""

import http.server
import threading

import pytest

from newsloom.sources import feeds
from newsloom.streaming import pipelines

ITEM = "<item><title>t{0}</title><link>https://x.example/{0}</link><pubDate>Mon, 17 Aug 2026 1{0}:00:00 GMT</pubDate></item>"


@pytest.fixture
def site():
    """Two feeds that a test can change; one has an ETag. What was asked is counted."""

    class Page(http.server.BaseHTTPRequestHandler):
        bodies, asked = {}, []

        def do_GET(self):
            body = self.bodies.get(self.path)
            tag = f'"{hash(body)}"'
            Page.asked.append((self.path, self.headers.get("If-None-Match") == tag))
            if body is None:
                self.send_error(503)
                return
            same = self.path == "/tagged" and self.headers.get("If-None-Match") == tag
            self.send_response(304 if same else 200)
            if self.path == "/tagged":
                self.send_header("ETag", tag)
            self.end_headers()
            self.wfile.write(b"" if same else body.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Page, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_restarts_lose_nothing_and_repeat_nothing(spark, tmp_path, site):
    page, at = site
    got, fail = [], [False]

    def sink(batch, number):
        if fail[0]:
            batch.count()  # the feeds are asked, and then the driver is lost
            raise RuntimeError("lost")
        got.extend((number, r["source"], r["ok"], r["xml"]) for r in batch.collect())

    def run(now, names=("tagged", "plain")):
        stream = feeds.stream_feeds(spark, [(n, f"{at}/{n}") for n in names], str(tmp_path / "spool"), 100, 5, now)
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(sink).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    def new(*args):
        del got[:]
        run(*args)
        return sorted(x[1:] for x in got)

    one, two, three = ("<rss>" + "".join(ITEM.format(k) for k in range(n)) + "</rss>" for n in (1, 2, 3))
    page.bodies.update({"/tagged": one, "/plain": one})
    assert new(1000) == [("plain", True, one), ("tagged", True, one)]
    assert new(1050) == []  # the same slot: nobody is asked
    assert len(page.asked) == 2
    page.bodies["/plain"] = two
    assert new(1100) == [("plain", True, two)]
    assert ("/tagged", True) in page.asked  # by its ETag, after a restart
    page.bodies.update({"/tagged": two, "/plain": three})
    fail[0] = True
    with pytest.raises(Exception, match="lost"):
        run(1200)
    fail[0], asked = False, len(page.asked)
    page.bodies["/plain"] = one  # what the lost batch saw is gone from the feed
    assert new(1200) == [("plain", True, three), ("tagged", True, two)]
    assert len(page.asked) == asked
    del page.bodies["/tagged"]
    assert [x[:2] for x in new(1300)] == [("plain", True), ("tagged", False)]
    page.bodies["/tagged"] = two
    assert new(1400) == []  # as before it failed
    page.bodies["/late"] = two
    assert new(1500, ("tagged", "plain", "late")) == [("late", True, two)]
    assert all(len(list(f.iterdir())) <= 2 for f in (tmp_path / "spool").iterdir())


def test_items_of_a_stream_come_once(spark, tmp_path, site):
    page, at = site
    seen = []
    for now, n in ((0, 1), (100, 3), (200, 3), (300, 4)):
        page.bodies["/plain"] = "<rss>" + "".join(ITEM.format(k) for k in range(n)) + "</rss>"
        answers = feeds.stream_feeds(spark, [("a", f"{at}/plain")], str(tmp_path / "spool"), 100, 5, now)
        items = feeds.parse_feed(answers.select("source", "xml"))
        query = pipelines.first_seen(items).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda b, _: seen.extend(r["title"] for r in b.collect())).start()
        query.processAllAvailable()
        query.stop()
    assert sorted(seen) == ["t0", "t1", "t2", "t3"]
