import datetime as dt


from newsloom.operators import pages

DAY, AT = dt.date(2026, 1, 5), dt.datetime(2026, 1, 5, 6, 0)
STORY = "date date, id string, pos int, beat string, headline string, deck string, body array<string>, summary array<string>, whyItMatters string, publishedAt timestamp, readMinutes int, confidence string, entities array<string>, sources array<struct<title:string,publisher:string,url:string,tier:int>>"
BEATS = "id string, label string, pos int"


def one(k, beat, **own):
    base = {"body": [f"p{k}"], "summary": ["s"], "why": "w", "at": None, "confidence": "high", "entities": [], "sources": [("t", "p", "u", 1)]} | own
    return (DAY, f"d-{k}", k, beat, f"h{k}", f"deck {k}", base["body"], base["summary"], base["why"], base["at"], 2, base["confidence"], base["entities"], base["sources"])


def test_story_pages(spark):
    rows = [one(k, "a" if k % 2 else "b") for k in range(8)] + [one(8, "zz", body=None, summary=None, why="", at=AT, confidence=None, entities=["Łódź & Co", "Łódź & Co", "x"], sources=None)]
    other = (dt.date(2026, 1, 6), *one(9, "a")[1:])
    stories = spark.createDataFrame([*rows, other], STORY)
    editions = spark.createDataFrame([(DAY, dt.datetime(2026, 1, 5, 23, 0))], "date date, generated_at timestamp")
    beats = spark.createDataFrame([("a", "Section A", 0), ("b", "Section B", 1)], BEATS)
    got = {r.id: r for r in pages.story_pages(stories, editions, beats).collect()}
    assert len(got) == 10
    assert [x.path for x in got["d-1"].also] == [f"story/d-{k}.html" for k in (3, 5, 7, 0, 2)] and got["d-1"].also[0].section == "Section A"
    assert got["d-1"].published_at == dt.datetime(2026, 1, 5, 23, 0) and not got["d-1"].doubtful and got["d-1"].topics == []
    odd = got["d-8"]
    assert (odd.section, odd.paragraphs, odd.keypoints, odd.why, odd.published_at, odd.n_sources, odd.citations, odd.doubtful) == ("zz", ["deck 8"], [], None, AT, 0, [], False)
    assert [t.name for t in odd.topics] == ["Łódź & Co", "Łódź & Co", "x"] and odd.topics[2].path == "entity/x.html"
    assert [x.path for x in odd.also] == [f"story/d-{k}.html" for k in range(5)]
    assert got["d-9"].also == [] and got["d-9"].published_at is None
    assert pages.story_pages(stories.where("false"), editions, beats).count() == 0


def test_topics_follow_mentions_then_the_alphabet(spark):
    rows = [("zeta", "zeta", 3, DAY), ("beta", "Beta", 3, DAY), ("alpha", "alpha", 3, DAY), ("top", "Top", 9, DAY), ("alpha-2", "alpha", 3, DAY)]
    got = pages.topics_page(spark.createDataFrame(rows, "slug string, name string, n long, last date")).orderBy("place").collect()
    assert [(r.place, r.path) for r in got] == [(i + 1, f"entity/{s}.html") for i, s in enumerate(("top", "alpha", "alpha-2", "beta", "zeta"))]


def test_archive_page_says_what_did_not_run(spark):
    d = [dt.date(2026, 1, k) for k in (1, 2, 3)]
    n = "date date, n long"
    got = pages.archive_page(spark.createDataFrame([(d[0], "One", 4)], "date date, title string, n long"), spark.createDataFrame([(d[0], 2), (d[1], 3)], n), spark.createDataFrame([(d[2], 7)], n)).collect()
    assert [r.date for r in got] == d[::-1]
    assert got[0].asDict() == {"date": d[2], "title": None, "published": False, "edition_path": None, "stories": None, "digest_path": None, "digest_items": None, "wire_path": "wire/2026-01-03.html", "wire_items": 7}
    assert (got[2].published, got[2].title, got[2].edition_path, got[2].wire_path) == (True, "One", "edition/2026-01-01.html", None)
