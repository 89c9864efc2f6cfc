import datetime as dt

from pyspark.sql import functions as F

from newsloom.sources.history import SeenIndex

DAYS = [dt.date(2026, 1, d) for d in (1, 2, 3, 4)]


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "date date, url string, n int")


def test_lookup_equals_the_full_join_and_reads_few_files(spark, tmp_path):
    index = SeenIndex(spark, str(tmp_path / "seen"), buckets=8, bits=1 << 12)
    old = [(d, f"https://a.example/{i % 70}-{d.day % 3}", i) for d in DAYS for i in range(200)] + [(DAYS[0], None, 1), (None, "https://a.example/x", 1)]
    for d in DAYS:
        index.add(rows(spark, [r for r in old if r[0] in (d, None)]), "url")
    new = rows(spark, [(None, f"https://a.example/{i}-2", 0) for i in range(3)] + [(None, "https://b.example/none", 0), (None, None, 0)])
    history = rows(spark, [r for r in old if r[0] and r[1]]).select("url", "date").distinct()
    wanted = sorted(map(tuple, history.join(new.select("url").distinct(), "url", "left_semi").collect()))
    assert sorted(map(tuple, index.lookup(new, "url").collect())) == wanted and wanted
    folders = index.files(new, "url")
    assert 0 < len(folders) <= 8 < 32  # of 4 dates with 8 buckets each
    early = index.lookup(new, "url", F.lit(DAYS[2]))
    assert sorted(map(tuple, early.collect())) == [w for w in wanted if w[1] < DAYS[2]]


def test_a_date_added_again_replaces_itself(spark, tmp_path):
    index = SeenIndex(spark, str(tmp_path / "seen"), buckets=4)
    index.add(rows(spark, [(DAYS[0], f"u{i}", 0) for i in range(20)] + [(DAYS[1], "u1", 0)]), "url")
    index.add(rows(spark, [(DAYS[0], "u3", 0)]), "url")
    asked = rows(spark, [(None, f"u{i}", 0) for i in range(20)])
    assert sorted(map(tuple, index.lookup(asked, "url").collect())) == [("u1", DAYS[1]), ("u3", DAYS[0])]


def test_an_addition_that_stops_before_its_filters_leaves_the_earlier_one(spark, tmp_path, monkeypatch):
    index = SeenIndex(spark, str(tmp_path / "seen"), buckets=4)
    index.add(rows(spark, [(DAYS[0], "u1", 0)]), "url")
    monkeypatch.setattr(index, "_spots", lambda key: 1 / 0)
    try:
        index.add(rows(spark, [(DAYS[0], "u2", 0)]), "url")
    except ZeroDivisionError:
        monkeypatch.undo()
    assert [r.url for r in index.lookup(rows(spark, [(None, "u1", 0), (None, "u2", 0)]), "url").collect()] == ["u1"]


def test_nothing_added_and_nothing_asked(spark, tmp_path):
    index = SeenIndex(spark, str(tmp_path / "seen"))
    asked = rows(spark, [(None, "u1", 0)])
    assert index.lookup(asked, "url").count() == 0
    index.add(asked.where("false"), "url")
    index.add(rows(spark, [(DAYS[0], "u1", 0)]), "url")
    assert index.lookup(asked.where("false"), "url").count() == 0 and index.lookup(asked, "url").count() == 1
