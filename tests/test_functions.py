"""Column functions by example."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions import colour, dates, hashing, urls
from newsloom.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.class_tokens, "The Models, models and GLASS at 7 buses", ["model", "glass", "buses"[:-1]]),
        (T.class_tokens, None, []),
        (T.cluster_tokens, "The models of EU models", ["models"]),
        (T.overlap_tokens, "This that-over it", ["this", "that", "over"]),
        (T.word_list, "A b, a  C9!", ["a", "b", "a", "c9"]),
        (T.word_list, "", []),
        (T.proper_nouns, "Apple saw Berlin. The CEO left (X) today", ["berlin", "ceo"]),
        (T.quoted_runs, 'He said "one two three four" and "short".', [4]),
        (T.escape_xml, "<a href='x'>\"&\"", "&lt;a href=&#39;x&#39;&gt;&quot;&amp;&quot;"),
        (T.escape_xml, None, ""),
        (T.safe_json, '{"a":"</script>&"}', '{"a":"\\u003c/script\\u003e\\u0026"}'),
        (T.decode_entities, "&amp;lt; &#65;&#x42; &bogus; &mdash; &#99999999;", "&lt; AB &bogus; — &#99999999;"),
        (T.strip_tags, "<![CDATA[a <b>b</b>]]>  c", "a b c"),
        (T.slugify, "Über die  Brücke -- heute!", "uber-die-brucke-heute"),
        (T.slugify, "x" * 79 + " yy", "x" * 79),
        (T.digest_slug, "???", "item-3"),
        (T.monogram, "The New Paper", "TN"),
        (T.monogram, "bbc", "BB"),
        (T.squash, "The A.I.-Post 9", "theaipost9"),
        (T.label_colon, "Big news: it came", True),
        (T.label_colon, "Three word label: it came", False),
        (T.via_publisher, "A title - The Outlet", "The Outlet"),
        (T.via_publisher, "A title – X", None),
        (T.via_publisher, "Co-operation grows", None),
        (urls.host_of, "HTTPS://WWW.News.Example.com:80/a?b#c", "news.example.com"),
        (urls.host_of, "not a url", ""),
        (urls.host_of, None, ""),
        (urls.url_key, "https://A.com/x//?q=1#t", "a.com/x"),
        (urls.title_key, "A Title: with-marks!", "a title withmarks"),
        (urls.is_https, "HTTPS://a", True),
        (urls.is_https, "http://a", False),
        (urls.is_institutional, "https://x.gov.uk/a", True),
        (urls.is_institutional, "https://mygov.uk/a", False),
        (urls.is_institutional, "https://arxiv.org/abs/1", True),
        (urls.host_suffixes, "a.b.c", ["a.b.c", "b.c", "c"]),
        (hashing.hash32, "foobar", 0xBF9CF968),
        (hashing.hash32, "", 2166136261),
    ],
)
def test_text(spark, f, text, want):
    assert one(spark, f(F.col("s")), s=text) == want


def test_similarity(spark):
    a, b = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd"))
    none = F.array().cast("array<string>")
    assert one(spark, F.array(T.jaccard(a, b), T.jaccard(a, none)), s="") == [0.5, 0.0]
    assert one(spark, T.shared_count(a, b), s="") == 2
    assert one(spark, T.restates(F.lit("alpha beta gamma delta"), F.lit("Alpha beta gamma delta epsilon")), s="")
    assert one(spark, T.expressive_length(F.array(*map(F.lit, ["the", "apple", "grows"])), F.array(F.lit("apple"))), s="") == 1


def test_lint_and_terms(spark):
    rules = [(T.bounded("caf"), "caf"), ("open.?weight", "weights")]
    assert one(spark, T.style_lint(F.col("s"), rules), s='Café OPEN-weight "no!" yes!') == ["caf", "weights", "exclamation"]
    assert one(spark, F.col("s").rlike(T.terms(["ai"], ["sora"])), s="A sorabot") and not one(spark, F.col("s").rlike(T.terms(["ai"])), s="said")


@pytest.mark.parametrize(("words", "want"), [(0, 1), (1, 1), (220, 1), (330, 2), (329, 1), (2200, 10)])
def test_read_minutes(spark, words, want):
    assert one(spark, T.read_minutes(F.col("s"), F.lit(None).cast("string")), s="w " * words) == want


def test_dates(spark):
    now = F.lit("2026-08-18 12:00:00").cast("timestamp")
    at = lambda h: F.timestamp_add("HOUR", F.lit(-h), now)
    got = one(spark, F.array(*[dates.recency(at(h), now, 48) for h in (0, 24, 48, 49, -1)], dates.recency(F.lit(None).cast("timestamp"), now, 48)), s="")
    assert got == [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]
    assert one(spark, dates.masthead_date(F.lit("2026-08-17").cast("date")), s="") == "Monday, 17 August 2026"
    assert one(spark, dates.short_date(F.lit("2026-08-07").cast("date")), s="") == "7 Aug 2026"
    assert [one(spark, dates.relative_time(at(h), now), s="") for h in (0, 1, 5, 49)] == ["just now", "1 hour ago", "5 hours ago", "2 days ago"]
    s = one(spark, dates.staleness(now, at(40)), s="")
    assert (s["hours"], s["days"], s["banner"]) == (40.0, 1, True)
    for raw, want in [("Mon, 17 Aug 2026 10:00:00 +0200", (8, 0)), ("17 Aug 2026 10:00 GMT", (10, 0)), ("2026-08-17T10:30:00Z", (10, 30)), ("2026-08-17", (0, 0))]:
        assert one(spark, dates.normalize_date(F.col("s")), s=raw) == dt.datetime(2026, 8, 17, *want)
    assert one(spark, dates.normalize_date(F.col("s")), s="yesterday") is None and one(spark, dates.normalize_date(F.col("s")), s=None) is None
    assert one(spark, dates.round3(F.lit(0.0625)), s="") == 0.063


def test_seeded_draws_and_edition_hash(spark):
    assert all(0 <= x < 1 for x in hashing.draws(hashing.hash32_of("seed"), 50)) and hashing.draws(1, 3) == hashing.draws(1, 3)
    assert one(spark, hashing.random_draws(F.lit(5).cast("long"), 2), s="") == hashing.draws(5, 2)
    same = [one(spark, hashing.edition_hash(F.col("s")), s=t) for t in ('{"stories": [{"a": 1}]}', '{"x":2,"stories":[{"a":1}]}', '{"stories":[{"a":2}]}', "junk")]
    assert same[0] == same[1] != same[2] and same[3] is None


def test_colour(spark):
    for c in ("#c8102e", "#000000", "#ffffff", "#0f7a5a", "#5b3fd6"):
        assert one(spark, colour.hsl_to_hex(colour.rgb_to_hsl(colour.hex_to_rgb(F.col("s")))), s=c) == c


def test_references_equal_the_plain_rules(spark):
    """In one pass and without Python workers: names, numbers in both forms, zeros before them, none at all, a byte order mark, halves of a pair."""
    said = "a&amp;lt; &&amp;&#65;&#x1F600;&#0065;&#1a;&#xZ;&#X41;&bogus;&amp &#xFEFF;|&#55296;&#x10FFFF;&#x110000;&#99999999999999999999;&nbsp;&hellip;&;&#;&#x;&#10;&"
    wanted = "a&lt; &&A\U0001f600A&#1a;&#xZ;&#X41;&bogus;&amp \ufeff|&#55296;\U0010ffff&#x110000;&#99999999999999999999; \u2026&;&#;&#x;\n&"
    df = spark.createDataFrame([(said,), (None,), ("",), ("plain",), ("&lt;",)], "t string").select(T.decode_entities(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == [wanted, None, "", "plain", "<"]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
