"""Lookup, clusters, scores, selection, archives, similarity, the gate."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from newsloom import config as C
from newsloom.functions import hashing
from newsloom.functions import text as T
from newsloom.operators import archive, cluster, dedup, jsonschema, lookup, rank, select, similarity, validate

BOOK = C.Book((("aisi.gov.uk", "Institute", 1), ("gov.uk", "Government", 2), ("paper.example", "Paper", 2)), ("spam.example",))
BEATS = C.Config((C.Beat("models", "Models", "", ("weights", "benchmark", "gpu", "release")), C.Beat("money", "Money", "", ("funding", "round", "release")), C.Beat("law", "Law", "", (), ("court case rules",))), BOOK)


def test_publishers_by_suffix_first_in_list(spark):
    hosts = ["x.aisi.gov.uk", "gov.uk", "notgov.uk", "a.paper.example", "spam.example", "x.spam.example", "", "other.net"]
    rows = spark.createDataFrame([("https://" + h,) for h in hosts if h] + [("junk",)], "url string")
    got = {r["host"]: (r["tier"], r["publisher"], r["blocked"]) for r in lookup.with_publisher_tier(rows, F.col("url"), C.publishers(spark, BOOK), C.blocked(spark, BOOK)).collect()}
    assert got["x.aisi.gov.uk"] == (1, "Institute", False) and got["gov.uk"] == (2, "Government", False) and got["notgov.uk"] == (4, "notgov.uk", False)
    assert got["a.paper.example"] == (2, "Paper", False) and got["spam.example"][::2] == (None, True) and got["x.spam.example"][::2] == (None, True) and got[""] == (4, "", False)


def test_classes(spark):
    rows = [(1, "open weights benchmark"), (2, "a gpu"), (3, "a release"), (4, "nothing"), (5, None), (6, "court rules"), (7, "funding round weights")]
    got = {r["id"]: r["beat"] for r in lookup.classify(spark.createDataFrame(rows, "id int, t string"), "id", F.col("t"), C.beats(spark, BEATS)).collect()}
    assert got == {1: "models", 2: "models", 3: None, 4: None, 5: None, 6: "law", 7: "money"}


def test_keep_first_and_collisions(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, ""), (5, None)], "pos int, k string")
    assert sorted((r["pos"], r["k"]) for r in dedup.dedupe_by_key(df, F.col("k"), ["pos"]).collect()) == [(1, "a"), (2, "b")]
    ids = spark.createDataFrame([(0, "x"), (1, "x"), (2, "x-2"), (3, "x"), (4, "y")], "pos int, id string")
    assert [r["id"] for r in dedup.suffix_collisions(ids, "id", ["pos"]).orderBy("pos").collect()] == ["x", "x-3", "x-2", "x-4", "y"]
    names = F.array(*map(F.lit, ["The Post", "Daily", "the post", "Wire.com", None]))
    assert spark.range(1).select(dedup.corroborators(names, F.array(F.lit("Wire"))).alias("c")).first()["c"] == ["the post", "Daily"]


def test_clusters_in_order_and_window(spark):
    t = dt.datetime(2026, 8, 17)
    rows = [(0, "alpha beta gamma delta", t), (1, "Alpha beta gamma!", t - dt.timedelta(hours=2)), (2, "alpha beta gamma delta", t - dt.timedelta(days=16)), (3, "unrelated words here", t), (4, "", t), (5, "", t), (6, "alpha beta gamma", None), (7, "alpha beta gamma", None)]
    df = spark.createDataFrame([("b", *r) for r in rows], "batch string, id int, title string, at timestamp")
    got = {r["id"]: r["cluster"] for r in cluster.cluster_greedy(df, "batch", "id", "title", "at", ["id"]).collect()}
    assert got[0] == got[1] and len({got[k] for k in (0, 2, 3, 4, 5, 6)}) == 6 and got[6] == got[7]
    pairs = {(r["a"], r["b"]) for r in cluster.similar_pairs(df, "batch", "id", "title", "at").collect()}
    assert pairs == {(0, 1), (6, 7)}


def test_similar_pairs_equal_all_pairs(spark):
    """Also for titles that are alike only in words that very many titles have, and across slots of time."""
    r, t = random.Random(3), dt.datetime(2026, 8, 17)
    common = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, " ".join(r.sample(common, r.randint(0, 3)) + [f"w{r.randint(0, 30)}" for _ in range(r.randint(0, 4))]), t + dt.timedelta(hours=r.randint(0, 400)) if r.random() < 0.95 else None) for i in range(160)]
    tokens = {i: {w for w in title.split() if len(w) > 2} for i, title, _ in rows}
    at = {i: a or dt.datetime(2000, 1, 1) for i, _, a in rows}
    want = set()
    for a in range(160):
        for b in range(a + 1, 160):
            both = len(tokens[a] & tokens[b])
            if both >= 2 and both / len(tokens[a] | tokens[b]) >= 0.32 and abs(at[a] - at[b]) <= dt.timedelta(hours=60):
                want.add((a, b))
    df = spark.createDataFrame([("b", *x) for x in rows], "batch string, id int, title string, at timestamp")
    assert {(x["a"], x["b"]) for x in cluster.similar_pairs(df, "batch", "id", "title", "at").collect()} == want and len(want) > 50


def test_spells_do_not_change_clusters(spark):
    r, t = random.Random(7), dt.datetime(2026, 8, 17)
    rows = [(i, " ".join(r.sample("alpha beta gamma delta epsilon zeta".split(), 3)), t + dt.timedelta(hours=r.choice([0, 30, 59, 200, 230, 900]) + r.random())) for i in range(120)]
    df = spark.createDataFrame([("b", *x) for x in rows], "batch string, id int, title string, at timestamp")
    got = {x["id"]: x["cluster"] for x in cluster.cluster_greedy(df, "batch", "id", "title", "at", ["id"]).collect()}
    assert [got[i] for i in range(120)] == cluster.fold([set(x[1].split()) for x in rows], [x[2].timestamp() for x in rows], 0.32, 2, 60 * 3600)


def test_many_equal_ids(spark):
    ids = [(i, "x") for i in range(100_000)] + [(200_000 + k, f"x-{n}") for k, n in enumerate((2, 3, 7, 50_000, 100_001, 1, 100_003))] + [(300_000, "x-7")]
    got = {r["pos"]: r["id"] for r in dedup.suffix_collisions(spark.createDataFrame(ids, "pos int, id string"), "id", ["pos"]).collect()}
    taken, n = {f"x-{k}" for k in (2, 3, 7, 50_000, 100_001, 1, 100_003)}, 2
    for i in range(1, 100_000):
        while f"x-{n}" in taken:
            n += 1
        assert got[i] == f"x-{n}"
        n += 1
    assert got[0] == "x" and got[200_001] == "x-3" and got[300_000] == "x-7-2"


def test_labels_listing_and_covers(spark):
    beats = C.beats(spark, BEATS)
    stories = spark.createDataFrame([(dt.date(2026, 8, d), p, "lead", f"h{d}{p}", b) for d in range(1, 6) for p, b in enumerate(["models", "gone"])], "date date, pos int, prominence string, headline string, beat string")
    assert {r["beat"]: r["beat_label"] for r in archive.with_label(stories, beats).collect()} == {"models": "Models", "gone": "gone"}
    editions = stories.select("date").distinct().withColumn("number", F.dayofmonth("date")).withColumn("title", F.lit("t"))
    assert [(r["number"], r["headline"]) for r in archive.recent_stories(editions, stories).collect()] == [(d, f"h{d}{p}") for d in (5, 4, 3) for p in (0, 1)]
    choice = spark.range(1).select(hashing.cover_choice(F.lit("seed"), F.array(*map(F.lit, "abc"))).alias("c"), hashing.cover_choice(F.lit("seed"), F.lit(None).cast("array<string>")).alias("n")).first()
    drawn = hashing.draws(hashing.hash32_of("seed"), 14)
    assert choice["c"]["plate"] == int(drawn[12] * 100) == choice["n"]["plate"] and choice["c"]["motif"] == "abc"[int(drawn[13] * 3)] and choice["n"]["motif"] is None


def test_gate_stops_at_the_shape(spark):
    editions = spark.createDataFrame([(dt.date(2026, 8, d), dt.date(2026, 8, 9), d, "h") for d in (1, 2)], "date date, file_date date, number int, hash string")
    source = "array<struct<title string, publisher string, url string, publishedAt timestamp, tier int>>"
    ddl = f"date date, pos int, id string, slug string, beat string, headline string, deck string, summary array<string>, body array<string>, whyItMatters string, prominence string, readMinutes int, confidence string, entities array<string>, sources {source}"
    stories = spark.createDataFrame([(dt.date(2026, 8, d), 0, f"2026-08-0{d}-a", "a", "models", "H", "d", [], [], "w", "lead", 1, "high", [], []) for d in (1, 2)], ddl)
    bad = spark.createDataFrame([(dt.date(2026, 8, 1), "/edition/title", "required")], "date date, path string, keyword string")
    reviews = spark.createDataFrame([(dt.date(2026, 8, 1), True, "h", False), (dt.date(2026, 8, 2), True, "other", False)], "date date, reviewed boolean, sha256 string, readable boolean")
    found = validate.validate(editions, stories, C.beats(spark, BEATS), C.publishers(spark, BOOK), C.blocked(spark, BOOK), reviews=reviews, breaches=bad)
    by = {}
    for r in found.collect():
        by.setdefault(r["date"].day, set()).add((r["rule"], r["severity"]))
    assert by[1] == {("V1", "E")} and ("V2", "E") in by[2] and ("V40", "E") in by[2]
    told = {r["date"].day: (r["errors"], r["warnings"]) for r in validate.results(found, editions).collect()}
    assert told[1] == (["V1 /edition/title required"], []) and len(told[2][0]) > 3
    report = validate.report(found, strict=True, ran_at="now").first()
    assert (report["ran_at"], report["strict"], report["passed"]) == ("now", True, False) and report["total_errors"] == sum(len(e) for e, _ in told.values())


def test_headline_terms(spark):
    p = C.Patterns()
    rows = [("Council fined £2 million", 1.0, 0.0), ("Proud to serve: our people", 0.2, 0.0), ("A plain headline", 0.5, 0.0), ("Trams stop  working in the snow", 0.5, 1.0), ("Harvest down 3%", 0.75, 0.0), ("Museum opens new wing, on sale today", 0.75, 0.6), ("The designs", 0.5, 0.0), (None, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "t string, s double, u double")
    for r in df.select("t", "s", "u", rank.substance(F.col("t"), F.lit(False), p).alias("s2"), rank.urgency(F.col("t"), F.lit(1.0), p).alias("u2")).collect():
        assert r["s2"] == pytest.approx(r["s"]) and r["u2"] == r["u"], r["t"]
    assert df.select(rank.urgency(F.lit("explosion"), F.lit(0.5), p).alias("u")).first()["u"] == 0.5


def test_scores_and_confidence(spark):
    now = dt.datetime(2026, 8, 17, 12)
    rows = [
        ("a", 1, "Big fine filed", "https://p.example/1", now, 1, "P", "p.example", "b", True, False),
        ("a", 2, "Big fine filed", "https://q.example/1", now, 2, "Q", "q.example", "b", True, False),
        ("c", 3, "Our programme", "https://r.example/1", now, 1, "R", "r.example", "b", True, True),
        ("d", 4, "A paper", "https://arxiv.org/1", None, 1, "arXiv", "arxiv.org", "c", True, False),
    ]
    df = spark.createDataFrame(rows, "cluster string, pos int, title string, url string, published_at timestamp, tier int, publisher string, host string, beat string, citable boolean, seen boolean").withColumn("id", F.col("pos"))
    got = {r["cluster"]: r for r in rank.score_clusters(rank.cluster_stats(df, ["cluster"]), F.lit(now), 48).collect()}
    assert got["a"]["score"] == pytest.approx(0.26 * 2 / 3 + 0.20 * 0.5 + 0.18 + 0.16 + 0.06 + 0.02 + 0.2 * 0.0, abs=0.06)
    assert got["c"]["first_party"] and not got["d"]["first_party"] and got["c"]["novelty"] == 0 and got["d"]["recency"] == 0
    assert got["a"]["score"] > got["c"]["score"]
    c = df.groupBy().agg(rank.confidence(F.lit(2), F.lit(2)).alias("x"), rank.confidence(F.lit(2), F.lit(3)).alias("y"), rank.confidence(F.lit(1), F.lit(1)).alias("z")).first()
    assert tuple(c) == ("confirmed", "single-source", "single-source")


def test_caps(spark):
    rows = [(i, "s", 100 - i) for i in range(10)] + [(20, None, 5), (21, "t", 1)]
    df = spark.createDataFrame(rows, "id int, source string, v int")
    assert select.top_per_group(df, [F.coalesce("source", F.lit(""))], [F.col("v").desc()], 5, 6).count() == 6
    assert [r["id"] for r in select.top_per_group(df, [F.coalesce("source", F.lit(""))], [F.col("v").desc()], 5, 24).collect()] == [0, 1, 2, 3, 4, 20, 21]


def test_feed_health(spark):
    at = lambda i: dt.datetime(2026, 8, 1) + dt.timedelta(hours=i)
    rows = [("a", at(i), i == 2, i, None if i == 2 else f"e{i}") for i in range(11)] + [("b", at(i), False, 0, "x") for i in range(3)] + [("c", at(0), True, 7, None)]
    runs = spark.createDataFrame(rows, "feed string, run_at timestamp, ok boolean, n int, error string")
    got = {r["feed"]: r for r in archive.feed_health(runs).collect()}
    assert (got["a"]["consecutive_failures"], got["a"]["total_runs"], got["a"]["dead"], got["a"]["last_error"]) == (8, 11, True, "e10")
    assert (got["b"]["consecutive_failures"], got["b"]["dead"], got["b"]["last_ok"]) == (3, False, None) and got["c"]["consecutive_failures"] == 0
    assert [r["streak"] for r in archive.feed_history(runs).where("feed = 'a'").orderBy("run_at").collect()] == [1, 2, 0, 1, 2, 3, 4, 5, 6, 7, 8]


def test_restated_and_shared_runs(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma delta epsilon"), (3, "zeta theta iota"), (4, "Alpha beta gamma delta"), (5, "")], "id int, t string")
    got = {r["id"]: r["earlier"] for r in similarity.first_restated(docs, "id", F.col("t"), "id").collect()}
    assert got == {2: 1, 4: 1}
    a, b = "x one two three four five six seven eight nine y", "q one two three four five six seven eight nine z one two"
    left, right = spark.createDataFrame([(1, a), (2, "one two three")], "id int, t string"), spark.createDataFrame([(7, b)], "i2 int, t2 string")
    assert [tuple(r) for r in similarity.shared_runs(left, right, "id", F.col("t"), "i2", F.col("t2")).collect()] == [(1, 7, 9, 10)]
    run = spark.range(1).select(validate.longest_run(T.word_list(F.lit(a)), T.word_list(F.lit(b))).alias("r")).first()["r"]
    assert run == "one two three four five six seven eight nine".split()


SCHEMA = {
    "type": "object",
    "required": ["name"],
    "additionalProperties": False,
    "properties": {"name": {"type": "string", "minLength": 2}, "age": {"type": "integer", "minimum": 0}, "mail": {"$ref": "#/$defs/mail", "maxLength": 8}, "extra": {"type": "object", "additionalProperties": {"type": "integer"}}, "tags": {"type": "array", "maxItems": 2, "items": {"enum": ["a", "b"]}}, "at": {"type": "string", "format": "date-time"}},
    "$defs": {"mail": {"type": "string", "pattern": "@"}},
}


@pytest.mark.parametrize(
    ("doc", "want"),
    [
        ({"name": "xy"}, []),
        ({}, [("/name", "required")]),
        ({"name": 5, "zip": 1}, [("/name", "type"), ("/zip", "additionalProperties")]),
        ({"name": "x", "age": -1.0}, [("/name", "minLength"), ("/age", "minimum")]),
        ({"name": "xy", "age": True}, [("/age", "type")]),
        ({"name": "xy", "mail": "no", "tags": ["a", "c", "b"]}, [("/mail", "pattern"), ("/tags", "maxItems"), ("/tags/1", "enum")]),
        ({"name": "xy", "at": "2026-08-17T10:00:00Z"}, []),
        ({"name": "xy", "at": "today"}, [("/at", "format")]),
        ({"name": "xy", "mail": "a@" + "b" * 9}, [("/mail", "maxLength")]),
        ({"name": "xy", "extra": {"a": 1, "b": "x"}}, [("/extra/b", "type")]),
        ([], [("", "type")]),
    ],
)
def test_schema(doc, want):
    assert list(jsonschema.breaches(doc, SCHEMA)) == want


def test_compiled_schema_equals_the_plain_rules(spark):
    """Invented documents, most of them broken somewhere; the expressions against the rules one document at a time."""
    rng = random.Random(5)
    name = {"type": ["string", "null"], "pattern": "^[a-z]+$", "minLength": 2}
    leaf = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "integer", "minimum": 1, "maximum": 9}, "url": {"type": "string", "format": "uri"}, "kind": {"const": "x"}, "who": {"$ref": "#/$defs/name", "maxLength": 4}}}
    schema = {"type": "object", "required": ["list", "a b"], "properties": {"list": {"type": "array", "minItems": 1, "maxItems": 3, "items": leaf}, "a b": {"enum": ["s", 1.5, None, [1, "é"], {"k": 1}]}, "m": {"type": "object", "additionalProperties": {"type": "array", "items": {"type": "number"}}}, "at": {"format": "date-time"}}, "additionalProperties": {"type": "boolean"}, "$defs": {"name": name}}
    scalars = [None, True, False, 0, 1, 5, 10, 2.0, 1.5, -3, 1e300, "", "s", "x", "abc", "abcde", "https://a.example/1", "a:b", "2026-08-17T10:00:00Z", "2026-13-17T10:00:00Z", "2026-08-17T10:00:00+02:00", "2026-08-17", [], {}, [1, "é"], {"k": 1}]
    some = lambda: rng.choice(scalars)
    pick = lambda names, value: {k: value(k) for k in names if rng.random() < 0.7}
    item = lambda: rng.choice([some(), pick(["id", "url", "kind", "who", "zz"], lambda k: rng.choice([some(), 3 if k == "id" else "x"]))]) if rng.random() < 0.3 else pick(["id", "url", "kind", "who"], lambda k: {"id": 3, "url": "https://a.example", "kind": "x", "who": "ab"}[k] if rng.random() < 0.7 else some())
    values = {"list": lambda: [item() for _ in range(rng.randint(0, 4))], "m": lambda: pick(["p", "q'"], lambda k: [some() for _ in range(2)]), "a b": some, "at": some, "more": some}
    docs = [pick(values, lambda k: values[k]() if rng.random() < 0.9 else some()) if rng.random() < 0.95 else some() for _ in range(400)]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, raw string")
    checked = rows.select("i", jsonschema.schema_breaches(F.col("raw"), schema).alias("b"))
    assert "Python" not in checked._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: sorted((b["path"], b["keyword"]) for b in r["b"]) for r in checked.collect()}
    want = {i: sorted(jsonschema.breaches(d, schema)) for i, d in enumerate(docs)}
    assert got == want and {k for b in want.values() for _, k in b} >= {"type", "enum", "const", "required", "additionalProperties", "minItems", "maxItems", "minimum", "maximum", "pattern", "format", "maxLength"}
    with pytest.raises(ValueError):
        jsonschema.schema_breaches(F.col("raw"), {"$ref": "#/$defs/n", "$defs": {"n": {"properties": {"next": {"$ref": "#/$defs/n"}}}}})


def test_schema_over_documents(spark):
    docs = spark.createDataFrame([("d1", '{"name":"xy"}'), ("d2", '{"name":1}'), ("d3", "{"), ("d4", None)], "date string, raw string")
    good, bad = jsonschema.conforming(docs, "raw", SCHEMA)
    assert [r["date"] for r in good.collect()] == ["d1"]
    assert sorted(tuple(r) for r in bad.collect()) == [("d2", "/name", "type"), ("d3", "", "json"), ("d4", "", "json")]
    with pytest.raises(ValueError):
        jsonschema.schema_breaches(F.col("raw"), {"oneOf": []})
    with pytest.raises(ValueError):
        jsonschema.schema_breaches(F.col("raw"), {"additionalProperties": {"anyOf": []}})


def test_reviews(spark):
    got = archive.review(spark.createDataFrame([(5, 5, 5, 3, 3), (5, 5, 5, 5, 2), (4, 4, 4, 4, 3)], "a int, b int, c int, d int, e int"), list("abcde")).collect()
    assert [(r["total"], r["passed"]) for r in got] == [(21, True), (22, False), (19, False)]


def test_vocabulary_rows_are_not_sorted_or_joined_by_word(spark):
    """A word is single by ids, not by rows; the rows of the result come after the last join, and ids of any kind are told apart."""
    rows = [("a", 0, "shared alpha", ""), ("b", 1, "shared bravos", "alpha"), ("b", 2, "bravo label", "bravo"), (None, 3, "lonely", ""), ("c", 4, "", "charlie")]
    beats = spark.createDataFrame([(i, p, t, "", [k] if k else [], ["query words"]) for i, p, t, k in rows], "id string, pos int, label string, blurb string, keywords array<string>, queries array<string>")
    got = lookup.beat_vocabulary(beats)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and "min(id" not in plan
    found = {(x.pos, x.token): (x.beat, x.vocab_size, x.distinctive) for x in got.collect()}
    assert {k for k, v in found.items() if v[2]} == {(1, "alpha"), (2, "bravo"), (4, "charlie")}
    assert found[0, "alpha"] == ("a", 4, False) and found[1, "bravo"] == ("b", 3, False) and found[3, "lonely"] == (None, 3, False)


def test_signals_of_dates_and_the_whole(spark):
    """Nulls of every column, a value on several dates; a citation gives a row for each of its four values, not one for each count of both levels."""
    r = random.Random(3)
    some = lambda v: None if r.random() < 0.1 else v
    rows = [(some(dt.date(2026, 1, r.randint(1, 4))), some(r.randint(0, 9)), some(f"b{r.randint(0, 3)}"), some(r.randint(0, 30)), some(f"p{r.randint(0, 9)}"), some(r.randint(1, 3))) for _ in range(300)]
    df = archive.edition_signals(spark.createDataFrame(rows, "date date, story long, beat string, url long, publisher string, tier int"))
    n = lambda part, k: len({x[k] for x in part} - {None})
    told = lambda part: (len({x[:2] for x in part if None not in x[:2]}), n(part, 3), sum(x[5] == 1 for x in part), n(part, 4), n(part, 2))
    wanted = {(d, 0): told([x for x in rows if x[0] == d]) for d in {x[0] for x in rows}} | {(None, 1): told(rows)}
    assert {(x.date, x.is_total): (x.stories, x.urls, x.primary_sources, x.publishers, x.beats) for x in df.collect()} == wanted and df.count() == len(wanted)
    assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_copied_words_are_cut_once(spark):
    """Titles and fields are cut at one place of the plan each, wherever their words are used; the run and its words stay the same."""
    said = "one two three four five six seven eight nine"
    rows = [(dt.date(2026, 1, 1), "a", "Head", "deck", ["Then " + said + " ten"], [], ["en"], [(said.upper(),), ("short title",)]), (dt.date(2026, 1, 1), "b", None, "deck", None, None, None, [(None,)]), (dt.date(2026, 1, 1), "c", said, "deck", None, None, None, None)]
    stories = spark.createDataFrame(rows, "date date, id string, headline string, deck string, summary array<string>, body array<string>, entities array<string>, sources array<struct<title string>>")
    got = validate.copied_rules(stories)
    assert [(x.story, x.rule, x.detail) for x in got.collect()] == [("a", "V34", said)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9") == 2
