"""Queries for archives, entities, feed health, reviews, sinks and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom import config as C
from newsloom.config import TEST
from newsloom.operators import archive, jsonschema, pages, select, validate
from newsloom.plans.adapters import MENTIONS, citations, edition_stories, feed_runs, mentions, order_stories, table
from newsloom.plans.pipeline_queries import BEATS, HOSTED
from newsloom.plans.registry import query
from newsloom.plans.text_queries import HOST, LINT, STOP, sql_overlap_tokens, sql_words
from newsloom.session import shared_folder
from newsloom.sources import sinks
from newsloom.sources.totals import ArchiveTotals

# editions ---------------------------------------------------------------------------------------


@query(
    "edition_signals",
    """SELECT date, count(DISTINCT story) AS stories, count(DISTINCT url) AS urls, count(*) FILTER (tier = 1) AS primary_sources, count(DISTINCT publisher) AS publishers, count(DISTINCT beat) AS beats, CAST(grouping(date) AS TINYINT) AS is_total
FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS story, o_orderpriority AS beat, l_partkey AS url, l_suppkey AS publisher, l_linenumber AS tier FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY GROUPING SETS ((date), ())""",
)
def edition_signals(spark, sf_dir):
    return archive.edition_signals(citations(spark, sf_dir))


@query(
    "archive_totals",
    """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS story, o_orderpriority AS beat, l_partkey AS url, l_suppkey AS publisher, l_linenumber AS tier FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT date, count(DISTINCT story) AS stories, count(DISTINCT url) AS urls, count(*) FILTER (tier = 1) AS primary_sources, count(DISTINCT publisher) AS publishers, count(DISTINCT beat) AS beats FROM c GROUP BY date)
SELECT date, stories, urls AS sources, urls, primary_sources, publishers, beats, CAST(0 AS TINYINT) AS is_total FROM d
UNION ALL SELECT NULL, (SELECT CAST(sum(stories) AS BIGINT) FROM d), (SELECT CAST(sum(urls) AS BIGINT) FROM d), count(DISTINCT url), count(*) FILTER (tier = 1), count(DISTINCT publisher), count(DISTINCT beat), CAST(1 AS TINYINT) FROM c""",
)
def archive_totals(spark, sf_dir):
    """The first half of each month's dates are added, then the other half; totals come from what the dates left."""
    c = citations(spark, sf_dir)
    kept = ArchiveTotals(spark, f"{shared_folder(spark)}/totals-{uuid.uuid4().hex}", buckets=2)
    early = F.dayofmonth("date") <= 15
    kept.add(c.where(early))
    kept.add(c.where(~early))
    return kept.signals()


@query(
    "archive_dates",
    """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS stories FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS digest_items FROM lineitem GROUP BY 1), c AS (SELECT CAST(ts AS DATE) AS date, count(*) AS wire_items FROM events GROUP BY 1)
SELECT date, stories, digest_items, wire_items FROM a FULL JOIN b USING (date) FULL JOIN c USING (date)""",
)
def archive_dates(spark, sf_dir):
    n = lambda t, c: table(spark, sf_dir, t).groupBy(F.to_date(c).alias("date")).agg(F.count("*").alias("n"))
    return archive.archive(n("orders", "o_orderdate"), n("lineitem", "l_shipdate"), n("events", "ts"))


@query("document_neighbours", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT date, lag(date) OVER (ORDER BY date) AS prev, lead(date) OVER (ORDER BY date) AS next FROM d")
def document_neighbours(spark, sf_dir):
    return select.neighbours(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct())


@query("next_edition_number", "SELECT max(o_orderkey) + 1 AS next_number FROM orders")
def next_edition_number(spark, sf_dir):
    return archive.next_number(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number")))


@query(
    "related_stories",
    """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS id, o_orderpriority AS beat FROM orders)
SELECT date, id, rank, other FROM (SELECT a.date, a.id, b.id AS other, CAST(row_number() OVER (PARTITION BY a.date, a.id ORDER BY (a.beat = b.beat)::INT DESC, b.id) AS INTEGER) AS rank FROM s a JOIN s b ON a.date = b.date AND a.id <> b.id) WHERE rank <= 5""",
)
def related_stories(spark, sf_dir):
    return select.related(order_stories(spark, sf_dir))


@query(
    "front_page",
    """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'lead' WHEN 1 THEN 'top' WHEN 2 THEN 'standard' ELSE 'brief' END AS prominence, CAST(o_orderkey % 4 AS INTEGER) AS level FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY (prominence = 'lead') DESC, id) = 1 AS is_lead FROM s)
SELECT date, id, level, is_lead, CASE WHEN is_lead THEN 'lead' WHEN prominence = 'brief' THEN 'brief' ELSE 'section' END AS slot FROM r""",
)
def front_page(spark, sf_dir):
    return select.front_page(order_stories(spark, sf_dir)).select("date", "id", "level", "is_lead", "slot")


@query("prominence_counts", "SELECT CAST(o_orderdate AS DATE) AS date, count(*) FILTER (o_orderkey % 4 = 0) AS lead, count(*) FILTER (o_orderkey % 4 = 1) AS top, count(*) FILTER (o_orderkey % 4 = 3) AS brief FROM orders GROUP BY 1")
def prominence_counts(spark, sf_dir):
    n = lambda p: F.count_if(F.col("prominence") == p).alias(p)
    return order_stories(spark, sf_dir).groupBy("date").agg(n("lead"), n("top"), n("brief"))


@query(
    "beat_coverage",
    f"""WITH beats(pos, id, label, blurb, keywords, queries, quota, min_quota, digest_quota) AS (SELECT * FROM {BEATS}), n AS (SELECT CASE lang WHEN 'en' THEN 'north' WHEN 'de' THEN 'east' ELSE 'nowhere' END AS id, count(*) AS n FROM documents GROUP BY 1)
SELECT id AS beat, coalesce(n, 0) AS n, quota, min_quota, coalesce(n, 0) < min_quota AS short, coalesce(n, 0) < quota AS under FROM beats LEFT JOIN n USING (id)""",
)
def beat_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "north").when(F.col("lang") == "de", "east").otherwise("nowhere").alias("beat"))
    return archive.beat_coverage(d, C.beats(spark, TEST))


@query("story_chips", "SELECT l_orderkey AS story, array_to_string(list_slice(s, 1, 4), ',') AS shown, CAST(greatest(0, len(s) - 4) AS INTEGER) AS more FROM (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1)")
def story_chips(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("story")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    chips = select.chips(F.col("s"))
    return per.select("story", F.array_join(chips["shown"].cast("array<string>"), ",").alias("shown"), chips["more"].alias("more"))


# entities ---------------------------------------------------------------------------------------


@query("entity_index", f"WITH {MENTIONS} SELECT slug, arg_min(name, (date, pos)) AS name, count(*) AS n, max(date) AS last FROM mentions GROUP BY slug")
def entity_index(spark, sf_dir):
    return archive.entity_index(mentions(spark, sf_dir))


@query("entity_items", f"WITH {MENTIONS} SELECT slug, pos, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY date DESC, pos) AS rank FROM mentions) WHERE rank <= 20")
def entity_items(spark, sf_dir):
    return archive.entity_items(mentions(spark, sf_dir), 20).select("slug", "pos", "rank")


@query("hot_entities", f"WITH {MENTIONS}, d AS (SELECT DISTINCT date FROM mentions ORDER BY date DESC LIMIT 5) SELECT slug, count(*) AS n FROM mentions WHERE date IN (SELECT date FROM d) GROUP BY slug ORDER BY n DESC, slug LIMIT 8")
def hot_entities(spark, sf_dir):
    return archive.hot_entities(mentions(spark, sf_dir))


# feeds and reviews ------------------------------------------------------------------------------

_RUNS = "runs AS (SELECT user_id AS feed, event_id AS id, ts, event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error FROM events)"


@query(
    "feed_health",
    f"""WITH {_RUNS}, o AS (SELECT feed, max(ts) FILTER (ok) AS last_ok FROM runs GROUP BY feed), k AS (SELECT *, sum(ok::INT) OVER (PARTITION BY feed ORDER BY ts DESC, id DESC) AS later FROM runs)
SELECT feed, count(*) AS total_runs, count(*) FILTER (NOT ok AND later = 0) AS consecutive_failures, max(o.last_ok) AS last_ok, arg_max(error, (ts, id)) FILTER (NOT ok) AS last_error, arg_max(id, (ts, id)) AS last_count, count(*) FILTER (NOT ok AND later = 0) >= 8 AS dead
FROM k JOIN o USING (feed) GROUP BY feed""",
)
def feed_health(spark, sf_dir):
    return archive.feed_health(feed_runs(spark, sf_dir)).withColumn("last_ok", F.col("last_ok.ts"))


@query(
    "feed_history",
    f"""WITH {_RUNS}, s AS (SELECT *, count(*) OVER w AS total_runs, coalesce(sum(ok::INT) OVER w, 0) AS spell FROM runs WINDOW w AS (PARTITION BY feed ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
SELECT feed, id AS n, total_runs, CAST(sum((NOT ok)::INT) OVER (PARTITION BY feed, spell ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak, last_value(error IGNORE NULLS) OVER (PARTITION BY feed ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS last_error FROM s""",
)
def feed_history(spark, sf_dir):
    return archive.feed_history(feed_runs(spark, sf_dir)).select("feed", "n", "total_runs", "streak", "last_error")


@query("run_metrics", "SELECT CAST(ts AS DATE) AS date, count(*) AS feeds, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, CAST(sum(event_id) AS BIGINT) AS items, bool_and(event_type = 'error') AS all_failed FROM events GROUP BY 1")
def run_metrics(spark, sf_dir):
    runs = feed_runs(spark, sf_dir).withColumn("date", F.to_date("run_at.ts"))
    return archive.run_metrics(runs, ["date"])


@query("newest_snapshots", "SELECT CAST(ts AS DATE) AS date, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def newest_snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.struct("ts", "event_id").alias("harvested_at"), "event_id")
    return archive.newest_snapshot(e).select("date", "event_id")


@query(
    "review_scores",
    "SELECT l_orderkey, l_linenumber, CAST(a + b + c + d + e AS INTEGER) AS total, CAST(least(a, b, c, d, e) AS INTEGER) AS least, a + b + c + d + e >= 20 AND least(a, b, c, d, e) >= 3 AS passed FROM (SELECT *, 1 + l_partkey % 5 AS a, 3 + l_suppkey % 3 AS b, 4 AS c, 3 + l_orderkey % 3 AS d, 5 AS e FROM lineitem)",
)
def review_scores(spark, sf_dir):
    marks = {"a": "1 + l_partkey % 5", "b": "3 + l_suppkey % 3", "c": "4", "d": "3 + l_orderkey % 3", "e": "5"}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(f"cast({x} as int)").alias(k) for k, x in marks.items()])
    return archive.review(rows, list(marks)).select("l_orderkey", "l_linenumber", "total", "least", "passed")


@query(
    "review_binding",
    "SELECT doc_id AS date, CASE WHEN quality IS NULL THEN 'missing' WHEN toxic = 1 THEN 'unbound' WHEN quality = 0 THEN 'mismatch' ELSE 'bound' END AS state FROM documents LEFT JOIN labels USING (doc_id)",
)
def review_binding(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("date"), F.sha2(F.col("doc_id").cast("string"), 256).alias("hash"))
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("date"), F.lit(True).alias("reviewed"), F.when(F.col("toxic") == 1, None).when(F.col("quality") == 0, F.lit("other")).otherwise(F.sha2(F.col("doc_id").cast("string"), 256)).alias("sha256"))
    return archive.review_binding(l, e)


@query("open_listings", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS deadline FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-01-01'")
def open_listings(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("deadline"), F.col("o_orderkey").alias("name"))
    return archive.open_listings(rows, "1998-01-01").select("id", "deadline")


# sinks ------------------------------------------------------------------------------------------


@query("retained_rows", "SELECT event_id FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') <= 14")
def retained_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    return sinks.retained(e, "2024-01-30").select("event_id")


@query("expired_dates", "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-30') > 14")
def expired_dates(spark, sf_dir):
    return sinks.expired_dates(table(spark, sf_dir, "events").withColumn("date", F.to_date("ts")), "2024-01-30")


@query("orphan_outputs", "SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_outputs(spark, sf_dir):
    key = F.col("doc_id").alias("key")
    return sinks.orphans(table(spark, sf_dir, "documents").select(key), table(spark, sf_dir, "labels").select(key), "key")


@query(
    "lock_changes",
    "WITH a AS (SELECT page_id AS id, length(html) AS new FROM pages), b AS (SELECT doc_id AS id, n_chars AS old FROM documents), c AS (SELECT doc_id AS id, n_chars AS new FROM documents UNION ALL SELECT -1 - id, new FROM a), "
    "d AS (SELECT id, old FROM b JOIN labels ON id = doc_id UNION ALL SELECT -2 - id, new FROM a) "
    "SELECT id, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'gone' WHEN old <> new THEN 'changed' ELSE 'same' END AS state FROM c FULL JOIN d USING (id)",
)
def lock_changes(spark, sf_dir):
    """Documents against those that have labels, and pages against themselves moved on by one."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("hash"))
    p = table(spark, sf_dir, "pages").select("page_id", F.char_length("html").cast("long").alias("hash"))
    known = d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return sinks.lock_changes(d.unionAll(p.select(-1 - F.col("page_id"), "hash")), known.unionAll(p.select(-2 - F.col("page_id"), "hash")))


@query(
    "rss_feed",
    """SELECT CAST(ts AS DATE) AS date, event_id AS pos, '<item><title>' || event_type || '</title><link>https://n.example/' || event_id || '</link><pubDate>' || strftime(ts, '%d %b %Y %H:%M:%S') || ' GMT</pubDate><description>' || event_type || ' ' || replace(replace(props, '&', '&amp;'), '"', '&quot;') || '</description></item>' AS xml
FROM events ORDER BY date DESC, pos LIMIT 60""",
)
def rss_feed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select(F.to_date("ts").alias("date"), F.col("event_id").alias("pos"), F.col("event_type").alias("headline"), F.col("event_type").alias("deck"), F.array("props").alias("summary"), F.concat(F.lit("https://n.example/"), F.col("event_id").cast("string")).alias("url"), F.col("ts").alias("published_at"), F.col("ts").alias("generated_at"))
    return sinks.rss_items(s)


@query("sitemap", "SELECT url AS loc, CAST(NULL AS DATE) AS lastmod, 'daily' AS changefreq, '0.8' AS priority FROM pages UNION ALL SELECT 'https://n.example/' || r_name, DATE '2024-01-01', 'weekly', '0.5' FROM region")
def sitemap(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("url").alias("loc"), F.lit(None).cast("date").alias("lastmod"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("https://n.example/"), "r_name").alias("loc"), F.lit("2024-01-01").cast("date").alias("lastmod"))
    return sinks.sitemap([(p, "daily", "0.8"), (r, "weekly", "0.5")])


@query(
    "site_map",
    """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), e AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), w AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT 'https://n.example/' || path AS loc, lastmod, changefreq, priority FROM (
  SELECT unnest(['', 'archive.html', 'topics.html', 'hackathons.html', 'methodology.html', 'legal.html', 'terms.html', 'privacy.html', 'digest.html']) AS path, CAST(NULL AS DATE) AS lastmod,
    unnest(['daily', 'daily', 'daily', 'weekly', 'monthly', 'yearly', 'yearly', 'yearly', 'hourly']) AS changefreq, unnest(['1.0', '0.6', '0.6', '0.7', '0.4', '0.3', '0.2', '0.2', '0.6']) AS priority
  UNION ALL SELECT 'digest/' || strftime(date, '%Y-%m-%d') || '.html', date, 'weekly', '0.4' FROM d UNION ALL SELECT 'wire/' || strftime(date, '%Y-%m-%d') || '.html', date, 'yearly', '0.2' FROM w
  UNION ALL SELECT 'entity/' || lower(n_name) || '.html', max(CAST(o_orderdate AS DATE)), 'weekly', '0.5' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
  UNION ALL SELECT 'edition/' || strftime(date, '%Y-%m-%d') || '.html', date, 'monthly', '0.7' FROM e UNION ALL SELECT 'story/' || o_orderkey, CAST(o_orderdate AS DATE), 'monthly', '0.8' FROM orders)""",
)
def site_map(spark, sf_dir):
    days = lambda t, c: table(spark, sf_dir, t).select(F.to_date(c).alias("date")).distinct()
    stories = table(spark, sf_dir, "orders").select(F.concat(F.lit("story/"), F.col("o_orderkey").cast("string")).alias("path"), F.to_date("o_orderdate").alias("date"))
    return sinks.site_map(spark, "https://n.example", days("orders", "o_orderdate"), stories, archive.entity_index(mentions(spark, sf_dir)), days("events", "ts"), days("lineitem", "l_shipdate"))


@query(
    "manifest",
    """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS story, o_orderpriority AS beat, l_partkey AS url, l_suppkey AS publisher, l_linenumber AS tier FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT date, count(DISTINCT story) AS stories, count(DISTINCT url) AS urls, count(*) FILTER (tier = 1) AS primary_sources, count(DISTINCT publisher) AS publishers, count(DISTINCT beat) AS beats FROM s GROUP BY date),
e AS (SELECT CAST(o_orderdate AS DATE) AS date, min(o_orderkey) AS number, arg_min(o_orderpriority, o_orderkey) AS title FROM orders GROUP BY 1)
SELECT e.*, 'https://n.example/edition/' || strftime(date, '%Y-%m-%d') || '.html' AS url, 'https://n.example/generated/' || strftime(date, '%Y-%m-%d') || '.json' AS data, stories, urls, primary_sources, publishers, beats FROM e LEFT JOIN g USING (date)""",
)
def manifest(spark, sf_dir):
    return archive.manifest(_editions(spark, sf_dir), archive.edition_signals(citations(spark, sf_dir)), "https://n.example")


def _editions(spark, sf_dir) -> DataFrame:
    day = F.to_date("o_orderdate").alias("date")
    o = table(spark, sf_dir, "orders").groupBy(day)
    return o.agg(F.min("o_orderkey").alias("number"), F.min_by("o_orderpriority", "o_orderkey").alias("title"), F.max("o_orderdate").alias("generated_at"))


@query("manifest_head", "SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS edition_count, max(CAST(o_orderdate AS DATE)) AS latest, max(o_orderdate) AS built_at, count(*) AS story_count FROM orders")
def manifest_head(spark, sf_dir):
    return archive.manifest_head(_editions(spark, sf_dir), order_stories(spark, sf_dir))


@query(
    "recent_stories",
    """WITH s AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'lead' WHEN 1 THEN 'top' WHEN 2 THEN 'standard' ELSE 'brief' END AS prominence, o_orderpriority AS headline FROM orders),
e AS (SELECT date, min(pos) AS number, arg_min(headline, pos) AS title FROM s GROUP BY date ORDER BY date DESC LIMIT 3) SELECT date, number, title, pos, prominence, headline FROM s JOIN e USING (date)""",
)
def recent_stories(spark, sf_dir):
    return archive.recent_stories(_editions(spark, sf_dir), order_stories(spark, sf_dir).withColumn("headline", F.col("beat")))


@query("beat_labels", "SELECT doc_id, lang AS beat, CASE lang WHEN 'de' THEN 'Deutsch' WHEN 'fr' THEN 'Français' ELSE lang END AS beat_label FROM documents")
def beat_labels(spark, sf_dir):
    known = C.local(spark, [("de", "Deutsch"), ("fr", "Français")], "id string, label string")
    return archive.with_label(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("beat")), known).select("doc_id", "beat", "beat_label")


@query("first_uses", "SELECT url, min(date) AS first_date, arg_min(story, (date, story)) AS first_id FROM (SELECT l_partkey AS url, CAST(o_orderdate AS DATE) AS date, o_orderkey AS story FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY url")
def first_uses(spark, sf_dir):
    c = citations(spark, sf_dir)
    return archive.first_uses(c.select("url", "date", F.col("story").alias("id"), F.col("story").alias("pos")))


@query(
    "harvest_envelope",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS feed_count, count(*) FILTER (event_type <> 'error') AS ok_count, count(*) FILTER (event_type = 'purchase') AS item_count, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1",
)
def harvest_envelope(spark, sf_dir):
    runs = feed_runs(spark, sf_dir).withColumn("day", F.to_date("run_at.ts"))
    items = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.to_date("ts").alias("day"))
    told = archive.harvest_envelope(runs, items, ["day"])
    return told.select("day", "feed_count", "ok_count", "item_count", F.size(F.filter("feeds", lambda f: ~f["ok"])).cast("long").alias("failed"))


# validation -------------------------------------------------------------------------------------

_TITLE = r"regexp_extract(text, '^[^.\n]+')"
_DECK = "split_part(text, chr(10), 1)"
_WORDS = r"len(list_filter(string_split_regex({}, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))"
_QUOTED = """regexp_extract_all({}, '"([^"]{{10,}})"', 1)"""
_STORIES = rf"""
d AS (SELECT *, DATE '2024-01-01' + CAST(doc_id // 11 AS INTEGER) AS date, doc_id % 11 AS pos, string_split(text, chr(10)) AS lines FROM documents),
s AS (
  SELECT CAST(date AS DATE) AS date, doc_id, pos, lines, text, 'story-' || doc_id % 97 AS slug, strftime(date, '%Y-%m-%d') || '-story-' || doc_id % 97 AS id, lang,
    ['north', 'south', 'east', 'west', 'nowhere'][CAST(doc_id % 5 + 1 AS INTEGER)] AS beat, {_TITLE} AS headline, lines[1] AS deck,
    CASE WHEN pos = 0 THEN 'lead' WHEN pos < 5 THEN 'top' WHEN pos < 7 THEN 'standard' ELSE 'brief' END AS prominence,
    CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lines[len(lines)] END AS why, doc_id % 6 + 1 AS minutes, ['high', 'medium', 'low'][CAST(doc_id % 3 + 1 AS INTEGER)] AS confidence, doc_id % 3 + 1 AS n_src FROM d
), m AS (SELECT *, CASE WHEN prominence = 'brief' THEN [] ELSE lines END AS body FROM s),
src AS (SELECT date, id, pos, k, prominence, confidence, page_id % 5 AS declared, CAST(date AS TIMESTAMP) + to_days(CAST(page_id * 7 % 42 - 38 AS INTEGER)) AS published, regexp_extract(p.html, '<title>([^<]*)', 1) AS title, p.url, t.host, t.tier, t.publisher, t.blocked FROM (SELECT *, unnest(range(n_src)) AS k FROM m) q JOIN pages p ON p.page_id = (q.doc_id * 3 + k) % (SELECT max(page_id) + 1 FROM pages) JOIN tiers t ON t.url = p.url),
uses AS (SELECT *, min(date) OVER (PARTITION BY url) AS first_date, first_value(id) OVER (PARTITION BY date, url ORDER BY pos, k) AS first_id FROM src),
told AS (SELECT date, id, headline, deck, array_to_string(lines[1:2], chr(10)) AS summary, array_to_string(body, chr(10)) AS article,
  concat_ws(' ', headline, deck, array_to_string(lines[1:2], ' '), array_to_string(body, ' '), why) AS text, concat_ws(' ', deck, array_to_string(lines[1:2], ' '), array_to_string(body, ' '), why) AS read, minutes FROM m),
tok AS (SELECT date, id, {sql_overlap_tokens("headline")} AS tok FROM m),
own AS (SELECT date, id, list_concat([headline, deck], list_concat(lines[1:2], body)) AS ours, lang FROM m),
names AS (SELECT date, id, list_distinct(flatten(list_transform(string_split(regexp_replace(array_to_string(list_append(ours, lang), '. '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
  lambda x: list_transform(list_filter(list_transform(list_slice(string_split_regex(x, '\s+'), 2, NULL), lambda w: regexp_replace(w, '[^A-Za-z0-9]', '', 'g')), lambda w: regexp_matches(w, '^[A-Z]') AND length(w) > 1), lambda w: lower(w))))) AS names FROM own),
meet AS (SELECT row_number() OVER () AS r, date, id, ' ' || array_to_string({sql_words("field")}, ' ') || ' ' AS said, t FROM (SELECT date, id, unnest(ours) AS field FROM own) JOIN (SELECT date, id, {sql_words("title")} AS t FROM src) USING (date, id) WHERE len(t) > 7),
runs AS (SELECT r, date, id, said, list_slice(t, i, j) AS run FROM (SELECT *, unnest(range(i + 7, len(t) + 1)) AS j FROM (SELECT *, unnest(range(1, len(t) - 6)) AS i FROM meet))),
copied AS (SELECT date, id, len(list_filter(run, lambda w: NOT list_contains(names, w) AND w NOT IN ({STOP}))) AS n FROM (
  SELECT r, any_value(date) AS date, any_value(id) AS id, arg_max(run, len(run) * 1000000 - strpos(said, ' ' || array_to_string(run, ' ') || ' ')) AS run FROM runs WHERE contains(said, ' ' || array_to_string(run, ' ') || ' ') GROUP BY r) JOIN names USING (date, id)),
per AS (SELECT date, id, prominence, confidence, min(coalesce(tier, 4)) AS best, count(DISTINCT lower(coalesce(publisher, host))) AS voices FROM src WHERE NOT blocked GROUP BY ALL),
e AS (SELECT date, min(doc_id) AS number, count(*) AS n, count(*) FILTER (prominence = 'lead') AS lead, count(*) FILTER (prominence = 'top') AS top, count(*) FILTER (prominence = 'brief') AS brief FROM m GROUP BY date)"""
_RULES = [
    ("V2", "E", "SELECT date, NULL FROM e WHERE number % 5 = 0"),
    ("V3", "E", "SELECT date, NULL FROM e WHERE n < 8"),
    ("V4", "W", "SELECT date, NULL FROM e WHERE n > 24"),
    ("V5", "E", "SELECT date, NULL FROM e WHERE lead <> 1"),
    ("V6", "W", "SELECT date, NULL FROM e WHERE top NOT BETWEEN 3 AND 6"),
    ("V7", "W", "SELECT date, NULL FROM e WHERE brief NOT BETWEEN 4 AND 8"),
    ("V8", "E", "SELECT date, id FROM (SELECT *, row_number() OVER (PARTITION BY date, id ORDER BY pos) AS k FROM m) WHERE k > 1"),
    ("V9", "E", "SELECT date, id FROM (SELECT *, row_number() OVER (PARTITION BY date, slug ORDER BY pos) AS k FROM m) WHERE k > 1"),
    ("V10", "E", "SELECT date, id FROM m WHERE NOT starts_with(id, strftime(date, '%Y-%m-%d'))"),
    ("V11", "E", "SELECT date, id FROM m WHERE id <> strftime(date, '%Y-%m-%d') || '-' || slug"),
    ("V13", "E", "SELECT date, id FROM m WHERE prominence = 'brief' AND len(body) > 0"),
    ("V12", "E", "SELECT date, id FROM m WHERE beat NOT IN (SELECT id FROM beats)"),
    ("V14", "E", "SELECT date, id FROM m WHERE prominence <> 'brief' AND len(body) < 3"),
    ("V15", "E", "SELECT date, id FROM m WHERE prominence <> 'brief' AND coalesce(why, '') = ''"),
    ("V16", "W", "SELECT date, id FROM m WHERE prominence = 'brief' AND coalesce(why, '') <> ''"),
    ("V17", "E", "SELECT date, id FROM m WHERE n_src < CASE WHEN prominence IN ('lead', 'top') THEN 2 ELSE 1 END"),
    ("V18", "E", "SELECT date, id FROM uses WHERE host = ''"),
    ("V24", "E", "SELECT date, id FROM uses WHERE published > date + INTERVAL 48 HOUR"),
    ("V25", "W", "SELECT date, id FROM uses WHERE published < date + INTERVAL 24 HOUR - INTERVAL 480 HOUR"),
    ("V32", "W", r"SELECT date, id FROM m WHERE contains(headline, ': ') AND len(list_filter(string_split_regex(split_part(headline, ': ', 1), '\s+'), lambda x: x <> '')) <= 2"),
    ("V33", "W", "SELECT DISTINCT a.date, a.id FROM tok a JOIN tok b ON b.date < a.date AND len(a.tok) > 0 AND len(b.tok) > 0 AND len(list_intersect(a.tok, b.tok)) / (len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok))) > 0.6"),
    ("V34", "E", "SELECT date, id FROM copied WHERE n > 4"),
    ("V35", "W", "SELECT date, id FROM copied WHERE n > 2 AND n <= 4"),
    ("V36", "W", f"SELECT date, id FROM told WHERE coalesce(list_max(list_transform(flatten([{', '.join(_QUOTED.format(c) for c in ('headline', 'deck', 'summary', 'article'))}]), lambda q: len({sql_words('q')}))), 0) > 30"),
    ("V37", "W", f"SELECT date, id FROM told WHERE len(list_filter({LINT}, lambda x: x <> 'exclamation')) > 0"),
    ("V38", "W", f"SELECT date, id FROM told WHERE list_contains({LINT}, 'exclamation')"),
    ("V39", "W", f"SELECT date, id FROM told WHERE abs(minutes - greatest(1, floor({_WORDS.format('read')} / 220 + 0.5))) > 2"),
    ("V42", "W", "SELECT g.date, NULL FROM (SELECT d.date, b.id, b.quota, b.min_quota, count(m.id) AS n FROM (SELECT DISTINCT date FROM m) d CROSS JOIN beats b LEFT JOIN m ON m.date = d.date AND m.beat = b.id GROUP BY ALL) g WHERE n >= min_quota AND n < quota"),
    ("V19", "E", "SELECT date, id FROM uses WHERE blocked"),
    ("V20", "W", "SELECT date, id FROM uses WHERE host <> '' AND NOT blocked AND publisher = host"),
    ("V21", "W", "SELECT date, id FROM uses WHERE publisher <> host AND declared <> tier"),
    ("V22", "E", "SELECT date, id FROM uses WHERE first_id <> id"),
    ("V23", "E", "SELECT date, id FROM uses WHERE first_date < date"),
    ("V26", "E", "SELECT date, id FROM per WHERE best > 3"),
    ("V27", "W", "SELECT date, id FROM per WHERE prominence = 'lead' AND best > 1"),
    ("V28", "W", "SELECT date, id FROM m WHERE prominence IN ('lead', 'top') AND confidence = 'low'"),
    ("V29", "E", "SELECT date, id FROM per WHERE confidence = 'high' AND best > 1"),
    ("V30", "E", "SELECT date, id FROM per WHERE prominence IN ('lead', 'top') AND voices < 2"),
    (
        "V31",
        "W",
        f"SELECT date, id FROM (SELECT date, id, {sql_overlap_tokens('deck')} AS a, {sql_overlap_tokens('headline')} AS b FROM m) WHERE len(a) > 0 AND len(list_intersect(a, b)) > 0.8 * len(a)",
    ),
    ("V41", "E", "SELECT date, NULL FROM (SELECT DISTINCT date FROM m) CROSS JOIN beats b WHERE (SELECT count(*) FROM m WHERE m.date = date AND m.beat = b.id) < min_quota"),
]


def _rule_sql() -> str:
    v41 = "SELECT g.date, NULL FROM (SELECT d.date, b.id, b.min_quota, count(m.id) AS n FROM (SELECT DISTINCT date FROM m) d CROSS JOIN beats b LEFT JOIN m ON m.date = d.date AND m.beat = b.id GROUP BY ALL) g WHERE n < min_quota"
    parts = [f"SELECT '{r}' AS rule, '{s}' AS severity, x.date, x.story FROM ({v41 if r == 'V41' else q}) x(date, story)" for r, s, q in _RULES]
    return f"WITH {HOSTED.lstrip()}, {_STORIES.lstrip()} SELECT rule, severity, date, story FROM (" + " UNION ALL ".join(parts) + ")"


def _violations(spark, sf_dir) -> DataFrame:
    editions, stories = edition_stories(spark, sf_dir)
    return validate.validate(editions, stories, C.beats(spark, TEST), C.publishers(spark, TEST.book), C.blocked(spark, TEST.book), style=list(TEST.style))


@query("gate_violations", _rule_sql())
def gate_violations(spark, sf_dir):
    """Every rule over editions and stories; V1 is in gate_shape, V40 in gate_reviews."""
    return _violations(spark, sf_dir).select("rule", "severity", "date", "story")


@query("gate_report", f"SELECT '2024-01-16T12:00:00Z' AS ran_at, true AS strict, count(*) FILTER (severity = 'E') AS total_errors, count(*) FILTER (severity = 'W') AS total_warnings, count(*) = 0 AS passed FROM ({_rule_sql()})")
def gate_report(spark, sf_dir):
    return validate.report(_violations(spark, sf_dir), strict=True, ran_at="2024-01-16T12:00:00Z")


@query("gate_results", f"WITH v AS ({_rule_sql()}), e AS (SELECT DISTINCT DATE '2024-01-01' + CAST(doc_id // 11 AS INTEGER) AS date FROM documents) SELECT CAST(e.date AS DATE) AS date, count(*) FILTER (severity = 'E') AS errors, count(*) FILTER (severity = 'W') AS warnings FROM e LEFT JOIN v ON CAST(e.date AS DATE) = v.date GROUP BY e.date")
def gate_results(spark, sf_dir):
    rows = validate.results(_violations(spark, sf_dir), edition_stories(spark, sf_dir)[0])
    return rows.select("date", F.size("errors").cast("long").alias("errors"), F.size("warnings").cast("long").alias("warnings"))


@query(
    "gate_reviews",
    """WITH r AS (SELECT CAST(ts AS DATE) AS date, event_id AS id, event_type AS hash FROM events),
e AS (SELECT date, max(id) AS id, arg_max(hash, id) AS hash FROM r GROUP BY date), v AS (SELECT date, arg_min(hash, id) AS sha256, min(id) AS id FROM r GROUP BY date)
SELECT date, severity FROM (SELECT e.date, CASE WHEN v.sha256 = 'error' THEN 'E' WHEN v.sha256 = 'signup' THEN 'W' WHEN v.sha256 <> e.hash THEN 'E' END AS severity FROM e JOIN v USING (date)) WHERE severity IS NOT NULL""",
)
def gate_reviews(spark, sf_dir):
    """A day's last event as its edition, the first as its review: an error cannot be read, a sign-up binds nothing."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("event_id").alias("id"), F.col("event_type").alias("hash"))
    editions = e.groupBy("date").agg(F.max_by("hash", "id").alias("hash"))
    first = e.groupBy("date").agg(F.min_by("hash", "id").alias("h"))
    reviews = first.select("date", F.lit(True).alias("reviewed"), F.when(F.col("h") != "signup", F.col("h")).alias("sha256"), (F.col("h") != "error").alias("readable"))
    return validate.review_rules(reviews, editions).select("date", "severity")


_SHAPE = {"type": "object", "required": ["source"], "additionalProperties": False, "properties": {"id": {"type": "integer", "maximum": 500}, "source": {"$ref": "#/$defs/name", "maxLength": 4}, "lang": {"enum": ["de", "en", "fr"]}}, "$defs": {"name": {"type": "string", "pattern": "^s"}}}


@query("gate_shape", "SELECT doc_id, path, keyword FROM (SELECT doc_id, '/id' AS path, 'maximum' AS keyword FROM documents WHERE doc_id > 500 UNION ALL SELECT doc_id, '/source', 'pattern' FROM documents WHERE NOT starts_with(source, 's') UNION ALL SELECT doc_id, '/source', 'maxLength' FROM documents WHERE length(source) > 4 UNION ALL SELECT doc_id, '/lang', 'enum' FROM documents WHERE lang NOT IN ('de', 'en', 'fr'))")
def gate_shape(spark, sf_dir):
    """V1: breaches of a schema by documents written as JSON."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("date"), F.to_json(F.struct(F.col("doc_id").alias("id"), "source", "lang")).alias("raw"))
    bad = jsonschema.conforming(d, "raw", _SHAPE)[1]
    return bad.select(F.col("date").alias("doc_id"), "path", "keyword")


@query("source_hosts", f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def source_hosts(spark, sf_dir):
    from newsloom.functions.urls import host_of

    return table(spark, sf_dir, "pages").groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))




# pages ------------------------------------------------------------------------------------------


@query(
    "story_pages",
    f"""WITH {HOSTED.lstrip()}, {_STORIES.lstrip()}, l AS (SELECT m.*, coalesce(b.label, m.beat) AS section FROM m LEFT JOIN beats b ON b.id = m.beat),
o AS (SELECT a.date, a.id, b.section || '|' || b.headline || '|story/' || b.id || '.html' AS line, row_number() OVER (PARTITION BY a.date, a.id ORDER BY (a.beat = b.beat)::INT DESC, b.pos) AS rank FROM l a JOIN l b ON a.date = b.date AND a.id <> b.id),
n AS (SELECT date, id, string_agg(line, chr(10) ORDER BY rank) AS also FROM o WHERE rank <= 5 GROUP BY ALL),
c AS (SELECT date, id, string_agg(title || '|Someone|' || url, chr(10) ORDER BY k) AS citations FROM src GROUP BY ALL)
SELECT date, id, 'story/' || id || '.html' AS path, section, headline, deck, CASE WHEN len(body) > 0 THEN array_to_string(body, chr(10)) ELSE deck END AS paragraphs, array_to_string(lines[1:2], chr(10)) AS keypoints, nullif(why, '') AS why,
  CAST(date AS TIMESTAMP) AS published_at, CAST(minutes AS INTEGER) AS read_minutes, CAST(n_src AS INTEGER) AS n_sources, confidence, confidence <> 'high' AS doubtful, lang || '|entity/' || lang || '.html' AS topics, citations, coalesce(also, '') AS also
FROM l LEFT JOIN n USING (date, id) LEFT JOIN c USING (date, id)""",
)
def story_pages(spark, sf_dir):
    editions, stories = edition_stories(spark, sf_dir)
    found = pages.story_pages(stories, editions.withColumn("generated_at", F.col("date").cast("timestamp")), C.beats(spark, TEST))
    for name, fields in (("topics", ("name", "path")), ("citations", ("title", "publisher", "url")), ("also", ("section", "headline", "path"))):
        found = found.withColumn(name, F.array_join(F.transform(name, lambda x: F.concat_ws("|", *[x[f] for f in fields])), "\n"))  # noqa: B023 - built at once
    return found.withColumn("paragraphs", F.array_join("paragraphs", "\n")).withColumn("keypoints", F.array_join("keypoints", "\n")).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("topics_page", f"WITH {MENTIONS}, t AS (SELECT slug, arg_min(name, (date, pos)) AS name, count(*) AS n, max(date) AS last FROM mentions GROUP BY slug) SELECT row_number() OVER (ORDER BY n DESC, name, slug) AS place, name, n, last, 'entity/' || slug || '.html' AS path FROM t")
def topics_page(spark, sf_dir):
    return pages.topics_page(archive.entity_index(mentions(spark, sf_dir)))


@query(
    "archive_page",
    """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, arg_min(o_orderpriority, o_orderkey) AS title, count(*) AS stories FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS digest_items FROM lineitem GROUP BY 1), c AS (SELECT CAST(ts AS DATE) AS date, count(*) AS wire_items FROM events GROUP BY 1)
SELECT date, title, stories IS NOT NULL AS published, 'edition/' || CASE WHEN stories IS NOT NULL THEN strftime(date, '%Y-%m-%d') END || '.html' AS edition_path, stories, 'digest/' || CASE WHEN digest_items IS NOT NULL THEN strftime(date, '%Y-%m-%d') END || '.html' AS digest_path, digest_items,
  'wire/' || CASE WHEN wire_items IS NOT NULL THEN strftime(date, '%Y-%m-%d') END || '.html' AS wire_path, wire_items FROM a FULL JOIN b USING (date) FULL JOIN c USING (date)""",
)
def archive_page(spark, sf_dir):
    n = lambda t, c: table(spark, sf_dir, t).groupBy(F.to_date(c).alias("date")).agg(F.count("*").alias("n"))
    told = n("orders", "o_orderdate").join(_editions(spark, sf_dir), "date").select("date", "title", "n")
    return pages.archive_page(told, n("lineitem", "l_shipdate"), n("events", "ts"))
