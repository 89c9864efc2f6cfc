"""Queries for feeds, deduplication, lookup, classification, clusters, wire and digest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import config as C
from newsloom.config import TEST
from newsloom.functions import text as T
from newsloom.functions.dates import round3
from newsloom.functions.urls import title_key, url_key
from newsloom.operators import dedup, lookup, rank, select, similarity
from newsloom.plans import digest, wire
from newsloom.plans.adapters import CANDIDATES, candidates, table
from newsloom.plans.harvest import harvest
from newsloom.plans.registry import query
from newsloom.plans.text_queries import HOST, KEY, sql_class_tokens, sql_cluster_tokens, sql_overlap_tokens
from newsloom.session import settled, shared_folder
from newsloom.sources import feeds
from newsloom.sources.history import SeenIndex

BOUND = r"\b"


def _re(p: str) -> str:
    return p.replace(T.HEAD, BOUND).replace(T.TAIL, BOUND).replace("'", "''")


def _values(rows: list[tuple]) -> str:
    told = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]" if isinstance(v, tuple) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(told(v) for v in r) + ")" for r in rows) + ")"


PUBLISHERS = _values([(i, *p) for i, p in enumerate(TEST.book.publishers)])
BLOCKED = _values([(h,) for h in TEST.book.blocked])
BEATS = _values([(i, b.id, b.label, b.blurb, b.keywords, b.queries, b.quota, b.min_quota, b.digest_quota) for i, b in enumerate(TEST.beats)])
RELEVANT = _re(T.terms(list(TEST.relevant_words), list(TEST.relevant_parts)))

HOSTED = f"""
book(list_pos, host, name, tier) AS (SELECT * FROM {PUBLISHERS}), bad(host) AS (SELECT * FROM {BLOCKED}),
beats(pos, id, label, blurb, keywords, queries, quota, min_quota, digest_quota) AS (SELECT * FROM {BEATS}),
hosts AS (SELECT url, {HOST} AS host FROM (SELECT DISTINCT url FROM pages)),
tiers AS (
  SELECT url, host, bool_or(bad_host) AS blocked, CASE WHEN bool_or(bad_host) THEN NULL ELSE coalesce(arg_min(tier, list_pos), 4) END AS tier, coalesce(arg_min(name, list_pos), host) AS publisher
  FROM (SELECT h.url, h.host, b.list_pos, b.name, b.tier, EXISTS (SELECT 1 FROM bad WHERE h.host = bad.host OR h.host LIKE '%.' || bad.host) AS bad_host
        FROM hosts h LEFT JOIN book b ON h.host = b.host OR h.host LIKE '%.' || b.host) GROUP BY url, host
)"""
VOCABULARY = f"""
own AS (SELECT id, pos, {sql_class_tokens("array_to_string(keywords, ' ')")} AS own, {sql_class_tokens("concat_ws(' ', label, blurb, array_to_string(CASE WHEN len(keywords) > 0 THEN keywords ELSE queries END, ' '))")} AS tokens FROM beats),
single AS (SELECT token FROM (SELECT id, unnest(own) AS token FROM own) GROUP BY token HAVING count(DISTINCT id) = 1),
vocabulary AS (SELECT o.id AS beat, pos, token, vocab_size, token IN (SELECT token FROM single) AND list_contains(own, token) AS distinctive
  FROM (SELECT id, pos, own, len(tokens) AS vocab_size, unnest(tokens) AS token FROM own) o)"""
CLASSES = f"""
said AS (SELECT id, unnest({sql_class_tokens("concat_ws(' ', title, summary)")}) AS token FROM usable),
met AS (SELECT s.id, beat, pos, count(*) AS overlap, bool_or(distinctive) AS own, count(*) / sqrt(vocab_size) AS score FROM said s JOIN vocabulary USING (token) GROUP BY s.id, beat, pos, vocab_size),
classes AS (SELECT id, beat FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS n FROM met) WHERE n = 1 AND (overlap >= 2 OR own))"""
USABLE = f"usable AS (SELECT * FROM candidates WHERE regexp_matches(url, '(?i)^https://') AND regexp_matches(title, '{RELEVANT}'))"


def _dims(spark: SparkSession):
    return C.beats(spark, TEST), C.publishers(spark, TEST.book), C.blocked(spark, TEST.book)


# feeds ------------------------------------------------------------------------------------------


@query("feed_parse", r"""SELECT doc_id, 0 AS pos, trim(regexp_replace(regexp_extract(text, '^[^.\n]+'), '\s+', ' ', 'g')) AS title, 'https://n.example/' || doc_id AS url, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at, source AS summary
FROM documents JOIN events ON event_id = doc_id WHERE trim(regexp_extract(text, '^[^.\n]+')) <> ''""")  # fmt: skip
def feed_parse(spark, sf_dir):
    """Every document as a feed of one entry, by turns RSS and Atom."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts"), "doc_id")
    title, link = F.regexp_extract("text", r"^[^.\n]+", 0), F.concat(F.lit("https://n.example/"), F.col("doc_id").cast("string"))
    mail = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    rss = F.concat(F.lit("<rss><channel><item><title><![CDATA["), title, F.lit("]]></title><link>"), link, F.lit("</link><pubDate>"), mail, F.lit("</pubDate><description>&lt;"), F.lit("x"), F.lit("&gt;</description></item></channel></rss>"))
    rss = F.replace(rss, F.lit("&lt;x&gt;"), F.col("source"))
    atom = F.concat(F.lit("<feed><entry><title>"), T.escape_xml(title), F.lit('</title><link rel="self" href="https://self.example/"/><link rel="alternate" href="'), link, F.lit('"/><updated>'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated><summary type='text'>"), F.col("source"), F.lit("</summary></entry></feed>"))
    raw = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom).alias("xml"))
    got = feeds.parse_feed(raw)
    return got.select("doc_id", "pos", "title", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "summary")


@query("feed_top_items", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, event_id) AS n FROM events) WHERE n <= 40")
def feed_top_items(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.col("ts").alias("published_at"), F.col("event_id").alias("pos"))
    return feeds.top_by_feed(e, "event_type").select("event_type", "event_id")


@query("feed_api_items", "SELECT CAST(event_id AS VARCHAR) AS title, 'https://hub.example/' || event_id AS url, ts AS published_at, event_type || ', ' || user_id AS summary FROM events")
def feed_api_items(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("string").alias("createdAt"), F.array("event_type", F.col("user_id").cast("string")).alias("tags"))
    return feeds.api_items(rows, "https://hub.example/").withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("feed_harvest", f"""WITH {CANDIDATES} SELECT id, {KEY} AS url_key FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY id) AS n FROM candidates WHERE trim(title) <> '') WHERE n = 1""")
def feed_harvest(spark, sf_dir):
    """Candidates written as feeds, harvested: parsed, top items by feed, one a URL."""
    c = candidates(spark, sf_dir)
    xml = F.concat(F.lit("<item><title>"), T.escape_xml(F.col("title")), F.lit("</title><link>"), F.col("url"), F.lit("</link><description>"), F.col("id").cast("string"), F.lit("</description></item>"))
    raw = c.select(F.col("id").alias("feed_pos"), "source", F.lit(False).alias("discovery_only"), xml.alias("xml"))
    return harvest(raw).select(F.col("summary").cast("long").alias("id"), url_key(F.col("url")).alias("url_key"))


@query("lead_cleaning", f"""SELECT DISTINCT ON (url) title, url, '2024-01-16 12:00:00' AS published_at FROM (
  SELECT page_id, url, 'the ' || page_id AS title FROM pages WHERE regexp_matches(url, '(?i)^https://') AND {HOST} NOT IN ('ththan.example.com')) ORDER BY url, page_id""")  # fmt: skip
def lead_cleaning(spark, sf_dir):
    """One noisy answer a page; of equal URLs the first answer's stays."""
    p = table(spark, sf_dir, "pages")
    said = F.concat(F.lit('Sure:\n```json\n[{"title": "the '), F.col("page_id").cast("string"), F.lit('", "url": "'), F.col("url"), F.lit('", "date": "soon"}]\n```'))
    got = feeds.clean_leads(p.select("page_id", said.alias("said")), "said", "2024-01-16", T.terms(["the"]), ["ththan.example.com"], ["page_id"])
    return got.select("title", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


_GOOD = "SELECT url FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 1)"


def _good(spark, sf_dir) -> DataFrame:
    """Pages whose number has a good label: some known addresses among all."""
    labels = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", "url").join(labels, "page_id", "left_semi")


@query("append_new_leads", f"WITH known AS ({_GOOD.replace('SELECT url', 'SELECT page_id, url')}) SELECT * FROM known UNION ALL SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM known)")
def append_new_leads(spark, sf_dir):
    return dedup.append_new(_good(spark, sf_dir), table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "url")


# deduplication ----------------------------------------------------------------------------------


@query("dedup_urls", f"SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def dedup_urls(spark, sf_dir):
    return dedup.dedupe_by_key(table(spark, sf_dir, "pages").select("page_id", "url"), url_key(F.col("url")), ["page_id"])


@query("dedup_titles", r"""WITH t AS (SELECT doc_id, left(regexp_replace(lower(regexp_extract(text, '^[^.\n]+')), '[^a-z0-9 ]', '', 'g'), 60) AS k FROM documents)
SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM t WHERE k <> '') WHERE n = 1""")  # fmt: skip
def dedup_titles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", title_key(F.regexp_extract("text", r"^[^.\n]+", 0)).alias("k"))
    return dedup.dedupe_by_key(d, F.col("k"), ["doc_id"])


@query("dedup_id_suffixes", "SELECT doc_id, CASE WHEN n = 1 THEN k ELSE k || '-' || n END AS id FROM (SELECT doc_id, lang || source AS k, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents)")
def dedup_id_suffixes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", "source").alias("id"))
    return dedup.suffix_collisions(d, "id", ["doc_id"])


# lookup and classes -----------------------------------------------------------------------------


@query("publisher_tiers", f"WITH {HOSTED.lstrip()} SELECT page_id, host, tier, publisher, blocked FROM pages JOIN tiers USING (url)")
def publisher_tiers(spark, sf_dir):
    _, publishers, blocked = _dims(spark)
    return lookup.with_publisher_tier(table(spark, sf_dir, "pages").select("page_id", "url"), F.col("url"), publishers, blocked).select("page_id", "host", "tier", "publisher", "blocked")


_SPOKEN = "beats AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, source AS label, lang AS blurb, [coalesce(text, '')] AS keywords, []::VARCHAR[] AS queries FROM documents)"


@query("beat_vocabulary", f"WITH {_SPOKEN}, {VOCABULARY.lstrip()} SELECT token, beat, pos, CAST(vocab_size AS INTEGER) AS vocab_size, distinctive FROM vocabulary")
def beat_vocabulary(spark, sf_dir):
    """Each document as a beat: the words that its text alone has are distinctive."""
    d = table(spark, sf_dir, "documents")
    no_queries = F.array().cast("array<string>").alias("queries")
    text = F.array(F.coalesce("text", F.lit(""))).alias("keywords")
    return lookup.beat_vocabulary(d.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), F.col("source").alias("label"), F.col("lang").alias("blurb"), text, no_queries))


@query("topic_classes", f"WITH {HOSTED.lstrip()}, {VOCABULARY.lstrip()}, {CANDIDATES}, usable AS (SELECT * FROM candidates), {CLASSES.lstrip()} SELECT id, beat FROM candidates LEFT JOIN classes USING (id)")
def topic_classes(spark, sf_dir):
    c = candidates(spark, sf_dir).select("id", "title", "summary")
    return lookup.classify(c, "id", F.concat_ws(" ", "title", "summary"), _dims(spark)[0]).select("id", "beat")


@query("via_publishers", rf"WITH {CANDIDATES} SELECT id, nullif(trim(regexp_extract(title, '\s[-–—]\s([^-–—]{{2,40}})$', 1)), '') AS outlet FROM candidates")
def via_publishers(spark, sf_dir):
    return candidates(spark, sf_dir).select("id", T.via_publisher(F.col("title")).alias("outlet"))


@query("novelty", f"WITH {CANDIDATES} SELECT id, url NOT IN ({_GOOD}) AS novel FROM candidates")
def novelty(spark, sf_dir):
    c, seen = candidates(spark, sf_dir), _seen(spark, sf_dir).withColumn("old", F.lit(True))
    return c.join(seen, "url", "left").select("id", F.col("old").isNull().alias("novel"))


@query("history_lookup", f"WITH {CANDIDATES} SELECT DISTINCT url, batch AS date FROM candidates WHERE batch < (SELECT max(batch) FROM candidates) AND url IN (SELECT url FROM candidates WHERE batch = (SELECT max(batch) FROM candidates))")
def history_lookup(spark, sf_dir):
    """The newest day's URLs among those of all days before, by an index that is written first."""
    c = candidates(spark, sf_dir)
    newest = c.agg(F.max("batch").alias("d")).first()["d"]
    index = SeenIndex(spark, f"{shared_folder(spark)}/seen-{uuid.uuid4().hex}", buckets=8)
    index.add(c.where(F.col("batch") < newest), "url", "batch")
    return index.lookup(c.where(F.col("batch") == newest), "url")


# wire -------------------------------------------------------------------------------------------

_WIRE = f"""WITH {HOSTED.lstrip()}, {CANDIDATES}, {USABLE},
clean AS (SELECT u.* FROM usable u JOIN tiers t USING (url) WHERE NOT u.discovery_only AND u.source NOT IN ('src13') AND NOT t.blocked),
once AS (SELECT * FROM (SELECT *, left(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), 60) AS k, row_number() OVER (PARTITION BY left(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), 60) ORDER BY pos) AS n FROM clean) WHERE n = 1 AND k <> ''),
capped AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published_at DESC, pos) AS m FROM once)
SELECT pos, title, url, source, published_at FROM capped WHERE m <= 5 ORDER BY published_at DESC, pos"""


def _wire(spark, sf_dir, limit):
    _, publishers, blocked = _dims(spark)
    got = wire.wire_items(candidates(spark, sf_dir), TEST, publishers, blocked, limit)
    return got.select("pos", "title", "url", "source", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("wire_top", _WIRE + " LIMIT 24")
def wire_top(spark, sf_dir):
    return _wire(spark, sf_dir, 24)


@query("wire_capped", _WIRE)
def wire_capped(spark, sf_dir):
    return _wire(spark, sf_dir, None)


# clusters and digest ----------------------------------------------------------------------------

_ENRICHED = f"""{HOSTED.lstrip()}, {VOCABULARY.lstrip()}, {CANDIDATES}, {USABLE}, {CLASSES.lstrip()},
enriched AS (
  SELECT * FROM (
    SELECT u.*, t.host, t.tier, c.beat, NOT discovery_only AS citable,
      CASE WHEN discovery_only THEN nullif(trim(regexp_extract(title, '\\s[-–—]\\s([^-–—]{{2,40}})$', 1)), '') ELSE t.publisher END AS publisher
    FROM usable u JOIN tiers t USING (url) JOIN classes c USING (id) WHERE NOT t.blocked
  ) WHERE publisher IS NOT NULL
), queue AS (
  SELECT batch, id, {sql_cluster_tokens("title")} AS tok, epoch_us(published_at) AS us, row_number() OVER (PARTITION BY batch ORDER BY published_at DESC, pos) AS k FROM enriched
), fold(batch, k, id, found, state) AS (
  SELECT batch, 0, CAST(NULL AS BIGINT), 0, CAST([] AS STRUCT(tok VARCHAR[], lo BIGINT, hi BIGINT)[]) FROM (SELECT DISTINCT batch FROM queue)
  UNION ALL
  SELECT batch, k, id, found, CASE WHEN found > len(state) THEN list_append(state, struct_pack(tok := tok, lo := us, hi := us))
    ELSE list_transform(state, lambda s, i: CASE WHEN i = found THEN struct_pack(tok := list_distinct(list_concat(s.tok, tok)), lo := least(s.lo, us), hi := greatest(s.hi, us)) ELSE s END) END
  FROM (
    SELECT q.batch, q.k, q.id, q.tok, q.us, f.state, coalesce(nullif(list_position(list_transform(f.state, lambda s:
      len(list_intersect(s.tok, q.tok)) >= 2 AND len(list_intersect(s.tok, q.tok)) / len(list_distinct(list_concat(s.tok, q.tok))) >= 0.32
      AND q.us >= s.hi - 216000000000 AND q.us <= s.lo + 216000000000), true), 0), len(f.state) + 1) AS found
    FROM fold f JOIN queue q ON q.batch = f.batch AND q.k = f.k + 1
  )
), members AS (SELECT e.*, CAST(f.found - 1 AS BIGINT) AS cluster FROM enriched e JOIN fold f ON e.id = f.id)"""


def _seen(spark, sf_dir) -> DataFrame:
    return _good(spark, sf_dir).select("url").distinct()


def _items(spark, sf_dir) -> DataFrame:
    return digest.clustered(digest.enrich(candidates(spark, sf_dir), TEST, *_dims(spark)))


@query("cluster_members", f"WITH RECURSIVE {_ENRICHED} SELECT batch, id, cluster, beat, tier, publisher, citable FROM members")
def cluster_members(spark, sf_dir):
    return _items(spark, sf_dir).select("batch", "id", "cluster", "beat", "tier", "publisher", "citable")


_p = TEST.patterns
_SCORED = f"""{_ENRICHED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY batch, cluster ORDER BY tier, published_at DESC, pos) AS r,
    row_number() OVER (PARTITION BY batch, cluster, citable ORDER BY tier, published_at DESC, pos) AS rc,
    lower(coalesce(nullif(publisher, ''), nullif(host, ''), '')) AS who, url IN ({_GOOD}) AS old FROM members
), votes AS (
  SELECT batch, cluster, beat FROM (SELECT batch, cluster, beat, row_number() OVER (PARTITION BY batch, cluster ORDER BY count(*) DESC, min(pos)) AS v FROM members GROUP BY batch, cluster, beat) WHERE v = 1
), stats AS (
  SELECT batch, cluster, count(*) AS n, count(DISTINCT who) AS publishers, min(tier) AS best_tier, max(published_at) AS newest, bool_and(NOT old) AS novel,
    max(title) FILTER (r = 1) AS title, max(host) FILTER (r = 1) AS top_host, max(title) FILTER (citable AND rc = 1) AS cite_title, max(published_at) FILTER (citable AND rc = 1) AS cite_at,
    count(DISTINCT who) FILTER (citable) AS voices, min(tier) FILTER (citable) AS cite_tier, min(pos) AS first_pos
  FROM ranked GROUP BY batch, cluster HAVING bool_or(citable)
), aged AS (SELECT *, date_diff('microsecond', newest, batch + INTERVAL 12 HOUR) / 3.6e9 AS age FROM stats JOIN votes USING (batch, cluster)),
terms AS (
  SELECT *, CASE WHEN age >= 0 AND age <= 48 THEN 1 - age / 48 ELSE 0.0 END AS recency,
    publishers < 2 AND best_tier = 1 AND NOT regexp_matches(top_host, '(^|\\.)gov(\\.[a-z]{{2}})?$') AS first_party FROM aged
), scored AS (
  SELECT *, least(publishers, 3) / 3 * 0.26
    + least(1, greatest(0, 0.5 + 0.25 * regexp_matches(title, '(?i){_re(_p.quantity)}')::INT + 0.25 * regexp_matches(title, '(?i){_re(_p.event)}')::INT - 0.3 * regexp_matches(title, '(?i){_re(_p.corporate)}')::INT - 0.25 * first_party::INT)) * 0.20
    + CASE WHEN regexp_matches(title, '(?i){_re(_p.breaking)}') THEN 1.0 WHEN regexp_matches(title, '(?i){_re(_p.release)}') THEN 0.6 ELSE 0.0 END * recency * 0.12
    + recency * 0.18 + greatest(0, 1 - (best_tier - 1) / 3) * 0.16 + novel::INT * 0.06 + publishers / n * 0.02 AS score,
    CASE WHEN voices >= 2 AND cite_tier <= 2 THEN 'confirmed' ELSE 'single-source' END AS confidence FROM terms
)"""
_ROUND = "floor(CAST(score AS DOUBLE) * 1000 + 0.5) / 1000"


def _scored(spark, sf_dir, items):
    now = F.timestamp_add("HOUR", F.lit(12), F.col("batch").cast("timestamp"))
    return digest.scored(items, _seen(spark, sf_dir), now, TEST)


@query("cluster_scores", f"WITH RECURSIVE {_SCORED} SELECT batch, cluster, n AS n_items, publishers, best_tier, beat, novel, first_party, {_ROUND} AS score, confidence FROM scored")
def cluster_scores(spark, sf_dir):
    s = _scored(spark, sf_dir, settled(_items(spark, sf_dir)))
    return s.select("batch", "cluster", "n_items", "publishers", "best_tier", "beat", "novel", "first_party", round3(F.col("score")).alias("score"), "confidence")


_DIGEST = f"""WITH RECURSIVE {_SCORED}, capped AS (
  SELECT s.*, b.pos AS beat_pos, row_number() OVER (PARTITION BY batch, beat ORDER BY score DESC, first_pos) AS m, b.digest_quota FROM scored s JOIN beats b ON b.id = s.beat
), chosen AS (
  SELECT *, CASE WHEN s = '' THEN 'item-' || length(cite_title) ELSE s END AS slug0
  FROM (SELECT *, regexp_replace(left(regexp_replace(left(trim(regexp_replace(strip_accents(lower(cite_title)), '[^a-z0-9]+', '-', 'g'), '-'), 80), '-+$', ''), 60), '-+$', '') AS s FROM capped WHERE m <= digest_quota)
), named AS (SELECT *, row_number() OVER (PARTITION BY batch, slug0 ORDER BY beat_pos, first_pos) AS nth FROM chosen),
cited AS (SELECT batch, cluster, string_agg(publisher || '|' || tier, ',' ORDER BY rc) AS sources, list(regexp_replace(lower(publisher), '[^a-z0-9]', '', 'g')) AS squashed FROM ranked WHERE citable AND rc <= 4 GROUP BY ALL),
others AS (SELECT batch, cluster, publisher, regexp_replace(lower(publisher), '[^a-z0-9]', '', 'g') AS q, pos FROM ranked WHERE NOT citable),
heard AS (SELECT o.batch, o.cluster, arg_max(o.publisher, o.pos) AS publisher, min(o.pos) AS first FROM others o JOIN cited c USING (batch, cluster)
  WHERE len(list_filter(c.squashed, lambda x: contains(x, o.q) OR contains(o.q, x))) = 0 GROUP BY o.batch, o.cluster, o.q),
also AS (SELECT batch, cluster, string_agg(publisher, ',' ORDER BY first) AS corroborated_by FROM (SELECT *, row_number() OVER (PARTITION BY batch, cluster ORDER BY first) AS h FROM heard) WHERE h <= 6 GROUP BY ALL)
SELECT batch, CAST(batch AS VARCHAR) || '-' || slug0 || CASE WHEN nth > 1 THEN '-' || nth ELSE '' END AS id, beat, cite_title AS title, cite_at AS published_at, confidence, {_ROUND} AS score, sources, coalesce(corroborated_by, '') AS corroborated_by
FROM named JOIN cited USING (batch, cluster) LEFT JOIN also USING (batch, cluster)"""


@query("digest", _DIGEST)
def digest_items(spark, sf_dir):
    """The flagship: candidates to the digest of each day."""
    items = settled(_items(spark, sf_dir))  # read by scores, votes and sources
    got = digest.project(digest.select_items(_scored(spark, sf_dir, items), _dims(spark)[0]), items)
    told = F.array_join(F.transform("sources", lambda s: F.concat(s["publisher"], F.lit("|"), s["tier"].cast("string"))), ",")
    return got.select("batch", "id", "beat", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "confidence", "score", told.alias("sources"), F.array_join("corroborated_by", ",").alias("corroborated_by"))


@query(
    "headline_substance",
    f"""WITH {CANDIDATES} SELECT id, least(1, greatest(0, 0.5 + 0.25 * regexp_matches(title, '(?i){_re(_p.quantity)}')::INT + 0.25 * regexp_matches(title, '(?i){_re(_p.event)}')::INT - 0.3 * regexp_matches(title, '(?i){_re(_p.corporate)}')::INT))::DOUBLE AS substance,
  (CASE WHEN regexp_matches(title, '(?i){_re(_p.breaking)}') THEN 1.0 WHEN regexp_matches(title, '(?i){_re(_p.release)}') THEN 0.6 ELSE 0.0 END)::DOUBLE AS urgency FROM candidates""",
)
def headline_substance(spark, sf_dir):
    t = F.col("title")
    return candidates(spark, sf_dir).select("id", round3(rank.substance(t, F.lit(False), _p)).alias("substance"), rank.urgency(t, F.lit(1.0), _p).alias("urgency"))


# similarity -------------------------------------------------------------------------------------

_RESTATED = f"""WITH t AS (SELECT doc_id, {sql_overlap_tokens(r"regexp_extract(text, '^[^.\n]+')")} AS tok FROM documents),
p AS (SELECT a.doc_id AS id, b.doc_id AS earlier, len(list_intersect(a.tok, b.tok)) AS n, len(a.tok) AS x, len(b.tok) AS y FROM t a JOIN t b ON b.doc_id < a.doc_id AND len(a.tok) > 0 AND len(b.tok) > 0 AND list_has_any(a.tok, b.tok)),
s AS (SELECT id, earlier, n / (x + y - n) AS j FROM p WHERE n / (x + y - n) > 0.6)
SELECT id, min(earlier) AS earlier, floor(arg_min(j, earlier) * 1000 + 0.5) / 1000 AS similarity FROM s GROUP BY id"""


@query("restated_headlines", _RESTATED)
def restated_headlines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    got = similarity.first_restated(d, "doc_id", F.regexp_extract("text", r"^[^.\n]+", 0), "doc_id")
    return got.select("id", "earlier", round3(F.col("similarity")).alias("similarity"))


_WORDS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"
_GRAM = "array_to_string(list_slice(w, p, p + 7), ' ')"


@query(
    "shared_word_runs",
    f"""WITH a AS (SELECT doc_id, p, {_GRAM} AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM (SELECT doc_id, {_WORDS} AS w FROM documents))),
b AS (SELECT item_id, p, {_GRAM} AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS p FROM (SELECT item_id, {_WORDS} AS w FROM benchmark))),
m AS (SELECT DISTINCT doc_id, item_id, a.p AS p, a.p - b.p AS diag FROM a JOIN b USING (g)),
i AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY p) AS island FROM m),
r AS (SELECT doc_id, item_id, count(*) + 7 AS run_len, max(p) + 7 AS run_end FROM i GROUP BY doc_id, item_id, diag, island)
SELECT doc_id AS left_id, item_id AS right_id, max(run_len) AS run_len, arg_max(run_end, run_len * 1000000 - run_end) AS run_end FROM r GROUP BY ALL""",
)
def shared_word_runs(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item_text")
    return similarity.shared_runs(d, b, "doc_id", F.col("text"), "item_id", F.col("item_text"))


# selection --------------------------------------------------------------------------------------


@query("top_by_kind", "SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 7")
def top_by_kind(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return select.top_per_group(e, ["event_type"], [F.col("value").desc(), F.col("event_id")], 7)
