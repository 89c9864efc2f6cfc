"""Queries for the text, URL, hash, date and colour functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.config import TEST
from newsloom.functions import colour, dates, hashing, urls
from newsloom.functions import text as T
from newsloom.plans.adapters import table
from newsloom.plans.registry import query

TITLE, LINE = r"regexp_extract(text, '^[^.\n]+')", r"regexp_extract(text, '\n([^\n]*)', 1)"
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _split(x: str, keep: str = r"[^a-z0-9\s]") -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({x}), '{keep}', ' ', 'g'), '\s+'), lambda w: w <> '')"


def sql_cluster_tokens(x: str) -> str:
    return f"list_distinct(list_filter({_split(x)}, lambda w: length(w) > 2 AND w NOT IN ({STOP})))"


def sql_class_tokens(x: str) -> str:
    stem = "CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"
    return f"list_distinct(list_transform(list_filter({_split(x)}, lambda w: length(w) > 2 AND w NOT IN ({STOP})), lambda w: {stem}))"


def sql_overlap_tokens(x: str) -> str:
    return f"list_distinct(list_filter({_split(x, '[^a-z0-9 ]')}, lambda w: length(w) > 3))"


def sql_words(x: str) -> str:
    """The SQL of `word_list`."""
    return _split(x)


def _told(tokens: str) -> str:
    return f"array_to_string(list_sort({tokens}), ' ')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.withColumn("title", F.regexp_extract("text", r"^[^.\n]+", 0)).withColumn("line", F.regexp_extract("text", r"\n([^\n]*)", 1))


def _sorted(c):
    return F.array_join(F.array_sort(c), " ")


@query(
    "text_tokenizers",
    f"SELECT doc_id, {_told(sql_class_tokens('text'))} AS class_tokens, {_told(sql_cluster_tokens('text'))} AS cluster_tokens, "
    f"{_told(sql_overlap_tokens('text'))} AS overlap_tokens, CAST(len({_split('text')}) AS BIGINT) AS n_words FROM documents",
)
def text_tokenizers(spark, sf_dir):
    words = F.col("words")  # split once, used four times
    d = table(spark, sf_dir, "documents").select("doc_id", T.word_list(F.col("text")).alias("words"))
    return d.select("doc_id", _sorted(T.class_tokens_of(words)).alias("class_tokens"), _sorted(T.cluster_tokens_of(words)).alias("cluster_tokens"), _sorted(T.overlap_tokens_of(words)).alias("overlap_tokens"), F.size(words).cast("long").alias("n_words"))


_A, _B = sql_overlap_tokens(TITLE), sql_overlap_tokens(LINE)


@query(
    "text_similarity",
    f"""WITH t AS (SELECT doc_id, {_A} AS a, {_B} AS b FROM documents), s AS (SELECT doc_id, a, b, len(list_intersect(a, b)) AS n FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS shared, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE floor(n / (len(a) + len(b) - n) * 1000 + 0.5) / 1000 END AS jaccard, len(a) > 0 AND n > 0.8 * len(a) AS restates FROM s""",
)
def text_similarity(spark, sf_dir):
    d = _docs(spark, sf_dir)
    a, b = T.overlap_tokens(F.col("title")), T.overlap_tokens(F.col("line"))
    return d.select("doc_id", T.shared_count(a, b).cast("long").alias("shared"), dates.round3(T.jaccard(a, b)).alias("jaccard"), T.restates(F.col("title"), F.col("line")).alias("restates"))


@query(
    "text_names_and_quotes",
    r"""WITH s AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence, text FROM conversations),
w AS (SELECT conv_id, turn, list_transform(list_slice(string_split_regex(sentence, '\s+'), 2, NULL), lambda x: regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) AS ws FROM s),
n AS (SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten(list(list_transform(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]') AND length(x) > 1), lambda x: lower(x)))))), ' ') AS names FROM w GROUP BY ALL)
SELECT conv_id, turn, coalesce(names, '') AS names, CAST(len(regexp_extract_all(coalesce(text, ''), '"([^"]{10,})"', 1)) AS BIGINT) AS quotes,
  contains(coalesce(text, ''), ': ') AND len(list_filter(string_split_regex(split_part(coalesce(text, ''), ': ', 1), '\s+'), lambda x: x <> '')) <= 2 AS label_colon
FROM conversations LEFT JOIN n USING (conv_id, turn)""",
)
def text_names_and_quotes(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", _sorted(T.proper_nouns(c)).alias("names"), F.size(T.quoted_runs(c)).cast("long").alias("quotes"), T.label_colon(c).alias("label_colon"))


LINT = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, '(?i){p.replace('(?<![A-Za-z0-9_])', r'\b').replace('(?![A-Za-z0-9_])', r'\b')}') THEN '{label}' END" for p, label in TEST.style
) + """, CASE WHEN contains(regexp_replace(text, '"[^"]*"', '', 'g'), '!') THEN 'exclamation' END], lambda x: x IS NOT NULL)"""


@query("text_style_lint", f"SELECT doc_id, array_to_string({LINT}, '|') AS lint FROM documents")
def text_style_lint(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.style_lint(F.col("text"), list(TEST.style)), "|").alias("lint"))


@query(
    "text_escapes",
    r"""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS xml,
  replace(replace(replace(html, '<', '\u003c'), '>', '\u003e'), '&', '\u0026') AS json, regexp_replace(lower(html), '[^a-z0-9]', '', 'g') AS squashed FROM pages""",
)
def text_escapes(spark, sf_dir):
    c = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", T.escape_xml(c).alias("xml"), T.safe_json(c).alias("json"), T.squash(c).alias("squashed"))


_NAMED = "html"
for _n, _c in reversed(list(T.NAMED.items())):
    _NAMED = f"replace({_NAMED}, '&{_n};', '{_c.replace(chr(39), chr(39) * 2)}')"
_STRIP = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("text_tags_and_entities", f"SELECT page_id, {_STRIP} AS stripped, {_NAMED} AS decoded FROM pages")
def text_tags_and_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("stripped"), T.decode_entities(F.col("html")).alias("decoded"))


_SLUG = "regexp_replace(left(trim(regexp_replace(strip_accents(lower(t)), '[^a-z0-9]+', '-', 'g'), '-'), 80), '-+$', '')"


@query(
    "text_slugs",
    f"""WITH d AS (SELECT doc_id, {TITLE} AS t FROM documents), s AS (SELECT doc_id, t, {_SLUG} AS slug, string_split_regex(trim(regexp_replace(t, '[^A-Za-z0-9 ]', ' ', 'g')), '\\s+') AS w FROM d)
SELECT doc_id, slug, CASE WHEN regexp_replace(left(slug, 60), '-+$', '') = '' THEN 'item-' || length(t) ELSE regexp_replace(left(slug, 60), '-+$', '') END AS digest_slug,
  upper(CASE WHEN len(w) = 1 THEN left(w[1], 2) ELSE left(w[1], 1) || left(w[2], 1) END) AS monogram FROM s""",
)
def text_slugs(spark, sf_dir):
    t = F.col("title")
    return _docs(spark, sf_dir).select("doc_id", T.slugify(t).alias("slug"), T.digest_slug(t).alias("digest_slug"), T.monogram(t).alias("monogram"))


@query("text_read_minutes", r"SELECT doc_id, CAST(greatest(1, floor(len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) / 220 + 0.5)) AS INTEGER) AS minutes FROM documents")
def text_read_minutes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.read_minutes(F.col("text")).alias("minutes"))


HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '')"
KEY = r"lower(regexp_replace(regexp_replace(regexp_replace(url, '(?i)^https?://', ''), '[?#].*$', ''), '/+$', ''))"


@query(
    "url_functions",
    f"SELECT page_id, {HOST} AS host, {KEY} AS url_key, regexp_matches(url, '(?i)^https://') AS https, regexp_matches({HOST}, '(^|\\.)gov(\\.[a-z]{{2}})?$') OR {HOST} IN ({', '.join(repr(h) for h in urls.INSTITUTIONAL)}) AS institutional FROM pages",
)
def url_functions(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host_of(u).alias("host"), urls.url_key(u).alias("url_key"), urls.is_https(u).alias("https"), urls.is_institutional(u).alias("institutional"))


@query("url_topic_search", "SELECT doc_id, 'https://feeds.example.com/?q=' || url_encode('when:2d ' || lang || ' ' || source) AS url FROM documents")
def url_topic_search(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", urls.topic_search_url("https://feeds.example.com/?q=", F.concat_ws(" ", "lang", "source")).alias("url"))


@query("hash_fnv", "SELECT page_id, list_reduce(list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261) AS hash FROM pages")
def hash_fnv(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hashing.hash32(F.col("url")).alias("hash"))


_FNV = "list_reduce(list_transform(string_split(url, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261)"


def _sql_draws(n: int) -> str:
    """seeded: page_id, url, k and draw, by 32-bit products in wider integers."""
    times = lambda a, b: f"CAST((CAST({a} AS HUGEINT) * ({b})) % 4294967296 AS BIGINT)"
    return f"""a AS (SELECT page_id, url, k, ({_FNV} + (k + 1) * 1831565813) & 4294967295 AS a FROM pages, range({n}) r(k)),
b AS (SELECT page_id, url, k, {times("xor(a, a >> 15)", "a | 1")} AS t FROM a), c AS (SELECT page_id, url, k, xor((t + {times("xor(t, t >> 7)", "t | 61")}) & 4294967295, t) AS t FROM b),
seeded AS (SELECT page_id, url, k, xor(t, t >> 14) / 4294967296 AS draw FROM c)"""


@query("hash_seeded_draws", f"WITH {_sql_draws(3)} SELECT page_id, CAST(k AS INTEGER) AS k, draw FROM seeded")
def hash_seeded_draws(spark, sf_dir):
    draws = hashing.random_draws(hashing.hash32(F.col("url")), 3)
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(draws).alias("k", "draw"))


@query(
    "cover_choices",
    f"""WITH {_sql_draws(14)} SELECT page_id, CAST(floor(max(draw) FILTER (k = 12) * 100) AS INTEGER) AS plate,
  ['scales', 'globe', 'rack'][CAST(floor(max(draw) FILTER (k = 13) * 3) AS INTEGER) + 1] AS motif FROM seeded GROUP BY page_id""",
)
def cover_choices(spark, sf_dir):
    choice = hashing.cover_choice(F.col("url"), F.array(*map(F.lit, ("scales", "globe", "rack"))))
    return table(spark, sf_dir, "pages").select("page_id", choice.alias("c")).select("page_id", "c.plate", "c.motif")


@query("hash_edition", """SELECT doc_id, sha256('[{"doc_id":' || doc_id || ',"source":"' || source || '"}]') AS sha256 FROM documents""")
def hash_edition(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.array(F.struct("doc_id", "source")).alias("stories"))).alias("raw"))
    return d.select("doc_id", hashing.edition_hash(F.col("raw")).alias("sha256"))


NOW = "TIMESTAMP '2024-01-16 12:00:00'"


@query(
    "date_functions",
    f"""WITH e AS (SELECT event_id, ts, date_diff('microsecond', ts, {NOW}) / 3.6e9 AS age FROM events)
SELECT event_id, CASE WHEN age >= 0 AND age <= 48 THEN floor((1 - age / 48) * 1000 + 0.5) / 1000 ELSE 0.0 END AS recency,
  CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-01-16') AS INTEGER) AS days, strftime(ts, '%A, %-d %B %Y') AS masthead, strftime(ts, '%-d %b %Y') AS short,
  CAST(floor(greatest(0, age) / 24) AS BIGINT) AS stale_days, greatest(0, age) >= 36 AS banner,
  CASE WHEN floor(age * 60) < 1 THEN 'just now' WHEN floor(age * 60) < 60 THEN CAST(CAST(floor(age * 60) AS BIGINT) AS VARCHAR) || ' minute' || CASE WHEN floor(age * 60) = 1 THEN '' ELSE 's' END || ' ago'
    WHEN floor(age * 60) < 1440 THEN CAST(CAST(floor(floor(age * 60) / 60) AS BIGINT) AS VARCHAR) || ' hour' || CASE WHEN floor(floor(age * 60) / 60) = 1 THEN '' ELSE 's' END || ' ago'
    ELSE CAST(CAST(floor(floor(age * 60) / 1440) AS BIGINT) AS VARCHAR) || ' day' || CASE WHEN floor(floor(age * 60) / 1440) = 1 THEN '' ELSE 's' END || ' ago' END AS told
FROM e""",
)
def date_functions(spark, sf_dir):
    now, ts = F.lit("2024-01-16 12:00:00").cast("timestamp"), F.col("ts").cast("timestamp")
    stale = dates.staleness(now, ts)
    return table(spark, sf_dir, "events").select(
        "event_id",
        dates.round3(dates.recency(ts, now, 48)).alias("recency"),
        dates.days_between(F.lit("2024-01-16").cast("date"), F.to_date("ts")).alias("days"),
        dates.masthead_date(F.col("ts")).alias("masthead"),
        dates.short_date(F.col("ts")).alias("short"),
        stale["days"].alias("stale_days"),
        stale["banner"].alias("banner"),
        dates.relative_time(ts, now).alias("told"),
    )


@query("date_normalize", "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS mail, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS iso, CAST(NULL AS VARCHAR) AS bad FROM events")
def date_normalize(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    told = lambda c: F.date_format(dates.normalize_date(c), "yyyy-MM-dd HH:mm:ss")
    mail = F.concat(F.date_format(F.timestamp_add("HOUR", F.lit(2), ts), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    iso = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return table(spark, sf_dir, "events").select("event_id", told(mail).alias("mail"), told(iso).alias("iso"), told(F.lit("not a date")).alias("bad"))


@query("colour_round_trip", "SELECT part.p_partkey AS id, '#' || lpad(lower(hex(CAST(p_partkey * 7919 % 16777216 AS BIGINT))), 6, '0') AS back FROM part")
def colour_round_trip(spark, sf_dir):
    raw = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), colour.rgb_to_hsl(colour.hex_to_rgb(raw)).alias("hsl"))
    return rows.select("id", colour.hsl_to_hex(F.col("hsl")).alias("back"))
