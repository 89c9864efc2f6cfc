"""The gate: every rule as columns, all violations as one table.

Tables: editions (date, file_date, number, generated_at, hash), stories (date, pos and the story's
columns), both already in shape (`jsonschema.conforming` drops documents that are not, which
short-circuits all other rules). Violations: date, story, rule, severity (E or W), detail.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions.dates import hours_between
from newsloom.functions.urls import host_of
from newsloom.operators.archive import beat_coverage, first_uses, review_binding
from newsloom.operators.lookup import host_matches
from newsloom.operators.similarity import first_restated

MAX_RUN, MAX_EXPRESSIVE, SOME_EXPRESSIVE, MAX_QUOTE = 7, 4, 2, 30


@dataclass(frozen=True)
class Limits:
    min_stories: int = 8
    max_stories: int = 24
    top: tuple[int, int] = (3, 6)
    brief: tuple[int, int] = (4, 8)
    max_lookback_hours: int = 480


def _none() -> Column:
    return F.lit(None).cast("string")


def _rows(df: DataFrame, rules: list[tuple[str, str, Column]], story: Column, detail: Column | None = None) -> DataFrame:
    """One row for each rule a row breaks."""
    found = F.array_compact(F.array(*[F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("severity"))) for rule, level, broken in rules]))
    told = (detail if detail is not None else _none()).cast("string").alias("detail")
    broken = df.select("date", story.cast("string").alias("story"), told, F.explode_outer(found).alias("r")).where("r is not null")  # the plain form would test the list first, which computes all rules again
    return broken.select("date", "story", "r.rule", "r.severity", "detail")


def edition_rules(editions: DataFrame, stories: DataFrame, limits: Limits) -> DataFrame:
    n = lambda p: F.count_if(F.col("prominence") == p)
    per = stories.groupBy("date").agg(F.count("*").alias("n"), n("lead").alias("lead"), n("top").alias("top"), n("brief").alias("brief"))
    one = editions.join(per, "date", "left").na.fill(0, ["n", "lead", "top", "brief"])
    rules = [
        ("V2", "E", F.col("file_date") != F.col("date")),
        ("V3", "E", F.col("n") < limits.min_stories),
        ("V4", "W", F.col("n") > limits.max_stories),
        ("V5", "E", F.col("lead") != 1),
        ("V6", "W", ~F.col("top").between(*limits.top)),
        ("V7", "W", ~F.col("brief").between(*limits.brief)),
    ]
    return _rows(one, rules, _none())


def story_rules(stories: DataFrame, beats: DataFrame, style: list[tuple[str, str]]) -> DataFrame:
    copies = lambda key: F.row_number().over(Window.partitionBy("date", key).orderBy("pos")) > 1
    keys = stories.select("date", "id", "slug", "pos").withColumn("__id2", copies("id")).withColumn("__slug2", copies("slug"))  # without the texts, which would be shuffled and sorted too
    twice = _rows(keys, [("V8", "E", F.col("__id2")), ("V9", "E", F.col("__slug2"))], F.col("id"))
    known = beats.select(F.col("id").alias("beat"), F.lit(True).alias("__beat"))
    s = stories.join(F.broadcast(known), "beat", "left")  # a row a section of the paper
    brief, upper = F.col("prominence") == "brief", F.col("prominence").isin("lead", "top")
    n_body, n_src = F.coalesce(F.size("body"), F.lit(0)), F.coalesce(F.size("sources"), F.lit(0))
    why = F.coalesce("whyItMatters", F.lit("")) != ""
    every = F.concat_ws(" ", "headline", "deck", F.concat_ws(" ", "summary"), F.concat_ws(" ", "body"), "whyItMatters")
    minutes = T.read_minutes(F.concat_ws(" ", "deck", F.concat_ws(" ", "summary"), F.concat_ws(" ", "body"), "whyItMatters"))
    prose = [F.col("headline"), F.col("deck"), F.concat_ws("\n", "summary"), F.concat_ws("\n", "body")]
    s = s.withColumn("__lint", F.explode_outer(F.array(T.style_lint(every, style))))  # a generator's column is computed once, however often it is used
    lint = F.col("__lint")
    longest = lambda p: F.when(p.contains('"'), F.array_max(T.quoted_runs(p)))
    rules = [
        ("V10", "E", ~F.col("id").startswith(F.col("date").cast("string"))),
        ("V11", "E", F.col("id") != F.concat_ws("-", F.col("date").cast("string"), "slug")),
        ("V12", "E", F.col("__beat").isNull()),
        ("V13", "E", brief & (n_body > 0)),
        ("V14", "E", ~brief & (n_body < 3)),
        ("V15", "E", ~brief & ~why),
        ("V16", "W", brief & why),
        ("V17", "E", n_src < F.when(upper, 2).otherwise(1)),
        ("V28", "W", upper & (F.col("confidence") == "low")),
        ("V31", "W", T.restates(F.col("deck"), F.col("headline"))),
        ("V32", "W", T.label_colon(F.col("headline"))),
        ("V36", "W", F.greatest(*[F.coalesce(longest(p), F.lit(0)) for p in prose]) > MAX_QUOTE),
        ("V37", "W", F.exists(lint, lambda x: x != "exclamation")),
        ("V38", "W", F.array_contains(lint, "exclamation")),
        ("V39", "W", F.abs(F.col("readMinutes") - minutes) > 2),
    ]
    return _rows(s, rules, F.col("id")).unionByName(twice)


def cited(stories: DataFrame) -> DataFrame:
    """One row a citation: date, story, pos, prominence, confidence, src_pos, and the source's columns."""
    return stories.select("date", F.col("id").alias("story"), "pos", "prominence", "confidence", F.posexplode("sources").alias("src_pos", "src")).select(
        "date", "story", "pos", "prominence", "confidence", "src_pos", "src.title", "src.publisher", "src.url", F.col("src.publishedAt").alias("published_at"), F.col("src.tier").alias("declared")
    )


def source_rules(stories: DataFrame, publishers: DataFrame, blocked: DataFrame, limits: Limits) -> DataFrame:
    c = cited(stories).withColumn("host", host_of(F.col("url")))
    c = c.join(host_matches(c, publishers, blocked).withColumnRenamed("publisher", "known"), "host", "left")
    c = c.withColumn("listed", F.col("known") != F.col("host"))
    first_use = first_uses(c.select("url", "date", F.col("story").alias("id"), "pos"))
    in_edition = Window.partitionBy("date", "url").orderBy("pos", "src_pos")
    c = c.join(first_use, "url").withColumn("__first", F.first("story").over(in_edition))
    end = F.timestamp_add("HOUR", F.lit(48), F.col("date").cast("timestamp"))  # a day beyond the edition's last hour
    age = hours_between(F.timestamp_add("HOUR", F.lit(24), F.col("date").cast("timestamp")), F.col("published_at"))
    rules = [
        ("V18", "E", F.col("host") == ""),
        ("V19", "E", F.col("blocked")),
        ("V20", "W", (F.col("host") != "") & ~F.col("blocked") & ~F.col("listed")),
        ("V21", "W", F.col("listed") & F.col("declared").isNotNull() & (F.col("declared") != F.col("tier"))),
        ("V22", "E", F.col("__first") != F.col("story")),
        ("V23", "E", F.col("first_date") < F.col("date")),
        ("V24", "E", F.col("published_at") > end),
        ("V25", "W", age > limits.max_lookback_hours),
    ]
    each = _rows(c, rules, F.col("story"), F.col("url"))
    who = F.lower(F.coalesce("known", "host"))
    per = c.where("not blocked").groupBy("date", "story", "prominence", "confidence").agg(F.min(F.coalesce("tier", F.lit(4))).alias("best"), F.count_distinct(who).alias("voices"))
    upper = F.col("prominence").isin("lead", "top")
    whole = [
        ("V26", "E", F.col("best") > 3),
        ("V27", "W", (F.col("prominence") == "lead") & (F.col("best") > 1)),
        ("V29", "E", (F.col("confidence") == "high") & (F.col("best") > 1)),
        ("V30", "E", upper & (F.col("voices") < 2)),
    ]
    return each.unionByName(_rows(per, whole, F.col("story")))


def restated_rules(stories: DataFrame) -> DataFrame:
    """V33: a headline much like one of an earlier edition (the first such)."""
    late = first_restated(stories, "id", F.col("headline"), "date").where("earlier_at < at")
    return late.select(F.col("at").alias("date"), F.col("id").alias("story"), F.lit("V33").alias("rule"), F.lit("W").alias("severity"), F.col("earlier").alias("detail"))


def longest_run(ours: Column, theirs: Column) -> Column:
    """The longest common run of two short word lists, by diagonal in one fold over our words."""
    zeros = F.transform(theirs, lambda _: F.lit(0))
    start = F.struct(zeros.alias("row"), F.lit(0).alias("n"), F.lit(0).alias("end"), F.lit(0).alias("i"))

    def step(a: Column, w: Column) -> Column:
        row = F.transform(theirs, lambda t, j: F.when(t == w, F.coalesce(F.get(a["row"], j - 1), F.lit(0)) + 1).otherwise(F.lit(0)))
        top = F.coalesce(F.array_max(row), F.lit(0))
        better = top > a["n"]
        return F.struct(row.alias("row"), F.when(better, top).otherwise(a["n"]).alias("n"), F.when(better, a["i"] + 1).otherwise(a["end"]).alias("end"), (a["i"] + 1).alias("i"))

    return F.aggregate(ours, start, step, lambda a: F.when(a["n"] > 0, F.slice(ours, a["end"] - a["n"] + 1, a["n"])).otherwise(F.array().cast("array<string>")))


def copied_rules(stories: DataFrame) -> DataFrame:
    """V34 and V35: words shared with a cited headline, beyond names and function words.

    Columns of generators are computed once, plain ones again wherever they are used: so fields are cleaned once, and words are cut and names sought
    only where a field holds a run of a title.
    """
    once = lambda c: F.explode_outer(F.array(c))
    bound = lambda c, f: F.transform(F.array(c), f)[0]
    ours = F.concat(F.array("headline", "deck"), F.coalesce("summary", F.array().cast("array<string>")), F.coalesce("body", F.array().cast("array<string>")))
    titles = F.filter(F.transform("sources.title", T.word_list), lambda t: F.size(t) > MAX_RUN)
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - MAX_RUN), lambda i: F.concat(F.lit(" "), F.array_join(F.slice(t, i, MAX_RUN + 1), " "), F.lit(" ")))
    s = stories.select("date", "id", ours.alias("ours"), "entities", once(titles).alias("titles")).where(F.size("titles") > 0).withColumn("fields", once(F.transform("ours", T.spaced_words)))
    share = lambda t: bound(grams(t), lambda gs: F.filter("fields", lambda f: F.exists(gs, lambda g: f.contains(g))))
    met = F.flatten(F.transform("titles", lambda t: F.transform(share(t), lambda f: F.struct(F.split(F.trim(f), " ").alias("words"), t.alias("theirs")))))
    s = s.withColumn("met", once(met)).where(F.size("met") > 0)
    s = s.withColumn("names", once(T.proper_nouns(F.array_join(F.concat("ours", F.coalesce("entities", F.array().cast("array<string>"))), ". "))))
    near = s.select("date", "id", "names", F.explode("met").alias("m"))
    runs = near.withColumn("run", once(longest_run(F.col("m.words"), F.col("m.theirs")))).where(F.size("run") > MAX_RUN)
    runs = runs.withColumn("n", T.expressive_length(F.col("run"), F.col("names")))
    rules = [("V34", "E", F.col("n") > MAX_EXPRESSIVE), ("V35", "W", (F.col("n") > SOME_EXPRESSIVE) & (F.col("n") <= MAX_EXPRESSIVE))]
    return _rows(runs, rules, F.col("id"), F.array_join("run", " "))


def review_rules(reviews: DataFrame, editions: DataFrame) -> DataFrame:
    """V40: a review made on other stories or one that cannot be read is an error, one without a binding a warning."""
    state = review_binding(reviews, editions)
    return _rows(state, [("V40", "E", F.col("state").isin("mismatch", "unreadable")), ("V40", "W", F.col("state") == "unbound")], _none(), F.col("state"))


def coverage_rules(stories: DataFrame, beats: DataFrame) -> DataFrame:
    """V41 and V42 for every edition and beat, also beats without a story."""
    grid = stories.select("date").distinct().withColumn("__b", F.lit(1)).join(F.broadcast(beats.select(F.col("id").alias("beat"), "quota", "min_quota", F.lit(1).alias("__b"))), "__b").drop("__b")  # dates by sections
    n = stories.groupBy("date", "beat").agg(F.count("*").alias("n"))
    full = grid.join(n, ["date", "beat"], "left").na.fill(0, ["n"])
    rules = [("V41", "E", F.col("n") < F.col("min_quota")), ("V42", "W", (F.col("n") >= F.col("min_quota")) & (F.col("n") < F.col("quota")))]
    return _rows(full, rules, _none(), F.col("beat"))


def shape_rules(breaches: DataFrame) -> DataFrame:
    """V1: what `jsonschema.conforming` found wrong (date, path, keyword)."""
    return breaches.select("date", _none().alias("story"), F.lit("V1").alias("rule"), F.lit("E").alias("severity"), F.concat_ws(" ", "path", "keyword").alias("detail"))


def validate(
    editions: DataFrame,
    stories: DataFrame,
    beats: DataFrame,
    publishers: DataFrame,
    blocked: DataFrame,
    reviews: DataFrame | None = None,
    limits: Limits = Limits(),  # noqa: B008
    style: list[tuple[str, str]] = (),
    breaches: DataFrame | None = None,
) -> DataFrame:
    """All violations of all editions; history is whatever of the same tables is older.

    Of a date with breaches of shape only these are told: its other rules would be noise.
    """
    if breaches is not None:
        wrong = breaches.select("date").distinct()
        editions, stories = (df.join(wrong, "date", "left_anti") for df in (editions, stories))
    out = edition_rules(editions, stories, limits)
    for part in (story_rules(stories, beats, list(style)), source_rules(stories, publishers, blocked, limits), restated_rules(stories), copied_rules(stories), coverage_rules(stories, beats)):
        out = out.unionByName(part)
    out = out if reviews is None else out.unionByName(review_rules(reviews, editions))
    return out if breaches is None else out.unionByName(shape_rules(breaches))


def results(violations: DataFrame, editions: DataFrame) -> DataFrame:
    """A row an edition: date, errors and warnings (each rule, story and detail, in order)."""
    told = F.concat_ws(" ", "rule", "story", "detail")
    of = lambda level: F.array_sort(F.collect_list(F.when(F.col("severity") == level, F.col("told"))))
    rows = violations.select("date", "severity", told.alias("told")).unionByName(editions.select("date", _none().alias("severity"), _none().alias("told")))
    return rows.groupBy("date").agg(of("E").alias("errors"), of("W").alias("warnings"))


def report(violations: DataFrame, strict: bool = False, ran_at: str | None = None) -> DataFrame:
    """ran_at, strict, total_errors, total_warnings, passed; `results` has the rows of each edition."""
    errors, warnings = F.count_if(F.col("severity") == "E"), F.count_if(F.col("severity") == "W")
    out = violations.agg(F.lit(ran_at).cast("string").alias("ran_at"), F.lit(strict).alias("strict"), errors.alias("total_errors"), warnings.alias("total_warnings"))
    return out.withColumn("passed", (F.col("total_errors") == 0) & (F.lit(not strict) | (F.col("total_warnings") == 0)))


__all__ = ["Limits", "beat_coverage", "cited", "longest_run", "report", "results", "validate"]
