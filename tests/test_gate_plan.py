"""The gate reads, cuts and moves texts no more often than its rules need."""

import re

import pytest
from pyspark.sql import functions as F

from newsloom import config as C
from newsloom.functions import text as T
from newsloom.operators import validate
from newsloom.plans.adapters import edition_stories

ODD = ["", " ", "One", " two  three\t", "Ünïcode wörds – ÉTÉ", "a-b\n\x0bc_d.", "...", "x1  Y2!", " İ K z", None]
ALIKE = "the quay opened early today and seven ships have docked"


@pytest.fixture(scope="module")
def stories(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("gate"))
    texts = [(i, f"Harbour {i} opens. {ALIKE}\nSecond line {i}!\n{ALIKE} again", "en") for i in range(33)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    pages = [(i, f"https://thre.example.net/{i}", f"<title>Report: {ALIKE}</title>") for i in range(5)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return edition_stories(spark, folder)[1]


def nodes(df):
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        yield plan
        todo += [plan.children().apply(i) for i in range(plan.children().size())]


def columns(plan):
    return {plan.output().apply(i).name() for i in range(plan.output().size())}


def test_doubled_keys_are_sought_without_the_texts(spark, stories):
    rules = validate.story_rules(stories, C.beats(spark, C.TEST), list(C.TEST.style))
    windows = [columns(p) for p in nodes(rules) if p.nodeName() == "Window"]
    assert windows and not any(w & {"text", "lines", "body", "deck", "summary"} for w in windows)


def test_a_headline_is_cut_before_the_join(stories):
    joins = [columns(p) for p in nodes(stories.select("date", "id", "headline")) if p.nodeName() == "Join"]
    assert joins and not any(j & {"text", "lines"} for j in joins)


def test_a_text_is_cut_into_lines_once(stories):
    plan = stories._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"split\(text", plan)) == 1


def test_a_linted_text_is_made_once(spark):
    made = spark.createDataFrame([("Erand", "on!"), ('"Hey!"', "x")], "a string, b string").repartition(2)
    lint = made.select("a", T.style_lint(F.concat_ws("~", "a", "b"), list(C.TEST.style)).alias("lint"))
    assert lint._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(") == 1
    assert {r.a: r.lint for r in lint.collect()} == {"Erand": ["hype: erand", "exclamation"], '"Hey!"': []}


def test_words_are_the_runs_of_letters_and_digits(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "x string").select("x", F.lower("x").alias("low"), T.word_list(F.col("x")).alias("words"), T.spaced_words(F.col("x")).alias("said")).collect()
    for r in rows:
        words = re.findall("[a-z0-9]+", r.low or "")
        assert r.words == words and r.said.split() == words
        assert r.said == (" " + " ".join(words) + " " if words else " ")


def test_bounds_hold_at_both_ends_of_a_style_rule(spark):
    df = spark.createDataFrame([(x,) for x in ("cat", "a cat.", "cats", "concat", "cat_", "DOG", "a conbird", "birdie")], "x string")
    rules = [(T.bounded("cat|dog"), "one"), (T.bounded("cat") + "|" + T.bounded("dog"), "two"), (T.bounded("cat") + "|bird", "three"), (T.bounded("(c)at|(d)og"), "groups")]
    got = {r[0]: r[1] for r in df.select("x", T.style_lint(F.col("x"), rules)).collect()}
    every = [label for _, label in rules]
    assert got == {"cat": every, "a cat.": every, "cats": [], "concat": [], "cat_": [], "DOG": ["one", "two", "groups"], "a conbird": ["three"], "birdie": ["three"]}


def test_copied_runs_are_told_of_each_field_and_title(spark, stories):
    found = validate.copied_rules(stories).groupBy("rule", "severity", "detail").count().collect()
    shared = {pos: 2 if pos > 6 else 4 for pos in range(11)}  # deck and summary, and two lines of the body, which briefs have not
    assert {(r.rule, r.severity, r.detail): r["count"] for r in found} == {("V34", "E", ALIKE): sum(shared[i % 11] * (i % 3 + 1) for i in range(33))}
