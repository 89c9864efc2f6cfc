"""Vectors against all pairs; pages against known main text."""

import math
import time

import numpy as np
import pytest

from newsloom.llm import embedding_dedup, html_extraction
from newsloom.llm.html_pages import NOISE, Writer

from .test_documents import components


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 64))
    near = [b + rng.standard_normal(64) * rng.choice([0.1, 0.3, 0.45, 0.6]) for b in base for _ in range(5)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*base, *near])]
    rows += [(500 + i, rows[3][1]) for i in range(9)] + [(600, [2 * x for x in rows[3][1]])]
    rows += [(700, None), (701, []), (702, [0.0] * 64), (703, [math.nan] * 64), (704, [math.inf] + [1.0] * 63), (705, [None] + [1.0] * 63), (706, [1.0, 0.0]), (707, [1.0, 0.1]), (3, rows[3][1])]
    return rows


@pytest.mark.parametrize(("tile", "kind"), [(embedding_dedup.TILE, "float"), (7, "float"), (embedding_dedup.TILE, "double")])
def test_links_equal_all_pairs(spark, tile, kind):
    rows = vectors()
    if kind == "double":  # cosines that single precision cannot tell from 0.9, and lengths beyond it
        rows += [(800, [1.0, 0.0, 0.0]), (801, [0.9, math.sqrt(0.19) - 1e-12, 0.0]), (802, [0.9, 0.0, math.sqrt(0.19) + 1e-9]), (803, [1e200, 1e199, 0.0]), (804, [1e-200, 1e-201, 0.0])]
    df = spark.createDataFrame([(*x, 9, 1, 2, "s") for x in rows], f"vec_id long, embedding array<{kind}>, label int, dim int, node long, __e string").repartition(3)
    one = np.float32 if kind == "float" else float
    unit = lambda v: np.array(v, one).astype(float) / max(map(abs, v))
    fine = [(k, i, unit(v)) for k, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, _, x in fine for b, _, y in fine if a != b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9]
    comp = components(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[comp[k]] = min(least.get(comp[k], i), i)
    want = sorted((i, sum(a == k for a, _ in links), least[comp[k]], i == least[comp[k]]) for k, (i, _) in enumerate(rows))
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df, tile=tile).collect()) == want
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_budgets_cover_the_distance():
    for dim in (1, 2, 16, 50, 64, 100):
        assert embedding_dedup.budgets(dim, 0.9).sum() >= 0.2
        assert embedding_dedup.blocks(dim)[-1].stop == dim
        q = embedding_dedup.rotation(dim)
        assert np.allclose(q @ q.T, np.eye(dim))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad --><div class="ad">Buy this now. It is cheap.</div>
<article><h1>Head &amp; line</h1><p><b>First part of the text, with  some&nbsp;words.<br><p>Second <i>par</i>t follows here, and it is longer than the first one.</p><p>Short.</p></article>
<footer>&copy; host &middot; words of the footer.</footer>"""


def test_extracts_the_article(spark):
    pages = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "  "), (5, "u", "<nav><a href=x>only links</a></nav>"), (None, "u", PAGE), (1, "u", PAGE), (6, "u", "<p>" + "<div>" * 3000), (7, "u", '<a href="')]
    got = html_extraction.extract(spark.createDataFrame([(*x, "t") for x in pages], "page_id long, url string, html string, text string")).collect()
    want = "Head & line First part of the text, with some words. Second part follows here, and it is longer than the first one. Short."
    assert sorted((g["page_id"] or 0, g["text"]) for g in got if g["page_id"] in (None, 1)) == [(0, want), (1, want), (1, want)]
    assert all(g["text"] == "" for g in got if g["page_id"] in (2, 3, 4, 5)) and len(got) == len(pages)
    none = spark.createDataFrame([], "page_id long, url string, html string, text string, title string")
    assert html_extraction.extract(none).count() == 0


@pytest.mark.parametrize("page", ["<div>" * 100_000, "<span>" * 100_000 + "</p>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<ul><li>" * 50_000, "<div>x" * 50_000 + "</div>y" * 50_000])
def test_deep_nesting_is_read_in_linear_time(page):
    began = time.process_time()
    html_extraction.Page(page).tree()
    assert time.process_time() - began < 6


def test_held_out_pages():
    x, y = html_extraction.training_nodes(80, seed=11)
    assert ((html_extraction.model().log_odds(x) > 0) == (y > 0)).mean() > 0.98
    assert Writer(1).page() == Writer(1).page()


@pytest.mark.parametrize("kind", ["ad", "comments", "nav", "notice", "related", "sidebar"])
def test_kinds_of_noise_that_training_never_saw(kind):
    """A model fitted without one kind of part, on pages that have only that kind beside the article."""
    from newsloom.llm.gbt import Boosted

    trees = Boosted(trees=25).fit(*html_extraction.training_nodes(150, noise=tuple(k for k in NOISE if k != kind)))
    precision, recall = html_extraction.measured(trees, 40, 23, (kind,))
    assert precision > 0.9 and recall > 0.9


def test_decoding_never_contradicts():
    rng = np.random.default_rng(0)
    parent = [-1, *(int(rng.integers(0, k)) for k in range(1, 60))]
    kept = html_extraction.decode(parent, rng.standard_normal(60) * 2)
    assert all(kept[parent[k]] for k in range(1, 60) if kept[k])
