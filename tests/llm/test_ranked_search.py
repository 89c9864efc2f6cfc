import math
import random
import re

import pyarrow as pa
import pytest

from newsloom.llm import queries, ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) of all items by the formula, every document scored."""
    words = [(i, TERM.findall(lowered(t))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, length = len(words), sum(len(w) for _, w in words)
    out = []
    for item, text in items:
        asked = TERM.findall(lowered(text))
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t in set(asked) if (df := sum(t in w for _, w in words))}
        scores = []
        for i, w in words:
            m = 75 + 25 * len(w) * n // length
            s = sum(weight[t] * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 12 * m)) for t in asked if t in w)
            scores.append((-s, i is None, i or 0))
        best = sorted(x for x in scores if x[0])[:k]
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(best)]
    return out


@pytest.fixture()
def items_rows(docs_rows):
    texts = [t for _, t in docs_rows if t]
    return [("q0", texts[0]), ("q1", "Two WORDS words"), ("q1", "the the of"), ("q2", None), ("q3", " ,.; "), ("q4", "unknownword é"), (None, texts[8][-300:]), ("q5", " ".join(texts[-5:]))]


@pytest.mark.parametrize("block,step,item_bytes", [(32_768, 2048, 4 << 20), (7, 1, 4 << 20), (3, 16, 900)])
@pytest.mark.parametrize("k", [1, 5, 200])
def test_equals_all_scores(spark, docs, docs_rows, items_rows, monkeypatch, block, step, item_bytes, k):
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranked_search, "FIRST_STEP", step)
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", item_bytes)
    items = spark.createDataFrame([(*x, 1, 2) for x in items_rows], "item_id string, text string, rank int, score int")
    found = [tuple(r) for r in ranked_search.top_documents(docs, items, k).collect()]
    wanted = brute(docs_rows, items_rows, k)
    assert sorted(found, key=lambda x: tuple(map(repr, x))) == sorted(wanted, key=lambda x: tuple(map(repr, x)))


def test_stops_early_and_completes_scores():
    """On many documents of which few hold the rare terms, the bounds spare most postings and no score is cut."""
    import numpy as np

    r = random.Random(3)
    docs = [f"common words here {' '.join(r.choice('abcdefgh') for _ in range(r.randint(1, 20)))}" for _ in range(3000)]
    docs[1234] += " rare1 rare2 rare3"
    items = ranked_search.Items.of(pa.array([1]), pa.array(["rare1 rare2 rare3 common"]))
    words = [d.split() for d in docs]
    n, length = len(docs), sum(map(len, words))
    names = items.terms.to_pylist()
    df = {t: sum(t in w for w in words) for t in names}
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in names])
    held = [[(names.index(t), w.count(t)) for t in sorted(set(w)) if t in names] for w in words]
    sizes = np.array([len(x) for x in held])
    term, tf = (np.array([x[j] for h in held for x in h]) for j in (0, 1))
    impact = ranked_search.impacts(weight[term], tf, np.repeat([len(w) for w in words], sizes), n, length)
    block = ranked_search.Block(np.arange(n), np.zeros(n, bool), sizes, term, impact, len(names))
    places, times = items.lists[0]
    found, scores = block.search(places, times, 1, 0)
    assert 1234 in found and len(found) < 3000
    whole = {d: s for i, r_, d, s in brute(list(enumerate(docs)), [(1, "rare1 rare2 rare3 common")], 1)}
    assert dict(zip(found.tolist(), scores.tolist(), strict=True))[1234] == whole[1234]
    assert len(block.search(places, times, 1, int(scores.max()) + 1)[0]) == 0


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([("a", "the of")], "item_id string, text string")
    assert ranked_search.top_documents(empty, items).count() == 0
    assert ranked_search.top_documents(docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked_search.top_documents(docs, items.where("false")).count() == 0


def test_query_is_registered_with_sql():
    from newsloom.llm.oracles import ORACLES

    assert "op13_ranked_search" in queries.QUERIES and "op13_ranked_search" in ORACLES
