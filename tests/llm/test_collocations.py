import random
import re
from collections import Counter

import pytest

from newsloom.llm import collocations

FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, longest, most):
    grams, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    grams[lang, tuple(words[i : i + k])] += 1
    out = []
    for lang in total:
        own = {w: a for (own, w), a in grams.items() if own == lang and len(w) > 1 and a >= least}
        found = []
        for w, a in own.items():
            covered = any(100 * b >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for v, b in own.items() if len(v) > len(w))
            if not covered:
                score, _, left, right = min((2_000_000 * a // (grams[lang, w[:c]] + grams[lang, w[c:]]), c, grams[lang, w[:c]], grams[lang, w[c:]]) for c in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def texts():
    r = random.Random(11)
    word = lambda: r.choice(["New", "york", "city", "é", "of", "the", "a", "a", "x\x1cy", "big"])
    one = lambda: "".join(word() + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ? "]) for _ in range(r.randint(0, 60)))
    rows = [(r.choice(["en", "en", "de", None, "und"]), one()) for _ in range(300)]
    return rows + [("en", "a a a a a a " * 40), ("en", None), ("en", ""), ("fr", " \t. "), ("de", rows[0][1])] + [("en", "Copied text, of the big city.")] * 50


@pytest.mark.parametrize("least,longest,most", [(30, 4, 2000), (5, 4, 10), (2, 5, 30)])
@pytest.mark.parametrize("together,bits", [(24 << 20, 26), (300, 6)])
def test_equals_brute_force(spark, monkeypatch, least, longest, most, together, bits):
    """Also with batches of few pieces and a bit table that is full."""
    monkeypatch.setattr(collocations, "TOGETHER", together)
    monkeypatch.setattr(collocations, "BITS", bits)
    monkeypatch.setattr(collocations, "BUCKET_BYTES", 2000)
    rows = texts()
    docs = spark.createDataFrame([(*x, i, "s") for i, x in enumerate(rows)], "lang string, text string, rank int, phrase string").repartition(3)
    found = sorted(tuple(r) for r in collocations.collocations(docs, least, longest, most).select(*FIELDS).collect())
    assert found == brute(rows, least, longest, most)


def test_empty_tables(spark):
    docs = spark.createDataFrame([("en", "too few words")], "lang string, text string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(docs.where("false")).columns == FIELDS
    assert collocations.collocations(docs.where("false")).count() == 0


def test_products_beyond_64_bits(spark):
    big = 6 * 10**13
    rows = [("en", "a", 1, 2 * big), ("en", "b", 1, big + 1), ("en", "a b", 2, big)]
    (r,) = collocations._scored(spark.createDataFrame(rows, "lang string, phrase string, k int, times long").select("lang", "phrase", "times", "k")).collect()
    assert r.score == 2_000_000 * big // (3 * big + 1)
