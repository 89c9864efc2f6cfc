"""The pipeline's stages against brute force over planted cases."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from newsloom.llm import simhash_texts

from .conftest import WORDS
from .test_documents import components, words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(8)
    line = lambda: " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(14)) + "."
    prose = lambda n: "\n".join(line() for _ in range(n))
    docs = {i: prose(5) for i in range(120)}
    for i in range(120, 180):  # junk
        docs[i] = "\n".join(line().replace(" ", "### ") for _ in range(5))
    passage, item = prose(4), " ".join(line() for _ in range(3)).replace(".", "")
    docs[200], docs[201] = prose(3) + "\n" + passage, passage + "\n" + prose(6)
    docs[202] = docs[5]  # a copy
    long_ = prose(40)
    docs[203], docs[204] = long_, long_.replace(" ", "  ", 1).replace(".", "!", 1)  # a near copy with no line window of its own left
    docs[205] = prose(2) + " " + item + " " + prose(2)
    docs[208] = prose(8).replace("\n", " ")
    docs[209] = docs[208].replace(docs[208].split(" ")[50], "edited", 1)  # a near copy without lines
    docs[206], docs[207] = "Short but fine of the tion.", None
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 120 <= i < 180), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), docs, passage, item


def test_stages(spark, corpus):
    sf_dir, docs, passage, item = corpus
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = now.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.written(stage(spark, now, sf_dir), "stage")
        assert now.columns == columns, name
        seen.append({r["doc_id"]: r["text"] for r in now.collect()})
    good, cut, near, clean = seen
    assert not any(120 <= i < 180 for i in good) and set(range(120)) <= set(good) and {200, 201, 202, 203, 204, 205} <= set(good)
    assert cut[200] == docs[200] and passage not in cut[201] and 202 not in cut  # the copy lost all its lines
    assert all(cut[i] == docs[i] for i in range(120))
    sets = {i: shingles(t) for i, t in cut.items()}
    comp = components(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    assert set(near) == set(comp.values()) and 208 in near and 209 not in near
    grams = {tuple(words(item)[k : k + 13]) for k in range(len(words(item)) - 12)}

    def share(text):
        w = words(text)
        hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in grams for j in range(k, k + 13)}
        return len(hit) / max(1, len(w))

    assert set(clean) == {i for i, t in near.items() if not share(t) >= 0.05} and 205 not in clean


def test_run_packs_what_is_kept(spark, corpus):
    sf_dir = corpus[0]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    whole = Counter()
    for r in rows:
        whole[r["doc_id"]] += r["length"]
    assert all(whole[r["doc_id"]] == r["doc_tokens"] for r in rows)
    assert set(range(120)) <= set(whole) and not {*range(120, 180), 202, 205} & set(whole)


def shingles(text):
    """Distinct runs of five words; A-Z in lower case, ASCII white space between words."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(r, base, most):
    w = list(base)
    for k in r.sample(range(len(w)), r.randint(0, most)):
        w[k] = "edited" + str(r.randint(0, 999))
    return " ".join(w)


def texts_around_the_threshold():
    r = random.Random(12)
    text = lambda n: [r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n)]
    docs = []
    for _ in range(12):
        base = text(r.randint(60, 120))
        docs += [edited(r, base, 4) for _ in range(5)]
    footer = " " + " ".join(text(12))
    docs += [" ".join(text(30)) + footer for _ in range(20)]  # alike in a footer only
    base = text(300)
    docs += [edited(r, base, 8) for _ in range(60)]  # a large group
    whole = text(14)  # 8 of 10 shingles shared, then 8 of 11
    return docs + [" ".join(whole), " ".join(whole[:-2]), " ".join([*whole[:-2], "x"]), None, "", " \n", "two words", "Two\t words", "É a", "é a"]


@pytest.mark.parametrize("hot", [None, 2])
def test_near_dedup_finds_the_jaccard_pairs(spark, hot):
    docs = dict(enumerate(texts_around_the_threshold()))
    sets = {i: shingles(t) for i, t in docs.items()}
    true = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    sure = {x["doc_id"] for x in simhash_texts.keep_one(df, hot_key=hot, recall=0.9999).collect()}
    assert sure == set(components(sets, true).values())
    if hot != 2:
        stage = {x["doc_id"] for x in corpus_pipeline.STAGES[2][1](spark, df, "").collect()}
        assert stage >= sure and len(stage - sure) <= 0.05 * (len(docs) - len(sure))


def test_pairs_meet_as_often_as_said(spark):
    """Of pairs at the threshold itself RECALL meet; no pair below it is linked."""
    r = random.Random(5)
    docs = {}
    for i in range(0, 600, 2):
        base = [r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(r.randint(40, 200))]
        docs[i], own = " ".join(base), list(base)
        for k in range(2, len(own), 5):  # edits in steps of a shingle, until the next would part them
            before = list(own)
            own[k] = f"edited{k}"
            if not alike(shingles(docs[i]), shingles(" ".join(own))):
                own = before
                break
        docs[i + 1] = " ".join(own)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    kept = {x["doc_id"] for x in simhash_texts.keep_one(df).collect()}
    assert all(i in kept for i in range(0, 600, 2))
    assert sum(i not in kept for i in range(1, 600, 2)) >= 0.93 * 300


def test_one_row_of_a_group_stays(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "other text under one id"), (3, "Other text under one id"), (4, "alone"), (4, "alone"), (None, "a b c d e f"), (None, None), (None, ""), (7, "x")]
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, node int, key int, n int")
    got = sorted(((x["doc_id"], x["text"]) for x in simhash_texts.keep_one(df).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (2, rows[2][1]), (4, "alone"), (7, "x")] + [x for x in got if x[0] is None], key=str)
    assert len([x for x in got if x[0] is None]) == 1
    assert simhash_texts.keep_one(df.where("false")).count() == 0
    assert simhash_texts.keep_one(df).columns == df.columns


def test_stages_keep_odd_rows_and_clashing_columns(spark, corpus, docs_rows):
    """Null and repeated ids and texts, and columns named as the operators name things inside."""
    sf_dir = corpus[0]
    extra = ["__id", "__key", "__lines", "__hits", "node", "component", "text_key", "score", "n", "words", "key", "u", "v"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), *extra) for i, t in docs_rows], schema).repartition(3)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert rows and all(tuple(r[c] for c in extra) == tuple(extra) for r in rows), name
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).columns == docs.columns
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(i for i, _ in docs_rows)
