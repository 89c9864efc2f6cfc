"""Texts of several megabytes through every text operator and pipeline stage."""

import random
import time
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import decontamination, html_extraction, line_dedup, packing, quality, simhash, simhash_texts, suffix_dedup, token_store
from newsloom.llm.base import scratch
from newsloom.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY, vocabulary

from .conftest import WORDS
from .test_documents import fingerprint, library_ids

ITEM = " ".join(f"itemword{k}" for k in range(20))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(9)
    lines = [" ".join(r.choice(WORDS) + str(r.randint(0, 9999)) for _ in range(12)) + "." for _ in range(60_000)]
    long_ = "\n".join(lines)
    other = [x.replace(" ", " x", 1) for x in lines[:50_000]]  # no three lines in a row in common
    other[40_000] = ITEM
    return [(1, long_), (2, "\n".join(other)), (3, "short and fine of the tion."), (4, long_), (5, ITEM + " and little else."), (6, None)]


@pytest.fixture(scope="module")
def long_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_store_and_packing(spark, rows, long_docs):
    path = scratch(spark, "long-store")
    token_store.write_store(long_docs, path, vocabulary(BYTE_VOCABULARY), 2)
    end = np.array([2], "<u4").tobytes()
    want = {i: library_ids(BYTE_VOCABULARY, t) + end for i, t in rows}
    got = {r["doc_id"]: (r["n"], r["c"]) for r in token_store.read_store(spark, path).select("doc_id", F.col("n_ids").alias("n"), F.crc32("ids").alias("c")).collect()}
    assert got == {i: (len(b) // 4, zlib.crc32(b)) for i, b in want.items()}
    pieces = packing.pack(long_docs, vocabulary(WORD_VOCABULARY), 2).select("doc_id", "start", "length", "doc_tokens", "ids").collect()
    for i, t in rows:
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert b"".join(bytes(p["ids"]) for p in own) == library_ids(WORD_VOCABULARY, t) + end


def test_fingerprints(rows, long_docs):
    found = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(long_docs).collect()}
    assert found[1] == found[4] == (fingerprint(rows[0][1]), 1) and found[5][1] == 5
    kept = {r["doc_id"] for r in simhash_texts.keep_one(long_docs).select("doc_id").collect()}
    assert kept == {1, 2, 3, 5, 6}


@pytest.mark.parametrize("size", [suffix_dedup.CHUNK - 1, suffix_dedup.CHUNK, suffix_dedup.CHUNK + 1, suffix_dedup.CHUNK + 399, suffix_dedup.CHUNK + 400, 3 * suffix_dedup.CHUNK])
def test_suffixes_at_the_chunk(spark, size):
    r = random.Random(size)
    text = r.randbytes(size // 2 + 1).hex()[:size]
    passage = text[-500:]
    rows = [(1, text), (2, "before " + passage + " after"), (3, r.randbytes(300).hex())]
    got = {g["doc_id"]: (g["n_bytes"], g["n_removed"], g["n_spans"], bytes(g["kept"]).decode()) for g in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (size, 500, 1, text[:-500]), 2: (513, 500, 1, "before  after"), 3: (600, 0, 0, rows[2][1])}


def test_suffixes_of_whole_copies(rows, long_docs):
    got = {g["doc_id"]: (g["n_removed"], g["n_spans"]) for g in suffix_dedup.dedup(long_docs).collect()}
    size = len(rows[0][1].encode())
    assert got[1] == got[4] == (size, 1) and got[3] == (0, 0) and got[6] == (0, 0)


def test_lines_and_benchmark_in_linear_time(spark, rows, long_docs):
    began = time.time()
    cut = {r["doc_id"]: (r["__n_lines"], r["__n_removed"], r["text"]) for r in line_dedup.dedup_lines(long_docs).collect()}
    assert cut[1] == (60_000, 0, rows[0][1]) and cut[4] == (60_000, 60_000, "") and cut[2][1] == 0
    bench = spark.createDataFrame([(1, ITEM), (2, rows[0][1])], "item_id long, text string")
    spans = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(long_docs, bench, "spans").collect()}
    assert spans[1] == spans[4] == "" and spans[2] == rows[1][1].replace(ITEM + "\n", "") and spans[5] == "and little else."
    told = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.report(long_docs, bench.where("item_id = 1")).collect()}
    assert told[2] == (20, 1, False) and told[5] == (20, 1, True) and told[1] == (0, 0, False)
    assert time.time() - began < 120


def test_quality_of_long_texts(spark, rows, long_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.score(long_docs, quality.fit(long_docs, labels)).collect()}
    assert scores[1] == scores[4] and all(0 <= s <= 1 for s in scores.values())


def test_long_page(spark, rows):
    body = "".join(f"<p>{line}</p>" for line in rows[0][1].split("\n")[:40_000])
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href=/a>a</a></li></ul></nav><article><h1>Head</h1>{body}</article><footer>&copy; words</footer></body></html>"
    got = html_extraction.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert got["text"] == "Head " + " ".join(rows[0][1].split("\n")[:40_000])


def test_stages(spark, rows, long_docs, tmp_path):
    good = [(i, t, "en", "s", len(t or "")) for i, t in rows] + [(100 + i, f"plain words of the tion number {i} and more.", "en", "s", 40) for i in range(40)] + [(200 + i, "### $$ ### " * 9, "en", "s", 40) for i in range(40)]
    spark.createDataFrame(good, long_docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(200 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    empty = now.where("false")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[0][1](spark, empty, str(tmp_path)).count() == 0
    tokens = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    assert not any(i >= 200 or i in (4, 5) for i in tokens)
    for i, t in rows[:2]:
        if i in tokens:
            assert tokens[i] == len(library_ids(WORD_VOCABULARY, t)) // 4 + 1
