"""The document operators against plain Python over the same rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import decontamination, line_dedup, packing, quality, rans, sharding, simhash, suffix_dedup, token_store, tokens
from newsloom.llm.base import scratch
from newsloom.llm.components import connected_components
from newsloom.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY, vocabulary


def plain(text):
    return text or ""


def test_byte_shards_are_contiguous_balanced_and_gapless(docs, docs_rows, empty):
    got = sorted(sharding.byte_shards(docs, 5).collect(), key=lambda x: x["rank"])
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert [g["doc_id"] for g in got] == [x[0] for x in sorted(docs_rows, key=key)]
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == Counter((i, len(plain(t).encode()) + 16, zlib.crc32(plain(t).encode())) for i, t in docs_rows)
    assert [g["rank"] for g in got] == list(range(len(got)))
    total, largest = sum(g["size"] for g in got), max(g["size"] for g in got)
    by = defaultdict(list)
    for g in got:
        by[g["shard"]].append(g)
    assert sorted(by) == list(range(5)) and [g["shard"] for g in got] == sorted(g["shard"] for g in got)
    for rows in by.values():
        assert [g["slot"] for g in rows] == list(range(len(rows)))
        assert abs(sum(g["size"] for g in rows) - total / 5) <= largest
    assert sharding.byte_shards(empty).count() == 0


def library_ids(name, text, width="<u4"):
    """The ids by a tokenizer fresh from its file."""
    if name not in _library:
        _library[name] = Tokenizer.from_file(vocabulary(name))
    return np.array(_library[name].encode(plain(text), add_special_tokens=False).ids, width).tobytes()


_library = {}
ODD_TEXTS = [
    "  a", "a  b", "a \n b", "x\n\n y z", "foo .bar ,", "it's I'll WE'LL", "③ ½ 3.5", "İstanbul ΑΣ ΑΣ. ß é", "a\xa0b c", "\x1c a \x1f", "\x1d\nB", "日本語。", "end ", "end\n ", "a ́b", "😀,",
    "<|endoftext|> hi", "end.<|endoftext|>", "<|startoftext|>a", "<|ENDOFTEXT|>", "", None, "\n", "\nA b", "a\nb", "a\n\nb", "a\n\n\nb", "a\n", "a \nb", "a\r\nb", "a\r\n\r\nb", "A.\nThe.\nX,\n'tis\n5", "é\né.\nÉ,", " \n", "x\n'll y",
]


@pytest.mark.parametrize("name", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_pieces_give_the_librarys_ids(name, docs_rows, monkeypatch):
    r = random.Random(3)
    bits = ["a", "B", "c ", "the", " ", "\n", "\t", "\r", ".", ",", "'s", "'", "é", "É", "ß", "1", "23", "&", "\x1d", "\xa0", "<|endoftext|>", "\u0301", "Ω", "ll", " The"]
    texts = [*ODD_TEXTS, *(t for _, t in docs_rows), *("".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(3000))]
    end = np.array([2], "<u2").tobytes()
    for chunk, remembered in ((tokens.CHUNK, tokens.REMEMBERED), (200, 40)):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        monkeypatch.setattr(tokens, "REMEMBERED", remembered)
        enc = tokens.PieceEncoder(vocabulary(name), "<u2")
        column = pa.concat_arrays([pa.array(["before"]), pa.array(texts, pa.string())]).slice(1)
        assert enc.column(column, 2).to_pylist() == [library_ids(name, t, "<u2") + end for t in texts]
        assert enc.column(pa.array([], pa.string())).to_pylist() == []
    assert tokens.PieceEncoder(vocabulary(name)).encode("a b.\nc") == library_ids(name, "a b.\nc")


@pytest.mark.parametrize("name", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_very_long_texts_give_the_librarys_ids(name):
    r = random.Random(4)
    prose = " ".join("".join(r.choice(["tion", "é", "wh", "ing", "a"]) for _ in range(r.randint(1, 5))) for _ in range(500_000))  # some 5 MB
    assert tokens.PieceEncoder(vocabulary(name)).encode(prose) == library_ids(name, prose)


@pytest.mark.parametrize("name", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_pieces_of_several_parts_are_cut_once(name, monkeypatch):
    texts = pa.array(["(one) 2,5 it's;", "it's; \"é\" (one)", "2,5 (one) end\n(one)"] * 50)
    want = [library_ids(name, t, "<u2") for t in texts.to_pylist()]
    for most in (tokens.PARTS, 2):
        monkeypatch.setattr(tokens, "PARTS", most)
        enc, cut = tokens.PieceEncoder(vocabulary(name), "<u2"), []
        plain = enc._mixed
        monkeypatch.setattr(enc, "_mixed", lambda p, cut=cut, plain=plain: cut.append(p) or plain(p))
        for _ in range(3):
            assert enc.column(texts).to_pylist() == want
        assert len(enc.mixed) <= most
        assert most == 2 or len(cut) == len(enc.mixed)


def test_frequencies_count_documents():
    r = np.random.default_rng(8)
    docs = [(r.zipf(1.3, int(r.integers(1, 80))) % top).astype("<u2") for top in (40, 40, 900, 65_536) for _ in range(30)]
    column = pa.array([d.tobytes() for d in docs], pa.binary())
    batches = [pa.RecordBatch.from_arrays([column.slice(a, n)], ["ids"]) for a, n in ((0, 50), (50, 0), (50, 70))]
    (found,) = packing._frequencies(iter(batches), "<u2")
    assert dict(zip(*(c.to_pylist() for c in found.columns), strict=True)) == Counter(t for d in docs for t in set(d.tolist()))


def test_rans_round_trip_checkpoints_and_checksums():
    rng = np.random.default_rng(3)
    for n in (0, 1, 31, 64, 5000, 300_001):
        ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
        table = rans.Table.from_counts(*np.unique(ids, return_counts=True))
        block = rans.encode(ids, table, lanes=64, rows_per_checkpoint=16)
        assert (rans.decode(block, table) == ids).all()
        segments = rans.header(block)[3]
        if segments > 2:  # from a checkpoint in the middle, alone
            assert (rans.decode_segment(block, table, 1) == ids[64 * 16 : 2 * 64 * 16]).all()
            broken = block[:-3] + bytes([block[-3] ^ 1]) + block[-2:]
            with pytest.raises(ValueError):
                rans.decode(broken, table)
    one = np.full(100, 7, np.uint32)
    t = rans.Table.from_counts(np.array([7]), np.array([100]))
    assert (rans.decode(rans.encode(one, t), t) == one).all()
    with pytest.raises(ValueError):
        rans.encode(np.array([8], np.uint32), t)


def test_token_store_round_trip(spark, docs, docs_rows, empty, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 500)
    path = scratch(spark, "store")
    token_store.write_store(docs, path, vocabulary(BYTE_VOCABULARY), 2)
    enc = tokens.encoder(vocabulary(BYTE_VOCABULARY))
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda x: x["start"])
    end = np.array([2], "<u4").tobytes()
    assert Counter((g["doc_id"], bytes(g["ids"])) for g in got) == Counter((i, enc.encode(t) + end) for i, t in docs_rows)
    assert [g["doc_id"] is not None and g["doc_id"] for g in got] == sorted(g["doc_id"] is not None and g["doc_id"] for g in got)
    start = 0
    for g in got:
        assert g["start"] == start and g["n_ids"] == len(g["ids"]) // 4
        start += g["n_ids"]
    assert token_store.digest(empty, vocabulary(BYTE_VOCABULARY)).count() == 0


def test_packing_places_each_id_once(docs, docs_rows, empty):
    pieces = packing.pack(docs, vocabulary(WORD_VOCABULARY), 2, window=128, shard_tokens=2000)
    rows = pieces.collect()
    enc = tokens.encoder(vocabulary(WORD_VOCABULARY))
    end = np.array([2], "<u4").tobytes()
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(i for i, _ in docs_rows)
    assert sum(r["length"] for r in rows) == sum(len(enc.encode(t) + end) // 4 for _, t in docs_rows)
    text = {i: t for i, t in docs_rows if i not in (13, 14)}
    for i, t in text.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in own) == enc.encode(t) + end
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    short = 0
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 128
        short += at < 128
    tokens_ = sum(r["length"] for r in rows)
    assert short <= 2 * -(-tokens_ // 2000) and len(by) <= tokens_ / 128 + short  # padding in a shard's last window only
    assert packing.pack(empty, vocabulary(WORD_VOCABULARY)).count() == 0
    seqs = packing.sequences(pieces, 128).collect()
    assert len(seqs) == len(by) and all(len(s["ids"]) == 128 for s in seqs)


def test_packing_keeps_large_ids_beside_null_ones(spark):
    ids = [None, 2**53 + 1, 2**63 - 1, -(2**63)]
    pieces = packing.pack(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string"), vocabulary(WORD_VOCABULARY))
    assert {r["doc_id"] for r in pieces.collect()} == set(ids)


def test_packing_prefers_related_documents():
    docs = [np.array([i % 2 * 100 + k for k in range(10)] + [500 + i], np.uint32) for i in range(12)]
    df = np.bincount(np.concatenate(docs), minlength=600)
    df[:200] = 2  # rare in the whole corpus
    rows = packing.fill(docs, packing.Index(docs, df, 1000, 11.0), 33)
    first = [d for d, _, _, w, _ in rows if w == 0]
    assert {d % 2 for d in first} == {0}


def test_bm25_scores_and_ranks_equal_the_formula():
    r = np.random.default_rng(4)
    docs = [(r.zipf(1.4, int(r.integers(1, 60))) % 90).astype(np.uint16) for _ in range(40)]
    docs += [docs[3], docs[3]]  # equal scores rank in order
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=90)
    mean = float(np.mean([len(d) for d in docs]))
    index = packing.Index(docs, df, len(docs), mean)

    def score(q, d):
        out = 0.0
        for t in set(q.tolist()):
            tf, idf = d.tolist().count(t), np.log(max((len(docs) - df[t] + 0.5) / (df[t] + 0.5), 1.0))
            out += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        return out

    for q in docs[:10]:
        want = [score(q, d) for d in docs]
        got = index.scores(q)
        assert got == pytest.approx(want, rel=1e-5)
        used = np.zeros(len(docs), bool)
        used[::7] = True
        assert list(packing.ranked(got, used, 3)) == sorted(np.flatnonzero(~used).tolist(), key=lambda i: (-got[i], i))


def test_related_documents_are_neighbours_in_the_order():
    r = np.random.default_rng(5)
    topics = [r.integers(2000, 5000, 30) for _ in range(100)]
    docs = [np.concatenate([r.choice(t, 25), r.integers(0, 300, 40)]) for t in topics for _ in range(5)]
    place, key = packing.races(5000)[0]
    assert sorted(place) == sorted(key) == list(range(5000))
    keys = [key[place[d].min()] for d in docs]
    same = np.mean([keys[a] == keys[b] for a in range(500) for b in range(a + 1, min(500, a - a % 5 + 5))])
    other = np.mean([keys[a] == keys[b] for a in range(0, 500, 5) for b in range(a + 5, 500, 5)])
    assert same > 0.25 and other < 0.02
    long_ = [keys[i] for i in range(500) if i % 5 == 0]
    assert abs(np.mean(long_) - 2500) < 500  # keys of texts of any length lie anywhere


def fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", plain(text).encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("hot", [simhash.HOT_KEY, 1])
def test_simhash_equals_all_pairs(docs, docs_rows, empty, hot):
    got = simhash.near_duplicates(docs, hot_key=hot).collect()
    fps = [fingerprint(t) for _, t in docs_rows]
    assert Counter((g["doc_id"], g["fp"] & (1 << 64) - 1) for g in got) == Counter(zip((i for i, _ in docs_rows), fps, strict=True))
    comp = components(set(fps), [(a, b) for a in set(fps) for b in set(fps) if a < b and bin(a ^ b).count("1") <= 3])
    least = defaultdict(list)
    for (i, _), f in zip(docs_rows, fps, strict=True):
        least[comp[f]].append(i)
    want = Counter((i, min((x for x in least[comp[f]] if x is not None), default=None)) for (i, _), f in zip(docs_rows, fps, strict=True))
    assert Counter((g["doc_id"], g["component_id"]) for g in got) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_random_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(6)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in near})
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3])
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for hot in (10_000, 2):
        got = {r["node"]: r["component"] for r in connected_components(simhash.fingerprint_links(df, 3, hot)).collect()}
        assert {x: got.get(x, x) for x in fps} == want


def test_plan_fulfils_the_pigeonhole():
    both = np.full((64, 64), 250.0)
    np.fill_diagonal(both, 500.0)
    for n in (1000, 10**6, 10**9):
        groups = simhash.plan(n, both * n / 1000, 3)
        assert sum(t + 1 for t, _ in groups) == 4
        bits = [b for _, g in groups for b in g]
        assert len(bits) == len(set(bits))


@pytest.mark.parametrize("one_task", [0, 10, 1 << 20])
def test_components_of_chains_and_stars(spark, one_task):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (200, 201), (200, 201), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long").repartition(5), one_task=one_task).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long"), one_task=one_task).count() == 0


def covered(texts, length):
    seen = Counter(b[s : s + length] for b in texts for s in range(len(b) - length + 1))
    for b in texts:
        mask = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                mask[s : s + length] = True
        yield mask[:-1], int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())


@pytest.mark.parametrize(("length", "gram", "hot"), [(400, 160, suffix_dedup.HOT_ANCHOR), (40, 16, 2), (40, 16, suffix_dedup.HOT_ANCHOR)])
def test_suffix_dedup_equals_all_windows(docs, docs_rows, empty, length, gram, hot):
    got = suffix_dedup.dedup(docs, length, gram, hot).collect()
    want = Counter()
    for (i, t), (mask, spans) in zip(docs_rows, covered([plain(t).encode() for _, t in docs_rows], length), strict=True):
        data = np.frombuffer(plain(t).encode(), np.uint8)
        want[i, len(data), int(mask.sum()), spans, bytes(data[~mask])] += 1
    assert Counter((g["doc_id"], g["n_bytes"], g["n_removed"], g["n_spans"], bytes(g["kept"])) for g in got) == want
    assert suffix_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("chunk", [130, 1000, 1 << 20])
def test_anchors_do_not_depend_on_pieces(monkeypatch, chunk):
    r = random.Random(4)
    texts = [bytes(r.choice(b"abcd") for _ in range(n)) for n in (5000, 39, 40, 169, 170, 171, 2000)]
    texts += [texts[0], b"ab" * 900]  # a repeated row stays a document of its own
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(texts), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text_key", "data"])
    got = Counter((key, p) for out in suffix_dedup._anchored(iter([batch]), 40, 16) for key, p in zip(out.column("text_key").to_pylist(), out.column("pos").to_pylist(), strict=True))
    want = set()
    for i, t in enumerate(texts):
        for s in range(len(t) - 39):  # each window by itself
            at, _ = suffix_dedup.anchors(np.frombuffer(t[s : s + 40], np.uint8), np.ones(40, bool), 40, 16)
            want |= {(i, s + int(a)) for a in at}
    assert set(got) == want and set(got.values()) == {1}


def test_suffix_dedup_leaves_long_texts_without_repeats(spark):
    r = random.Random(6)
    lone = r.randbytes(1_300_000).hex()
    seam = r.randbytes(1_048_000 // 2).hex()
    passage = r.randbytes(600).hex()
    rows = [(1, lone), (2, seam + passage + r.randbytes(200_000).hex()), (3, "short " + passage)]
    got = {g["doc_id"]: (g["n_removed"], g["n_spans"], bytes(g["kept"]).decode()) for g in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (0, 0, lone)
    assert got[2] == (1200, 1, rows[1][1].replace(passage, "")) and got[3] == (1200, 1, "short ")


def test_suffix_dedup_counts_bytes_not_words(spark):
    r = random.Random(12)
    other = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    short = " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(79))  # 394 bytes
    under, just = "[" + short + "....", "[" + short + "....."  # 399 and 400 bytes
    assert (len(short.split()), len(under), len(just)) == (79, 399, 400)
    for passage, gone in ((short, 0), (under, 0), (just, 400)):
        texts = [other(300) + passage + other(300) for _ in range(2)] + [other(900)]
        got = suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert {x["doc_id"]: x["n_removed"] for x in got} == {0: gone, 1: gone, 2: 0}
    alone = suffix_dedup.dedup(spark.createDataFrame([(0, other(200) + just + other(200) + just)], "doc_id long, text string")).collect()
    assert [(x["n_removed"], x["n_spans"]) for x in alone] == [(800, 2)]


def test_suffix_sort_orders_groups():
    rng = np.random.default_rng(2)
    rows = rng.integers(97, 99, (200, 30)).astype(np.uint8)
    lens = rng.integers(0, 31, 200)
    for i, n in enumerate(lens):
        rows[i, n:] = 0
    start = np.repeat([0, 1, 3, 50], [1, 2, 47, 150])
    size = np.repeat([1, 2, 47, 150], [1, 2, 47, 150])
    s = suffix_dedup.Suffixes(rows, lens)
    order, shared = s.neighbours(s.sort(start, size), start, size)
    said = [(start[i], rows[i, : lens[i]].tobytes()) for i in order]
    assert said == sorted(said)
    for k in range(199):
        if start[k] == start[k + 1]:
            a, b = said[k][1], said[k + 1][1]
            assert shared[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain(text).translate({c: c + 32 for c in range(65, 91)})) if w]


def test_decontamination_equals_all_windows(spark, docs, docs_rows, empty):
    text = dict(docs_rows[8:11])[9]
    items = [(1, " ".join(words(text)[40:70])), (2, "Two words"), (3, None), (4, "..."), (10, " ".join(words(text)[45:58])), (5, "absent item of several words"), (None, "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = defaultdict(set)
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[k : k + 13])].add(item)
    want = Counter()
    for i, t in docs_rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        ids = sorted(str(x) for x in found if x is not None)
        want[i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    got = decontamination.report(docs, bench).drop("text_key").collect()
    assert Counter(tuple(g) for g in got) == want
    assert decontamination.report(empty, bench).count() == 0
    assert decontamination.report(docs, bench.where("false")).where("n_hit > 0 or contaminated").count() == 0
    bad = {k[0] for k in want if k[-1]}
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs_rows} - bad
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench, "spans").collect()}
    assert cut[7] == "" and cut[3] is None and cut[4] == "" and words(cut[9]) == words(text)[:40] + words(text)[70:]


def test_line_dedup_keeps_first_occurrences(docs, docs_rows, empty):
    seen, want = {}, Counter()
    order = sorted({(i, t) for i, t in docs_rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0, str(x[1])))
    gone = defaultdict(set)
    for i, t in order:
        lines = [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
        for a, b, c in zip(lines, lines[1:], lines[2:], strict=False):
            key = (a[1], b[1], c[1])
            if seen.setdefault(key, (i, t, a[0])) != (i, t, a[0]):
                gone[i, t] |= {a[0], b[0], c[0]}
    for i, t in docs_rows:
        out = t if t is None or not gone[i, t] else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, t])
        want[i, out, len(gone[i, t]) if t is not None else 0] += 1
    cut = line_dedup.dedup_lines(docs)
    assert Counter((g["doc_id"], g["text"], g["__n_removed"]) for g in cut.collect()) == want
    assert cut.drop("__n_lines", "__n_removed").columns == docs.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_quality_learns_and_holds_out(spark, docs, empty):
    def text(i):
        body = " ".join(f"w{(i * 7 + k * k) % 50} of." for k in range(30))
        return body if i % 3 else body.replace(".", "###")

    rows = spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(rows, quality.fit(rows, labels)).collect()
    for g in got:
        assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2)
        assert g["predicted"] == int(g["score"] >= 0.7) and 0 <= g["score"] <= 1
    held = [g for g in got if g["held_out"]]
    assert held and sum(g["predicted"] == int(g["doc_id"] % 3 > 0) for g in held) / len(held) > 0.95
    assert quality.score(docs, quality.fit(docs, labels)).count() == docs.count()
    none = quality.fit(docs, labels.where("false"))
    assert not none.any() and {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0
    assert quality.keep_good(rows, labels).where(F.col("doc_id") % 3 == 0).count() == 0
    assert not quality.fit(empty, labels).any() and quality.keep_good(docs, labels.where("false")).count() == 0
    assert quality.keep_good(empty, labels).count() == 0


def test_quality_weights_equal_plain_updates(spark, monkeypatch):
    monkeypatch.setattr(quality, "PART", 7)  # every text is several rows
    r = random.Random(2)
    docs = [(r.choice([i, 5, 6]), " ".join(r.choice(["a", "b.", "ccc", "d,", "!!"]) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(8, None), (9, ""), (None, "a a b")]
    docs += [docs[7], docs[7]]
    labels = {i: i % 2 for i in range(60)}
    got = quality.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), bits=8)

    z, n = defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= 0.002 else -(z[k] - math.copysign(0.002, z[k])) / ((1 + math.sqrt(n[k])) / 0.5 + 0.01)
    rows = [(zlib.crc32(str(i).encode()), i, F_xxhash64(t), t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    for _ in range(3):
        for _, i, _, t in sorted(rows, key=lambda x: x[:3]):
            at, x = quality.features(t, 8)
            at, x = at.tolist(), x.astype(np.float32).tolist()
            w = [weight(k) for k in at]
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for k, v, wk in zip(at, x, w, strict=True):
                g = (p - labels[i]) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.5 * wk
                n[k] += g * g
    assert got == pytest.approx([weight(k) for k in range(257)], abs=1e-5)


def F_xxhash64(text):
    """Spark's xxhash64 of a string: seed 42, signed; a null leaves the seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h
