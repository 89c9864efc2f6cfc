"""Phrase collocations: weighted n-grams of distinct pieces, counted out-of-core in duckdb by hash bucket.

Texts are cut into pieces and equal pieces become one row with its number of copies. Phrases are counted level by level: those of
k words only where both phrases of k - 1 words inside them may be frequent, which a bit table of fixed size tells
(it errs only by letting more through, and where it is full the counts are just dearer). Tasks add up what their batches
hold, the shuffle deals phrases to hash buckets, and each bucket is one duckdb aggregation that can leave memory for
the shared folder. The counts of a phrase's parts are asked by rows that are shuffled to the part's bucket and back.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.base import discard, folded, lean, partitions, prepare, row_chunks, written

#: Bytes of pieces that a task adds up before it sends them on, bytes of pieces for each hash bucket.
TOGETHER, BUCKET_BYTES = 24 << 20, 64 << 20
#: Bits of the table of frequent phrases.
BITS = 26
#: Memory of one bucket's aggregation before it spills.
BUCKET_MEMORY = "400MB"

# Fixed values of the rule: bytes that end a piece become line ends, a tab is a space, A to Z become lower case.
FOLD = bytes(0x0A if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c for c in bytes(range(256)).lower())
SCALE, COVERED = 2_000_000, (100, 80)

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _repeats(lang: pa.Array, piece: pa.Array, times: pa.Array | None = None) -> pa.RecordBatch:
    t = pa.table({"lang": lang, "piece": piece, "times": times if times is not None else pa.array(np.ones(len(piece), np.int64))})
    t = t.group_by(["lang", "piece"], use_threads=False).aggregate([("times", "sum")])
    return pa.RecordBatch.from_arrays([t[c].combine_chunks() for c in ("lang", "piece", "times_sum")], ["lang", "piece", "times"])


def distinct_pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, times): each piece of a language once, words apart by one space, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in row_chunks(b["text"]):
                lists = pc.split_pattern(folded(b["text"].slice(lo, hi - lo), FOLD), "\n")
                lang = pc.fill_null(b["lang"].slice(lo, hi - lo), "und").take(pa.array(np.repeat(np.arange(hi - lo), np.diff(lists.offsets.to_numpy()))))
                pieces = pc.ascii_trim(lists.values, characters=" ")
                if pc.any(gaps := pc.match_substring(pieces, "  ")).as_py():
                    pieces = pc.if_else(gaps, pc.replace_substring_regex(pieces, " +", " "), pieces)
                some = pc.greater(pc.binary_length(pieces), 0)
                yield _repeats(lang.filter(some), pieces.filter(some))

    read = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    found = read.mapInArrow(lambda b: lean(run(b)), "lang string, piece string, times long")
    return found.groupBy("lang", "piece").agg(F.sum("times").alias("times"))


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the words, the row of each)."""
    lists = pc.split_pattern(texts, " ")
    return lists.values.dictionary_encode(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))


def _hashes(names: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names.to_pylist()), np.uint64, len(names))


def _spots(lang: np.ndarray, words: list[np.ndarray], bits: int) -> np.ndarray:
    """Places in a table of so many bits of phrases given by the hashes of their language and words."""
    h = lang.copy()
    for w in words:
        h = (h ^ w) * _MIX
        h ^= h >> np.uint64(29)
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def phrases(pieces: DataFrame, k: int, frequent: np.ndarray | None) -> DataFrame:
    """(lang, phrase, times) of the phrases of k words, added up within batches; ``frequent``: bits of those of k - 1 words."""
    shared = pieces.sparkSession.sparkContext.broadcast(frequent)
    bits = 0 if frequent is None else 6 + len(frequent).bit_length() - 1

    def count(lang: pa.Array, piece: pa.Array, times: np.ndarray) -> pa.RecordBatch:
        coded, row = _words(piece)
        langs = lang.dictionary_encode()
        code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        at = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1]) if len(row) >= k else np.zeros(0, np.int64)
        if shared.value is not None and len(at):
            word, tongue = _hashes(coded.dictionary), _hashes(langs.dictionary)[langs.indices.to_numpy()]
            for part in (0, 1):
                spot = _spots(tongue[row[at]], [word[code[at + part + j]] for j in range(k - 1)], bits)
                at = at[(shared.value[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1]
        keys, group = np.unique(langs.indices.to_numpy()[row[at]] * size + code[at], return_inverse=True)
        heads = [keys // size, keys % size]
        for j in range(1, k):
            keys, group = np.unique(group * size + code[at + j], return_inverse=True)
            heads = [x[keys // size] for x in heads] + [keys % size]
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, group, times[row[at]])
        names = [coded.dictionary.take(pa.array(x)) for x in heads[1:]]
        phrase = pc.binary_join_element_wise(*names, " ") if k > 1 else names[0]
        return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(heads[0])), phrase, pa.array(total)], ["lang", "phrase", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for lo, hi in row_chunks(b["piece"]):
                held.append(b.slice(lo, hi - lo))
                size += held[-1].nbytes
                if size >= TOGETHER:
                    yield count(*joined(held))
                    held, size = [], 0
        if held:
            yield count(*joined(held))

    def joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array, np.ndarray]:
        t = pa.Table.from_batches(held)
        return t["lang"].combine_chunks(), t["piece"].combine_chunks(), t["times"].to_numpy()

    return pieces.mapInArrow(lambda b: lean(run(b)), "lang string, phrase string, times long")


def bucket_counts(found: DataFrame, least: int, buckets: int, totals: bool) -> DataFrame:
    """(lang, phrase, times) with at least so many, each hash bucket summed by duckdb; with ``totals`` also rows of null phrase, the sum of a language's bucket."""
    shared = urlparse(prepare(found.sparkSession))
    folder = shared.path if shared.scheme in ("", "file") else ""  # other stores are no place to spill to: a bucket has to fit into memory there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        spill = os.path.join(folder, "newsloom", f"spill-{uuid.uuid4().hex}") if folder else ""
        settings = {"threads": 1, "preserve_insertion_order": False, "temp_directory": spill}
        con = duckdb.connect(config=settings | ({"memory_limit": BUCKET_MEMORY} if folder else {}))
        try:
            con.execute("CREATE TABLE sums (lang VARCHAR, phrase VARCHAR, times BIGINT)")
            for b in batches:
                con.register("batch", pa.Table.from_batches([b]))
                con.execute("INSERT INTO sums SELECT * FROM batch")
                con.unregister("batch")
            sql = f"SELECT lang, phrase, CAST(sum(times) AS BIGINT) AS times FROM sums GROUP BY lang, phrase HAVING sum(times) >= {least}"
            if totals:
                sql += " UNION ALL SELECT lang, NULL, CAST(sum(times) AS BIGINT) FROM sums GROUP BY lang"
            found = con.sql(sql)
            yield from found.to_arrow_reader(100_000) if hasattr(found, "to_arrow_reader") else found.fetch_arrow_reader(100_000)
        finally:
            con.close()
            if spill:
                shutil.rmtree(spill, ignore_errors=True)

    dealt = found.repartition(buckets, F.xxhash64("lang", "phrase"))
    return dealt.mapInArrow(lambda b: lean(run(b)), "lang string, phrase string, times long")


def bit_table(frequent: DataFrame) -> np.ndarray:
    """The bits of all frequent phrases as 64-bit integers: a table of fixed size, whatever their number."""
    bits = BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pc.split_pattern(b["phrase"], " ")
            names = lists.values.dictionary_encode()
            k = len(lists.values) // len(b) if len(b) else 1
            word, langs = _hashes(names.dictionary)[names.indices.to_numpy()].reshape(-1, k), b["lang"].dictionary_encode()
            spot = _spots(_hashes(langs.dictionary)[langs.indices.to_numpy()], [word[:, j] for j in range(k)], bits)
            yield pa.RecordBatch.from_arrays([pa.array(spot)], ["spot"])

    spots = frequent.select("lang", "phrase").mapInArrow(run, "spot long")
    rows = spots.groupBy(F.shiftright("spot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``most`` phrases of each language.

    Null and empty texts have no words, a null language is ``und``; rows that repeat count each time. Equal scores and counts are
    ranked by the phrase's bytes. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = written(distinct_pieces(docs), "pieces")
    size = pieces.agg(F.sum(F.octet_length("piece")).alias("n")).first().n or 0
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))
    levels, table = [], None
    for k in range(1, longest + 1):
        levels.append(written(bucket_counts(phrases(pieces, k, table), least, buckets, k == 1), f"phrases-{k}"))
        if k < longest:
            table = bit_table(levels[-1].where("phrase is not null"))
    discard(pieces)
    counts = levels[0].where("phrase is not null").withColumn("k", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        counts = counts.unionAll(level.withColumn("k", F.lit(k)))
    totals = levels[0].where("phrase is null").groupBy("lang").agg(F.sum("times").alias("n"))
    scored = written(_scored(counts), "scored")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _scored(counts: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut, without those that a longer one mostly covers."""
    candidates = counts.where("k > 1").withColumnRenamed("times", "a")
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', cut)")).withColumn("tail", F.expr("substr(phrase, char_length(head) + 2)"))
    requests = cuts.select("lang", "phrase", "a", "cut", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("head").alias("part")), F.struct(F.lit(False).alias("first"), F.col("tail").alias("part")))).alias("ask"))
    requests = requests.select("lang", "phrase", "a", "cut", F.col("ask.first").alias("first"), F.col("ask.part").alias("part"))
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "times"), ["lang", "part"])
    both = answers.groupBy("lang", "phrase", "a", "cut").agg(F.max(F.when(F.col("first"), F.col("times"))).alias("l"), F.max(F.when(~F.col("first"), F.col("times"))).alias("r"))
    both = both.withColumn("score", F.expr(f"cast(cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + r) as bigint)"))
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    inside = candidates.where("k > 2").select("lang", F.col("a").alias("longer"), F.split("phrase", " ").alias("w"), "k")
    inside = inside.select("lang", "longer", "w", "k", F.explode(F.expr("sequence(2, k - 1)")).alias("size"))
    inside = inside.select("lang", "longer", F.explode(F.expr("transform(sequence(1, k - size + 1), i -> array_join(slice(w, i, size), ' '))")).alias("phrase"))
    covers = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(covers, ["lang", "phrase"], "left").where(f"longer is null or {COVERED[0]} * cast(longer as decimal(20,0)) < {COVERED[1]} * cast(a as decimal(20,0))")
    return kept.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"))
