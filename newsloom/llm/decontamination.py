"""Benchmark decontamination by word windows (DataFrame functions only).

A window is ``width`` consecutive words of a benchmark item; an item of fewer words is one window.
Scanning all windows of all documents would hash every word ``width`` times, so documents are
first probed with shorter grams at every few words only: any occurrence of a window of L words
covers a gram of g words that starts at a multiple of L - g + 1. The grams of the benchmark are
the broadcast hash set. Documents with a probe hit are then compared window by window, on the
words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import written
from newsloom.llm.line_dedup import without

WIDTH = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of the benchmark's window table (words, item ids, some for each array and entry) up to which it is broadcast; beyond, the joins shuffle.
BROADCAST_BYTES = 96 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text: runs of digits, letters and characters beyond ASCII; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def gram_plan(length: int) -> tuple[int, int]:
    """(words in a probe gram, stride of the probes) for windows of that length."""
    gram = (length + 1) // 2
    return gram, length - gram + 1


def _slices(words: Column, length: int, stride: int = 1) -> Column:
    """All runs of ``length`` words at multiples of stride."""
    last = F.size(words) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.slice(words, i + 1, length).alias("w")))


def _grams(words: Column, length: int, dense: bool) -> Column:
    gram, stride = gram_plan(length)
    return F.transform(_slices(words, gram, 1 if dense else stride), lambda s: F.xxhash64(F.lit(length), s["w"]))


def windows(benchmark: DataFrame, width: int = WIDTH, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """len, w, items: each distinct window with the ids (as text) of the items that hold it."""
    words = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words"))
    runs = F.when(F.size("words") >= width, _slices(F.col("words"), width)).otherwise(F.array(F.struct(F.lit(0).alias("pos"), F.col("words").alias("w"))))
    one = words.where(F.size("words") > 0).select("item", F.explode(runs).alias("s")).select("item", F.col("s.w").alias("w"))
    return one.groupBy("w").agg(F.collect_set("item").alias("items")).select(F.size("w").alias("len"), "w", "items")


def window_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_words, hits (array of (pos, len)), items (sorted ids) for every row of docs.

    Null or empty texts have no words; documents without a hit have empty arrays. Rows that repeat
    an id with the same text get the same result each; text_key (XXH64 of the text) tells apart
    different texts under one id. A benchmark item without words has no window; an empty
    benchmark hits nothing. Items with a null id count as occurring but have no id to list.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = written(windows(benchmark, width), "windows")
    weigh = lambda c: F.octet_length(F.array_join(c, "")) + 32 * F.size(c)
    sizes = known.groupBy("len").agg(F.sum(weigh("w").cast("long") + weigh("items") + 128).alias("n")).collect()  # at most ``width`` rows
    lengths = sorted(r["len"] for r in sizes)
    small = sum(r["n"] for r in sizes) <= BROADCAST_BYTES
    hint = F.broadcast if small else (lambda df: df)

    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    split = base.withColumn("words", words_of(F.col("text")))
    empty = F.array().cast("array<bigint>")
    probes = F.concat(*[_grams(F.col("words"), n, False) for n in lengths]) if lengths else empty
    scanned = written(split.select("doc_id", "text_key", F.size("words").alias("n_words"), probes.alias("probes")), "probes")
    if not lengths:
        none = F.array().cast("array<struct<pos:int,len:int>>")
        return scanned.select("doc_id", "text_key", "n_words", none.alias("hits"), F.array().cast("array<string>").alias("items"))

    grams = None
    for n in lengths:
        part = known.where(F.col("len") == n).select(F.explode(_grams(F.col("w"), n, True)).alias("probe"))
        grams = part if grams is None else grams.unionAll(part)
    asked = scanned.select("doc_id", "text_key", F.explode("probes").alias("probe"))
    found = written(asked.join(hint(grams.distinct()), "probe", "left_semi").select("doc_id", "text_key").distinct(), "candidates")

    same = lambda a, b: (a["doc_id"].eqNullSafe(b["doc_id"])) & (a["text_key"] == b["text_key"])
    near = base.join(found, same(base, found), "left_semi").dropDuplicates(["doc_id", "text_key"]).withColumn("words", words_of(F.col("text"))).drop("text")
    near = written(near, "candidate-words")
    hits = None
    for n in lengths:
        runs = near.select("doc_id", "text_key", F.explode(_slices(F.col("words"), n)).alias("s")).select("doc_id", "text_key", F.col("s.pos").alias("pos"), F.col("s.w").alias("w"))
        part = runs.join(hint(known.where(F.col("len") == n)), "w").select("doc_id", "text_key", F.struct("pos", F.col("len")).alias("hit"), "items")
        hits = part if hits is None else hits.unionAll(part)
    by_doc = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    left = scanned.select("doc_id", "text_key", "n_words")
    out = left.join(by_doc, same(left, by_doc), "left")
    return out.select(
        left["doc_id"],
        left["text_key"],
        "n_words",
        F.coalesce("hits", F.array().cast("array<struct<pos:int,len:int>>")).alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def covered(hits: Column) -> Column:
    """Words in the union of sorted hits."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, h: F.struct(
        F.greatest(a["end"], h["pos"] + h["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), h["pos"] + h["len"] - F.greatest(a["end"], h["pos"]))).alias("n"),
    )
    return F.aggregate(hits, zero, step, lambda a: a["n"]).cast("long")


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, **cols: str) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    Contaminated: at least one word in ``share`` lies inside an occurrence of a window.
    """
    hit = window_hits(docs, benchmark, width, **cols)
    return hit.select(
        "doc_id",
        "text_key",
        F.col("n_words").cast("long").alias("n_words"),
        covered(F.col("hits")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", width: int = WIDTH, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated documents, or with the hit words cut out of every text.

    ``action="documents"`` drops the rows that `report` marks; ``action="spans"`` keeps every row and
    drops each hit word with the separators after it. Columns stay as they are. Null and empty texts
    are never contaminated and stay; rows that repeat an id with the same text share its fate, null ids are ids
    like any other; an empty table stays empty, and an empty benchmark changes nothing.
    """
    key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    if action == "documents":
        bad = report(docs, benchmark, width, share, id_col=id_col, text_col=text_col).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
        return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]) & (key == bad["__key"]), "left_anti")
    if action != "spans":
        raise ValueError(f"unknown action {action!r}")
    hit = window_hits(docs, benchmark, width, id_col, text_col).where(F.size("hits") > 0)
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("hits").alias("__hits")).dropDuplicates(["__id", "__key"])
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lead = F.regexp_extract(docs[text_col], r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    pieces = F.regexp_extract_all(docs[text_col], F.lit(word + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    spans = hit["__hits"]
    words = F.array_distinct(F.flatten(F.transform(spans, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))
    cut = F.when(spans.isNull(), docs[text_col]).otherwise(F.concat(lead, without(pieces, words, "")))
    joined = docs.join(hit, docs[id_col].eqNullSafe(hit["__id"]) & (key == hit["__key"]), "left")
    return joined.select(*[cut.alias(c) if c == text_col else docs[c] for c in docs.columns])
