"""Near-duplicate texts by the similarity of their word shingles: wide SimHash, pigeonhole groups, exact check.

Two shingle sets of Jaccard similarity s differ in a bit of their SimHash with a chance of
acos(2s / (1 + s)) / pi at most, which is 0.15 for s = 0.8, or ten bits of 64. At such a radius no
division of 64 bits is selective, so a fingerprint has several words of 64 bits here. Each word's bits
are put into groups that go together over the corpus, and dynamic programming gives each group a
threshold, or leaves it out, so that a pair of similarity s is within the threshold of one group at
least with a chance of ``RECALL``, at the least estimated cost of candidates and probe rows. Pairs that meet are
compared on two words, on the whole fingerprint, and then on their whole sets, so no link is below the similarity; pairs above it
are missed with a chance of at most 1 - RECALL, less the more alike they are.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import discard, lean, row_chunks, written
from newsloom.llm.components import connected_components
from newsloom.llm.simhash import close_share, group_bits

#: Words of a shingle, the least similarity as a fraction, the chance to meet at that similarity.
SHINGLE, NUM, DEN, RECALL = 5, 4, 5, 0.92
#: Chance that two sets of that similarity differ in a bit.
DIFFER = math.acos(2 * NUM / (NUM + DEN)) / math.pi


def reach(bits: int, deviations: float) -> int:
    """Bits in which a pair of the least similarity differs, so many standard deviations above the mean."""
    return round(bits * DIFFER + deviations * math.sqrt(bits * DIFFER * (1 - DIFFER)))


#: Bits of two words in which a pair may differ to be compared on the whole fingerprint; standard deviations that this allows.
NEAR, WIDE = reach(128, 3.3), 2.33
#: Sets under one key beyond which they meet one of them first, not each other; the same in multiples of what chance brings together.
HOT_KEY, HOT_TIMES = 32, 4
#: Unlike sets that one key may bring together, most words of a fingerprint, groups of bits by which sets meet one of their key in the first round.
CHANCE_MET, MOST_WORDS, FIRST_GROUPS = 256, 48, 6
#: Relative costs of a pair and of a posting; most bits of a group that a probe flips.
PAIR_COST, ROW_COST, MOST_FLIPS = 0.08, 20.0, 2
#: Rows of (id, hash) that are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of a shingle's hash that are kept to compare sets.
KEPT_BYTES = 5
#: Steps into which the logarithm of the chance to miss is divided.
STEPS = 600
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LANES = np.uint64(0x0101010101010101)
SET = "doc_id long, text_key long, node long, n int, f binary, ids binary"
POSTING = "key long, node long, c long, a long, b long, n int"
Group = tuple[int, list[int], int]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def salt(k: int) -> np.uint64:
    return np.uint64(int(GOLDEN) * k & (1 << 64) - 1)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct word shingles; a shorter text is one shingle, no words give none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    pieces = lists.values.dictionary_encode()
    names = pieces.dictionary.to_pylist()
    own = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))
    at = pieces.indices.to_numpy()
    word = np.array([x != "" for x in names], bool)[at]
    ends = np.concatenate([[0], np.cumsum(word)])[lists.offsets.to_numpy()]
    w = own[at[word]]
    run = w.copy()
    for j in range(1, size):
        run[: max(0, len(w) - j)] = run[: max(0, len(w) - j)] * GOLDEN + w[j:]
    run = mixed(run)
    out = []
    for a, b in itertools.pairwise(ends.tolist()):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh64_intdigest(w[a:b].tobytes())], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def wide_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """[sets, words]: the SimHash of each set; bits are counted eight at a time in the bytes of a word."""
    out = np.zeros((len(sets), words), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    sizes = np.array([len(sets[i]) for i in full], np.int64)
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(np.cumsum(sizes[a:]), 1 << 16, side="right")) + a)
        part, n = np.concatenate([sets[i] for i in full[a:b]]), sizes[a:b]
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        runs = -(-n // 255)  # a byte counts to 255
        first = np.concatenate([[0], np.cumsum(runs)[:-1]])
        cuts = np.repeat(begin, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
        for j in range(words):
            x = mixed(part + salt(j + 1))
            bits = np.empty((b - a, 8, 8), bool)
            for k in range(8):
                seg = np.add.reduceat((x >> np.uint64(k)) & LANES, cuts)
                ones = np.add.reduceat(seg.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
                bits[:, :, k] = 2 * ones > n[:, None]
            out[full[a:b], j] = np.packbits(bits.reshape(b - a, 64), axis=1, bitorder="little").view("<u8").ravel()
        a = b
    return out


def packed(ids: np.ndarray) -> bytes:
    """The upper bytes of sorted hashes, the first of all, then the second of all, and so on: sorted bytes compress."""
    return np.ascontiguousarray(ids.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    full = np.zeros((len(data) // KEPT_BYTES, 8), np.uint8)
    full[:, :KEPT_BYTES] = np.frombuffer(data, np.uint8).reshape(KEPT_BYTES, -1).T
    return full.view(">u8").ravel().astype(np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], size: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in row_chunks(batch.column(2)):
            part = batch.slice(a, b - a)
            sets = shingle_sets(part.column(2), size)
            nodes = np.frombuffer(b"".join(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=8).digest() for s in sets), "<i8")
            data = [packed(s) for s in sets]
            prints = [f.astype("<u8").tobytes() for f in wide_fingerprints(sets, words)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints, pa.binary()), pa.array(data, pa.binary())], ["doc_id", "text_key", "node", "n", "f", "ids"])


def shape(n: int, recall: float = RECALL) -> tuple[int, int]:
    """(words, groups a word) for that many texts: groups wide enough to tell unlike texts apart, and enough of them.

    Sixteen bits a group serve sixteen million texts, so up to there a text has the same number of postings.
    """
    for groups in (4, 3, 2, 1):
        k = 64 / groups
        if n * 2.0**-k <= CHANCE_MET:
            break
    found, meet = [], 0.0
    for t in range(MOST_FLIPS + 1):  # of k bits, t differ
        meet += math.prod((k - i) / (i + 1) for i in range(t)) * DIFFER**t * (1 - DIFFER) ** (k - t)
        words = -(-math.ceil(math.log(1 - recall) / math.log1p(-meet)) // groups)
        found.append((words > MOST_WORDS, t, words))
    return min(min(found)[2], MOST_WORDS), groups


def _moments(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    n, both = 0, np.zeros((words, 64, 64))
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            f = np.frombuffer(b"".join(batch.column(0).slice(a, 4096).to_pylist()), np.uint8).reshape(-1, words, 8)
            bits = np.unpackbits(f, axis=2, bitorder="little").astype(np.float32)
            n += len(f)
            for j in range(words):
                both[j] += bits[:, j].T @ bits[:, j]
    at = np.arange(words * 4096 + 1, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(both.ravel(), n).astype(np.int64))], ["at", "n"])


def bit_statistics(nodes: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """(fingerprints, how often each two bits of a word are set together) over the whole table: 4,096 numbers a word."""
    got = nodes.select("f").coalesce(512).mapInArrow(lambda it: _moments(it, words), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(words * 4096 + 1)
    flat[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return int(flat[-1]), flat[:-1].reshape(words, 64, 64)


def allocate(n: int, both: np.ndarray, groups: int, recall: float = RECALL, most: int = MOST_FLIPS) -> list[Group]:
    """(word, bits, threshold) of the groups to probe: the chance to miss is small enough at the least cost."""
    step = -math.log(1 - recall) / STEPS
    best: dict[int, tuple[float, list[Group]]] = {0: (0.0, [])}
    for j, word in enumerate(both):
        p = np.diag(word) / max(n, 1)
        for bits in group_bits(n, word, groups):
            share, meet = close_share(2 * p[bits] * (1 - p[bits]), most), close_share(np.full(len(bits), DIFFER), most)
            then = dict(best)
            for t in range(most + 1):
                rows = sum(math.comb(len(bits), k) for k in range(t + 1))
                cost = n * n / 2 * share[t] * PAIR_COST + ROW_COST * n * rows
                gain = int(-math.log1p(-min(meet[t], 1 - 1e-12)) / step)
                for done, (spent, chosen) in best.items():
                    now = min(STEPS, done + gain)
                    if now > done and (now not in then or spent + cost < then[now][0]):
                        then[now] = (spent + cost, [*chosen, (j, bits, t)])
            best = then
    return best[max(best)][1]


def _postings(batches: Iterator[pa.RecordBatch], words: int, plan: list[Group]) -> Iterator[pa.RecordBatch]:
    """A row for each set and group (its own key), and where a group has a threshold for each flip of it (a probe)."""
    flips = any(t for _, _, t in plan)
    names = [c.split()[0] for c in POSTING.split(", ")] + ["probe"] * flips
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            f = np.frombuffer(b"".join(part.column(3).to_pylist()), "<u8").reshape(-1, words)
            keys, probe = [], []
            for g, (j, bits, t) in enumerate(plan):
                own = f[:, j] & np.uint64(sum(1 << b for b in bits))
                for k in range(t + 1):
                    for flip in itertools.combinations(bits, k):
                        keys.append(mixed((own ^ np.uint64(sum(1 << b for b in flip))) + salt(g + 1)))
                        probe.append(min(k, 1))
            rows = pa.array(np.tile(np.arange(len(f)), len(keys)))
            cols = [part.column(0), part.column(1), pa.array(f[:, 0].astype(np.int64)), pa.array(f[:, -1].astype(np.int64)), part.column(2)]
            cols = [pa.array(np.concatenate(keys).view(np.int64)), *(c.take(rows) for c in cols)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(np.repeat(np.array(probe, np.int32), len(f)))] * flips, names)


def _posted(nodes: DataFrame, words: int, plan: list[Group], name: str) -> DataFrame:
    """Postings of sets (node, c, n, f) as a written table."""
    schema = POSTING + (", probe int" if any(t for _, _, t in plan) else "")
    return written(nodes.select("node", "c", "n", "f").mapInArrow(lambda it: lean(_postings(it, words, plan)), schema), name)


def _close(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with their fingerprints those that differ in few enough bits, and in how many."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
        d = np.bitwise_count(a ^ b).sum(1, dtype=np.int32)
        keep = pa.array(np.flatnonzero(d <= most))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(d).take(keep)], ["u", "v", "d"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DEN >= NUM * (len(a) + len(b) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [similar(unpacked(a), unpacked(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        keep = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["u", "v"])


def _checked(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (u, v) those whose sets are similar enough, as a written table."""
    need = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = written(known.select("node", "ids").join(need, "node", "left_semi").dropDuplicates(["node"]), "candidate-sets")
    a, b = (sets.select(F.col("node").alias(c), F.col("ids").alias(f"ids_{c}")) for c in "uv")
    out = written(pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "ids_u", "ids_v").mapInArrow(_verified, "u long, v long"), "similar-pairs")
    discard(sets)
    return out


def _worded(batches: Iterator[pa.RecordBatch], words: int, plan: list[Group]) -> Iterator[pa.RecordBatch]:
    """Postings with their whole fingerprint as an array of words and the number of their group (of a probe none)."""
    for batch in batches:
        own, key = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u8").reshape(-1, words), batch.column(0).to_numpy().view(np.uint64)
        g = np.full(batch.num_rows, -1, np.int32)
        for i, (j, bits, _) in enumerate(plan):
            g[mixed((own[:, j] & np.uint64(sum(1 << b for b in bits))) + salt(i + 1)) == key] = i
        w = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * words), pa.array(own.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:6], w, pa.array(g), *batch.columns[7:]], [*batch.schema.names[:6], "w", "g", *batch.schema.names[7:]])


def _near(a: DataFrame, b: DataFrame, more: Column | None = None, words: int = 0, plan: list[Group] = ()) -> DataFrame:
    """(u, v): pairs under one key, of different components, that differ in few enough bits and are of like sizes.

    a: key, x, and xc, xa, xb, xn; b: key, y, and yc, ya, yb, yn. With words also xw and yw: then whole
    fingerprints are compared, so only pairs whose sets are to be compared come out; with a plan also xg and yg: each pair then
    comes out by the first group that it shares.
    """
    d = F.bit_count(F.col("xa").bitwiseXOR(F.col("ya"))) + F.bit_count(F.col("xb").bitwiseXOR(F.col("yb")))
    fits = F.least("xn", "yn") * DEN >= F.greatest("xn", "yn") * NUM
    met = a.join(b, "key").where((F.col("x") != F.col("y")) & (F.col("xc") != F.col("yc")) & fits & (d <= NEAR))
    met = met if more is None else met.where(more)
    if words:
        apart = [F.get("xw", F.lit(i)).bitwiseXOR(F.get("yw", F.lit(i))) for i in range(words)]
        met = met.where(sum((F.bit_count(x) for x in apart), F.lit(0)) <= reach(64 * words, WIDE))
    if plan:
        shared = F.lit(False)
        for i, (j, bits, _) in enumerate(plan):
            mask = sum(1 << x for x in bits)
            shared = shared | ((F.greatest("xg", "yg") > i) & (apart[j].bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")) == 0))
        met = met.where(~shared)
    return met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))


def _side(rows: DataFrame, c: str, *more: str) -> DataFrame:
    return rows.select("key", F.col("node").alias(c), *(F.col(m).alias(f"{c}{m}") for m in ("c", "a", "b", "n", *more)))


def _middles(rows: DataFrame) -> DataFrame:
    """Of each key the set nearest to the majority of the bits of its sets: the text that the others are edits of, if it is there."""
    bit = lambda i: F.shiftright(F.col("a"), i).bitwiseAND(F.lit(1).cast("long"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), *(F.sum(bit(i)).alias(f"b{i}") for i in range(64)))
    core = F.lit(0).cast("long")
    for i in range(64):
        core = core.bitwiseOR(F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    core = written(counts.select("key", core.alias("core")), "majorities")
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("core")))
    return rows.join(core, "key").groupBy("key").agg(F.min_by(F.struct("node", "c", "a", "b", "n", "w", "g"), F.struct(far, "node")).alias("m")).select("key", "m.*")


def _placed(rows: DataFrame, parts: DataFrame, *cols: str) -> DataFrame:
    """rows with the component c<col> of each of those columns; a set without links is its own."""
    for col in cols:
        own = parts.select(F.col("node").alias("__node"), F.col("component").alias("__c"))
        rows = rows.join(own, rows[col] == own["__node"], "left").withColumn(f"c{col}", F.coalesce("__c", col)).drop("__node", "__c")
    return rows


def _linked(known: DataFrame, nodes: DataFrame, links: DataFrame | None, pairs: DataFrame, most: int, whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(links and of the pairs enough similar ones that the components are those of all similar pairs, the components).

    Only pairs whose whole fingerprints differ in at most ``most`` bits are compared: each set with its nearest
    first, and of the other pairs those across components, unless the whole is left to a later round.
    """
    f = lambda c: nodes.select(F.col("node").alias(c), F.col("f").alias(f"f{c}"))
    met = pairs.distinct().join(f("u"), "u").join(f("v"), "v").select("u", "v", "fu", "fv")
    pairs = written(met.mapInArrow(lambda it: _close(it, most), "u long, v long, d int"), "candidates")
    ends = pairs.select(F.col("u").alias("x"), F.col("v").alias("y"), "d").unionAll(pairs.select("v", "u", "d"))
    nearest = ends.groupBy("x").agg(F.min(F.struct("d", "y")).alias("m")).select(F.least("x", "m.y").alias("u"), F.greatest("x", "m.y").alias("v"))
    first = written(nearest.distinct(), "nearest")
    links = _checked(known, first) if links is None else links.unionAll(_checked(known, first))
    parts = connected_components(links)
    if not whole:
        discard(pairs, first)
        return links, parts
    rest = written(_placed(pairs.join(first, ["u", "v"], "left_anti"), parts, "u", "v").where("cu <> cv").select("u", "v"), "across")
    if not rest.isEmpty():
        links = links.unionAll(_checked(known, rest))
        parts = connected_components(links)
    discard(pairs, first, rest)
    return links, parts


def similar_components(known: DataFrame, words: int, groups: int, hot_key: int | None = None, recall: float = RECALL) -> DataFrame:
    """(node, component) of every set that is linked: the components of all pairs that meet and are similar enough.

    In the first round sets meet only one set of their key, by a few groups of bits: that links most of a large group
    at a row a set. After it only sets of different components meet: all of a key with each other; under a hot key with the
    one in their middle. Of these keys, sets outside the key's largest component then go on, round by round with the
    one in the middle of those, as long as that saves work and links more of them, then with all sets of other components.
    """
    nodes = written(known.select("node", "n", "f").dropDuplicates(["node"]), "sets")
    n, both = bit_statistics(nodes, words)
    plan = allocate(n, both, groups, recall)
    narrow = min((len(bits) for _, bits, _ in plan), default=64)
    hot_key = max(HOT_KEY, math.ceil(HOT_TIMES * n * 2.0**-narrow)) if hot_key is None else hot_key
    flips = any(t for _, _, t in plan)
    own = lambda rows: rows.where("probe = 0") if flips else rows
    most = reach(64 * words, WIDE)

    few = [(j, bits, 0) for j, bits, _ in plan[:: max(1, len(plan) // FIRST_GROUPS)]]
    first = _posted(nodes.withColumn("c", F.col("node")), words, few, "first-postings")
    hub = first.groupBy("key").agg(F.min_by(F.struct("node", "c", "a", "b", "n"), F.xxhash64("node", "key")).alias("m"), F.count("*").alias("times")).where("times > 1")
    hub = written(hub.select("key", "m.*"), "hubs")
    links, parts = _linked(known, nodes, None, _near(_side(first, "x"), _side(hub, "y")), most, whole=False)
    discard(first, hub)

    posts = _posted(_placed(nodes, parts, "node").withColumnRenamed("cnode", "c"), words, plan, "postings")
    many = written(posts.groupBy("key").count().where(F.col("count") > hot_key).select("key"), "hot-keys")
    if many.isEmpty():
        calm, hot = posts, None
    else:
        calm, hot = posts.join(many, "key", "left_anti"), posts.join(many, "key", "left_semi").join(nodes.select("node", "f"), "node")
        hot = hot.select("key", "node", "c", "a", "b", "n", "f", *(["probe"] if flips else []))
        schema = POSTING + ", w array<long>, g int" + (", probe int" if flips else "")
        hot = written(hot.mapInArrow(lambda it: _worded(it, words, plan), schema), "hot-postings")
    once = (F.col("x") < F.col("y")) if not flips else (F.col("xprobe") == 1) | (F.col("x") < F.col("y"))
    pairs = _near(_side(calm, "x", *(["probe"] if flips else [])), _side(own(calm), "y"), once)
    if hot is not None:
        pairs = pairs.unionAll(_near(_side(_middles(own(hot)), "x", "w", "g"), _side(hot, "y", "w", "g"), None, words))
    links, parts = _linked(known, nodes, links, pairs, most)
    before = math.inf
    while hot is not None:
        placed = written(_placed(hot.drop("c"), parts, "node").withColumnRenamed("cnode", "c"), "placed")
        sizes = placed.groupBy("key", "c").count()
        main = written(sizes.groupBy("key").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.sum("count").alias("size")), "main-components")
        rest = written(own(placed).join(main, "key").where("c <> main").drop("main"), "outside")
        left = rest.agg(F.count("*").alias("n"), F.sum("size").alias("work")).first()
        if not left["n"]:
            break
        last = left["work"] <= 1000 * left["n"] or left["n"] > 0.9 * before
        all_ = _side(placed.join(main.select("key", "main"), "key"), "y", "w", "g", "main")
        if last:  # two outsiders meet once
            pairs = _near(_side(rest, "x", "w", "g"), all_, (F.col("yc") == F.col("ymain")) | (F.col("x") < F.col("y")), words, plan)
        else:
            pairs = _near(_side(_middles(rest.drop("size")), "x", "w", "g"), all_, None, words)
        links, parts = _linked(known, nodes, links, pairs, most)
        discard(placed, rest, main)
        before = left["n"]
        if last:
            break
    discard(posts, nodes)
    return parts


def keep_one(docs: DataFrame, shingle: int = SHINGLE, hot_key: int | None = None, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near-duplicate texts one document, with all columns of docs.

    Texts are linked if at least four fifths of their shingles (A-Z in lower case, words between ASCII white space) are
    shared; a group is what links reach. The document of the smallest id stays, a null id counting as the
    largest, then that of the smaller hash of its text; of rows that repeat its id and text one stays, whichever. Null,
    empty and blank texts have no shingles and are copies of each other; a text of fewer words is one shingle. An empty
    table stays empty. Sets are told apart by 64-bit hashes.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("text_key"), F.col(text_col).alias("text"))
    words, groups = shape(docs.count(), recall)
    known = written(rows.mapInArrow(lambda it: lean(_sets(it, shingle, words)), SET), "shingle-sets")
    places = known.select("doc_id", "text_key", "node")
    parts = similar_components(known, words, groups, hot_key, recall)
    named = places.join(parts, "node", "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("component"))
    named = written(named.groupBy("doc_id", "text_key", "component").agg(F.count("*").alias("rows")), "groups")
    discard(known)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = written(named.groupBy("component").agg(F.min(place).alias("least")), "components")  # a table, so that AQE can split a large component
    drop = named.join(least, "component").where(place != F.col("least")).select(F.col("doc_id").alias("__near_id"), F.col("text_key").alias("__near_key"))
    same = lambda x: docs[id_col].cast("long").eqNullSafe(x["__near_id"]) & (key == x["__near_key"])
    drop = written(drop, "dropped")
    out = docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, same(drop), "left_anti")
    twice = written(named.where("rows > 1").select(F.col("doc_id").alias("__near_id"), F.col("text_key").alias("__near_key")), "repeated")
    if twice.isEmpty():
        return out
    again = out.withColumn("__near_text", key).join(twice, same(twice), "left_semi").dropDuplicates([id_col, "__near_text"]).drop("__near_text")
    return out.join(twice, same(twice), "left_anti").unionByName(again)
