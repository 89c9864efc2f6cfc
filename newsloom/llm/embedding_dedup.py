"""Near-duplicate vectors by cosine, with a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. A fixed random rotation spreads the
differences over all coordinates, which are then split into blocks. With a budget for each block in
proportion to its size, a pair within the whole distance is within budget in one block at least.
Each block is range-joined alone: vectors are cut into slabs of the block's first coordinate, as
wide as its radius, and a slab meets itself and the next. A pair belongs to the first block that
finds it and is verified there in double precision, so it is counted once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.base import discard, written
from newsloom.llm.components import connected_components, forest

COSINE, BLOCK_DIMS = 0.9, 16
#: Vectors on one side of a tile, and the side of the squares that are compared at once.
TILE, SQUARE = 32_768, 2048
SEED = 20_240_229
SLACK = 1e-9
TILED = "dim int, block int, slab int, kind int, i int, j int, role int, node long, mult long, embedding"
FOUND = "u long, v long, n long"


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, block_dims: int = BLOCK_DIMS) -> list[slice]:
    parts = max(1, round(dim / block_dims))
    cuts = [dim * k // parts for k in range(parts + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def budgets(dim: int, cosine: float, block_dims: int = BLOCK_DIMS) -> np.ndarray:
    """Squared distance that each block may take: in proportion to its dimensions."""
    return np.array([(2 - 2 * cosine) * (b.stop - b.start) / dim * (1 + SLACK) + SLACK for b in blocks(dim, block_dims)])


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors in the rotated frame."""
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])  # by powers of two, so that no square overflows and no digit is lost


def _slabs(x: np.ndarray, cosine: float, block_dims: int) -> np.ndarray:
    """[vectors, blocks]: the slab of each vector in each block."""
    y, width = rotated(x), np.sqrt(budgets(x.shape[1], cosine, block_dims)) * (1 + 1e-6)
    first = np.array([b.start for b in blocks(x.shape[1], block_dims)])
    return np.floor(y[:, first] / width).astype(np.int64)


def _by_dim(batch: pa.RecordBatch):
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def _slab_counts(batches, cosine: float, block_dims: int):
    for batch in batches:
        for dim, part in _by_dim(batch):
            s = _slabs(_matrix(part.column("embedding"), dim), cosine, block_dims)
            for b in range(s.shape[1]):
                slab, n = np.unique(s[:, b], return_counts=True)
                k = len(slab)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * k, pa.int32()), pa.array([b] * k, pa.int32()), pa.array(slab, pa.int32()), pa.array(n, pa.int64())], ["dim", "block", "slab", "n"])


def _tiles(batches, counts: dict[tuple[int, int, int], int], cosine: float, block_dims: int, tile: int):
    """Each vector to the tiles where it is compared: kind 0 within a slab, kind 1 with the next one."""
    names = [c.split()[0] for c in TILED.split(", ")]
    chunks = lambda *key: math.ceil(counts.get(key, 0) / tile)
    for batch in batches:
        for dim, part in _by_dim(batch):
            slabs = _slabs(_matrix(part.column("embedding"), dim), cosine, block_dims)
            node = part.column("node").to_numpy()
            for b in range(slabs.shape[1]):
                to: list[tuple[int, int, int, int, int, np.ndarray]] = []
                for s in np.unique(slabs[:, b]).tolist():
                    own = np.flatnonzero(slabs[:, b] == s)
                    n, up, down = chunks(dim, b, s), chunks(dim, b, s + 1), chunks(dim, b, s - 1)
                    for i in range(n):
                        rows = own[node[own] % n == i]
                        to += [(s, 0, i, j, 0, rows) for j in range(i, n)] + [(s, 0, j, i, 1, rows) for j in range(i)]
                        to += [(s, 1, i, j, 0, rows) for j in range(up)] + [(s - 1, 1, j, i, 1, rows) for j in range(down)]
                at = np.concatenate([x[5] for x in to])
                tag = np.repeat(np.array([x[:5] for x in to], np.int32), [len(x[5]) for x in to], axis=0)
                for k in range(0, len(at), 20_000):
                    cut = slice(k, k + 20_000)
                    pick = part.take(pa.array(at[cut]))
                    fixed = [pa.array(np.full(pick.num_rows, v, np.int32)) for v in (dim, b)]
                    yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(tag[cut, c]) for c in range(5)), pick.column("node"), pick.column("mult"), pick.column("embedding")], names)


def _linked(x: np.ndarray, y: np.ndarray, block: int, cosine: float, block_dims: int, same: bool):
    """Pairs (rows of x, rows of y) that this block owns and whose cosine is high enough."""
    parts, budget = blocks(x.shape[1], block_dims), budgets(x.shape[1], cosine, block_dims)
    rx, ry = rotated(x), rotated(y)
    fx, fy = (np.ascontiguousarray(r[:, parts[block]], np.float32) for r in (rx, ry))
    hx, hy = ((f * f).sum(1) / 2 for f in (fx, fy))
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    least = np.float32(budget[block] / 2 + 1e-5)
    for i in range(0, len(x), SQUARE):
        for j in range(i if same else 0, len(y), SQUARE):
            near = fx[i : i + SQUARE] @ fy[j : j + SQUARE].T
            near -= hy[j : j + SQUARE]
            p, q = np.nonzero(near >= (hx[i : i + SQUARE] - least)[:, None])
            p, q = p + i, q + j
            if same:
                p, q = p[p < q], q[p < q]
            for k in range(0, len(p), 32_768):
                a, b = p[k : k + 32_768], q[k : k + 32_768]
                d = np.stack([((rx[a, s] - ry[b, s]) ** 2).sum(1) for s in parts[: block + 1]])
                own = (d[block] <= budget[block]) & (d[:block] > budget[:block, None]).all(0)
                a, b = a[own], b[own]
                good = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= cosine
                yield a[good], b[good]


def _joined(key, t: pa.Table, cosine: float, block_dims: int) -> pa.Table:
    dim, block, _, kind, i, j = (k.as_py() for k in key)
    role, node, mult = (t.column(c).to_numpy() for c in ("role", "node", "mult"))
    vectors = _matrix(t.column("embedding"), dim)
    a, b = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    same = kind == 0 and i == j
    if same:
        b = a
    links, us, vs = np.zeros(len(node), np.int64), [], []
    if len(a) and len(b):
        for p, q in _linked(vectors[a], vectors[b], block, cosine, block_dims, same):
            np.add.at(links, a[p], mult[b[q]])
            np.add.at(links, b[q], mult[a[p]])
            us.append(node[a[p]])
            vs.append(node[b[q]])
            if sum(map(len, us)) > 500_000:
                u, v = forest(np.concatenate(us), np.concatenate(vs))
                us, vs = [u], [v]
    u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64),) * 2
    some = np.flatnonzero(links)
    return pa.table({"u": np.concatenate([node[some], u]), "v": pa.array([None] * len(some) + v.tolist(), pa.int64()), "n": pa.array(np.concatenate([links[some], np.zeros(len(u), np.int64)]))})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block_dims: int = BLOCK_DIMS, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    n_links counts the other rows of cosine >= ``cosine``; component_id is the smallest id reachable by
    links, itself included; kept marks the row of that id. Vectors that are null, empty, zero or hold
    a null or non-finite component link with nothing, nor do vectors of different lengths. Equal
    vectors are one node with a multiplicity, so copies cost no pairs. Slabs of more than ``tile``
    vectors are joined in tiles of bounded size. An empty table gives an empty result.
    """
    x = F.col("embedding")
    fine = F.coalesce((F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0), F.lit(False))
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    good = rows.where(fine)
    nodes = good.groupBy("embedding").agg(F.count("*").alias("mult"), F.min("vec_id").alias("least")).select(F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("node"), "mult", "least", "embedding")
    nodes = written(nodes, "vectors")
    counted = nodes.select("dim", "embedding").mapInArrow(lambda it: _slab_counts(it, cosine, block_dims), "dim int, block int, slab int, n long")
    counts = {(r["dim"], r["block"], r["slab"]): r["n"] for r in counted.groupBy("dim", "block", "slab").agg(F.sum("n").alias("n")).collect()}  # some slabs a block
    tiles = nodes.mapInArrow(lambda it: _tiles(it, counts, cosine, block_dims, tile), f"{TILED} {kind}")
    found = written(tiles.groupBy("dim", "block", "slab", "kind", "i", "j").applyInArrow(lambda key, t: _joined(key, t, cosine, block_dims), FOUND), "vector-links")
    parts = connected_components(found.where("v is not null"))
    degree = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    # components are named on one row a vector; both sides of each join are written tables, so that AQE can split a large component
    named = nodes.join(degree, "node", "left").join(parts, "node", "left")
    named = written(named.select("embedding", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "vector-components")
    least = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "components")
    told = written(named.join(least, "component").select(F.col("embedding").alias("__e"), "n_links", "component_id"), "named-vectors")
    discard(nodes, found, parts, named, least)
    out = good.join(told, good["embedding"] == told["__e"]).select("vec_id", "n_links", "component_id")
    out = out.unionAll(rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
