"""Token ids of a corpus in compressed, randomly readable files.

A store is a folder of two Parquet tables that Spark's own committer writes, so a lost executor
leaves no half file, and any file system that Spark reads will do:

- ``table``: token, freq, bits: the frequency table that all blocks share
- ``blocks``: part, block, start (ids before it in the part), n_ids, doc_ids, counts, payload

Parts follow each other in ascending id order, and so do blocks in a part and documents in a
block. The payload is a block of `rans`, which can be decoded alone, from its start or from a
checkpoint. Counts tell where documents begin, since the end id may also occur inside a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import rans
from newsloom.llm.base import discard, lean, scratch, written
from newsloom.llm.tokens import encoder, vocabulary_size

#: Ids at which a block closes; a longer document is a block of its own.
BLOCK_IDS = 1 << 19
RAW = "part int, block int, start long, n_ids long, doc_ids array<long>, counts array<long>, payload binary"
#: Raw blocks; the last of a partition also counts the partition's tokens (one entry for each that occurs).
COUNTED = RAW + ", tokens array<long>, ns array<long>"


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, width)
    size = np.dtype(width).itemsize
    held: list[pa.RecordBatch] = []  # (doc_id, ids) of the open block
    part, block, start, n_ids = 0, 0, 0, 0
    total = np.zeros(0, np.int64)

    def close(last: bool = False) -> pa.RecordBatch:
        nonlocal block, start, n_ids, held, total
        payload = b"".join(_values(b.column(1)) for b in held)
        counts = [n // size for b in held for n in pc.binary_length(b.column(1)).to_pylist()]
        got = np.bincount(np.frombuffer(payload, width), minlength=len(total))
        got[: len(total)] += total
        total = got
        at = np.flatnonzero(total) if last else np.empty(0, np.int64)
        row = [[part], [block], [start], [n_ids], [[d for b in held for d in b.column(0).to_pylist()]], [counts], [payload], [at], [total[at]]]
        block, start, n_ids, held = block + 1, start + n_ids, 0, []
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(2)[0].as_py()
        ids = enc.column(batch.column(1), end_id)
        rows = pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])
        ends = np.cumsum(pc.binary_length(ids).to_numpy().astype(np.int64) // size)
        a = 0
        while a < len(ends):
            before = int(ends[a - 1]) if a else 0
            b = int(np.searchsorted(ends, before + BLOCK_IDS - n_ids)) + 1  # the document that fills the block is its last
            held.append(rows.slice(a, b - a))
            n_ids += int(ends[min(b, len(ends)) - 1]) - before
            a = b
            if n_ids >= BLOCK_IDS:
                yield close()
    if held or block:
        yield close(last=True)


def _values(column: pa.Array) -> memoryview:
    """The bytes of all rows of a binary column, one after the other."""
    places = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2])[places[0] : places[-1]]


def _mapped(batches: Iterator[pa.RecordBatch], spec: tuple, width: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = rans.Table(*spec)
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            ids = np.frombuffer(row.column(6)[0].as_buffer(), width)
            cols = [*row.columns[:6], pa.array([rans.encode(ids, table)], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl) if not isinstance(ddl, T.StructType) else ddl)


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts, append the end id to each, and write a store in ascending id order.

    A null text is empty, so only its end id is written; a null id sorts first; equal ids keep all
    their rows, ordered by checksum of the text. An empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    width = "<u2" if max(vocabulary_size(vocabulary), end_id + 1) <= 1 << 16 else "<u4"
    schema, counted = _arrow(RAW), _arrow(COUNTED)
    raw = written(ranged.mapInArrow(lambda it: lean(_blocks(it, vocabulary, end_id, width, counted)), COUNTED), "raw-ids")
    each = raw.select(F.explode(F.arrays_zip("tokens", "ns")).alias("x")).select(F.col("x.tokens").alias("token"), F.col("x.ns").alias("n"))
    counts = each.groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # one row a vocabulary entry
    table = rans.Table.from_counts(counts.column("token").to_numpy(), counts.column("n").to_numpy())
    spec = (table.ids, table.freqs, table.bits)
    freqs = pa.table({"token": pa.array(table.ids.astype(np.int64)), "freq": pa.array(table.freqs.astype(np.int64)), "bits": pa.array(np.full(len(table.ids), table.bits), pa.int32())})
    spark.createDataFrame(freqs).coalesce(1).write.parquet(f"{path}/table")
    raw.drop("tokens", "ns").where("n_ids > 0").mapInArrow(lambda it: _mapped(it, spec, width, schema), RAW).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(raw)


def read_table(spark: SparkSession, path: str) -> rans.Table:
    """A store's frequency table: one row for each entry of the vocabulary."""
    t = spark.read.parquet(f"{path}/table").toArrow()
    if not t.num_rows:
        return rans.Table(np.empty(0, np.uint32), np.empty(0, np.uint64), 12)
    return rans.Table(t.column("token").to_numpy(), t.column("freq").to_numpy(), int(t.column("bits")[0].as_py()))


DECODED = "doc_id long, part int, start long, n_ids long, ids binary"


def _decoded(batches: Iterator[pa.RecordBatch], spec: tuple, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = rans.Table(*spec)
    for batch in batches:
        for i in range(batch.num_rows):
            part, _, start, _, docs, counts, payload = (c[i] for c in batch.columns)
            ids = rans.decode(payload.as_buffer().to_pybytes(), table).astype("<u4").tobytes()
            counts = np.array(counts.as_py(), np.int64)
            ends = np.cumsum(counts)
            begins = ends - counts
            cols = [docs.values, [part.as_py()] * len(counts), begins + start.as_py(), counts, [ids[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_ids, ids (binary, unsigned 32-bit) from the files."""
    table = read_table(spark, path)
    spec = (table.ids, table.freqs, table.bits)
    schema = _arrow(DECODED)
    blocks = spark.read.schema(RAW).parquet(f"{path}/blocks")
    docs = blocks.mapInArrow(lambda it: _decoded(it, spec, schema), DECODED)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row a written part
    return docs.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_ids", "ids")


def digest(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write docs to a new store, read it back, and describe each document by what was read."""
    path = scratch(docs.sparkSession, "token-store")
    write_store(docs, path, vocabulary, end_id)
    back = read_store(docs.sparkSession, path)
    return back.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
