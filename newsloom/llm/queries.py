"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import collocations, decontamination, embedding_dedup, html_extraction, line_dedup, packing, quality, ranked_search, sharding, simhash, suffix_dedup, token_counts, token_store
from newsloom.llm.base import bytes_of, prepare, table

BYTE_VOCABULARY, WORD_VOCABULARY, PIECE_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
END_ID = 2


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_store.digest(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), END_ID)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = html_extraction.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    data = bytes_of(F.col("text"))
    return cut.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.octet_length(data).cast("long").alias("kept_bytes"), F.sha2(data, 256).alias("kept_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(PIECE_VOCABULARY))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ranked_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


QUERIES: dict[str, Query] = {
    "op1_token_store": op1_token_store,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_sharding": op4_sharding,
    "op5_simhash": op5_simhash,
    "op6_html_extraction": op6_html_extraction,
    "op7_packing": op7_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_collocations": op12_collocations,
    "op13_ranked_search": op13_ranked_search,
}
