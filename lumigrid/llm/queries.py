"""The queries of the corpus operators: op<N>_<name>, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import anchors, bwt_dedup, credentials, decontaminate, html_text, language, media, near_dup, oracle, packing, quotes

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = language.fit(documents.where(~held_out))
    return language.predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_switches")


def op2_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(_read(spark, sf_dir, "conversations"))


def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.removal(_read(spark, sf_dir, "documents"))


def op5_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_crf_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op8_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.removal(_read(spark, sf_dir, "documents"))


def op9_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.sniffed(media.stored(_read(spark, sf_dir, "documents")))


def op10_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scan(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_crf_language, op2_quotation_threads, op3_bbit_minhash, op4_block_anchors, op5_dominance_packing, op6_suffix_arrays, op7_crf_html, op8_bwt_merge, op9_media_sniffing, op10_credential_links)
}

#: DuckDB SQL of the queries that SQL can express on whole tables.
ORACLE: dict[str, str] = {
    "op2_quotation_threads": oracle.QUOTATION_THREADS,
    "op3_bbit_minhash": oracle.BBIT_MINHASH,
    "op4_block_anchors": oracle.BLOCK_ANCHORS,
    "op6_suffix_arrays": oracle.SUFFIX_ARRAYS,
    "op8_bwt_merge": oracle.BWT_MERGE,
    "op10_credential_links": oracle.credential_links(),
}
