"""Contract queries of the training-data operators, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadtrace.llm import audit, collocations, decontam, jaccard, langid, linededup, oracles, packing, pii, rans, sharding, simhash, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_binary(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.summary(decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.summary(linededup.drop_repeated_lines(_table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.summary(simhash.edited_fingerprints(_table(spark, sf_dir, "documents")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_join(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_table(spark, sf_dir, "documents"))
    return found.selectExpr("doc.doc_id AS doc_id", "held_out", "lang_pred", "score")


def op8_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return sharded.selectExpr("doc.doc_id AS doc_id", "shard", "depth", "doc_bytes", "shard_bytes")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_pii(_table(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).selectExpr("page.page_id AS page_id", "host", "path", "rule", "verdict", "score")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return oracles.ORACLES
