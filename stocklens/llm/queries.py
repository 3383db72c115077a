"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stocklens.llm import exact_dedup, jaccard_join, language_id, merkle, mixing, pieces, quality_classifier, quality_rules, simhash, substring_dedup, url_filter, warc, whitening
from stocklens.llm.native import documents, embeddings, pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": lambda spark, d: quality_rules.query(documents(spark, d)),
    "op2_exact_dedup": lambda spark, d: exact_dedup.groups(documents(spark, d)),
    "op3_substring_dedup": lambda spark, d: substring_dedup.query(documents(spark, d)),
    "op4_quality_classifier": lambda spark, d: quality_classifier.query(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op5_warc": lambda spark, d: warc.query(pages(spark, d)),
    "op6_language_id": lambda spark, d: language_id.query(documents(spark, d)),
    "op7_mixing": lambda spark, d: mixing.query(documents(spark, d)),
    "op8_jaccard_join": lambda spark, d: jaccard_join.query(documents(spark, d)),
    "op9_pieces": lambda spark, d: pieces.query(documents(spark, d)),
    "op10_url_filter": lambda spark, d: url_filter.judge(pages(spark, d)),
    "op11_merkle_manifest": lambda spark, d: merkle.query(documents(spark, d)),
    "op12_whitening": lambda spark, d: whitening.query(embeddings(spark, d)),
    "op13_simhash": lambda spark, d: simhash.query(documents(spark, d)),
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op3_substring_dedup": substring_dedup.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op10_url_filter": url_filter.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
}
