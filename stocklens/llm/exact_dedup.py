"""Exact deduplication by skew-safe combining.

Three stages, each keyed by the full text beside its digest, so content is
compared whenever rows are merged:

1. local: partial aggregation inside each task (one row per text and task);
2. salted: groups are merged per (digest, salt), the salt being the task that
   made the partial row, so the task rows of a hot group go to ``SALTS`` tasks;
3. global: at most ``SALTS`` winners per text meet.

Membership is joined back by digest, length and a second hash: rows without
text; a hot digest there is split by AQE's skew join.

Null text counts as empty. Null ids are the smallest. Of rows that repeat with
the same id and text one is kept. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 8
_KEY = ["sha", "len", "xx"]


def _keyed(docs: DataFrame, *carry) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *carry).withColumns(
        {"sha": F.sha2("text", 256), "len": F.length("text"), "xx": F.xxhash64("text")}
    )


def _winners(keyed: DataFrame, *, salts: int, value) -> DataFrame:
    """One row per text: the largest ``value`` and the group's size."""
    local = keyed.withColumn("salt", F.spark_partition_id() % salts)
    salted = local.groupBy(*_KEY, "salt", "text").agg(F.max(value).alias("best"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy(*_KEY, "text").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))


def groups(docs: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    keyed = _keyed(docs)
    best = _winners(keyed, salts=salts, value="doc_id").select(*_KEY, F.col("best").alias("keep_id"), "group_size")
    same = Window.partitionBy(*_KEY, "doc_id").orderBy(F.lit(0))
    ranked = keyed.drop("text").withColumn("copy", F.row_number().over(same))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return ranked.join(best, _KEY).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, *, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The winner's columns travel through the aggregation, so no join follows.
    Of equal ids and texts the row with the largest other columns stays.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(
        F.col("doc_id").alias("id"), F.col("text").isNotNull().alias("has"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    ).alias("row")
    won = _winners(_keyed(docs, row), salts=salts, value="row")
    cols = {c: F.col(f"best.c{i}") for i, c in enumerate(others)}
    cols |= {"doc_id": F.col("best.id"), "text": F.when(F.col("best.has"), F.col("text"))}
    return won.select(*[cols[c].alias(c) for c in docs.columns])


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""
