"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. Every stage
works on all that its predecessor kept; all but the last return the columns of
``documents``. Mixing repeats rows and numbers the copies in a column ``copy``
(or ``mix_copy``, ``mix_copy1``, ... where documents have a column of that name),
the last one, and the last stage encodes each of them.

Null and empty texts fail the base rule and go in the first stage. Null ids are
kept apart from others by their texts; of rows that repeat one stays after the
second stage. Other columns, whatever their names, travel along up to the last
stage. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stocklens.llm import exact_dedup, jaccard_join, mixing, pieces, quality_rules
from stocklens.llm.native import documents
from stocklens.session import materialize


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is too low, or that fail the base rule, go."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (linked on 5-word shingles at a Jaccard similarity of 0.8) the one with the smallest id stays."""
    return jaccard_join.keep_one(docs, shingle=5, threshold=80)


def _own_copy(docs: DataFrame) -> str:
    """The name of the copies' number beside these columns."""
    taken = {c.lower() for c in docs.columns}
    return next(x for x in ("copy", "mix_copy", *(f"mix_copy{k}" for k in range(1, len(taken) + 1))) if x not in taken)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: documents are left out or repeated. Adds the number of the repetition."""
    return mixing.mix(docs, number=_own_copy(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and piece ids of every row of the mix, with merge-dropout of its own for each copy."""
    last = docs.columns[-1]
    return pieces.encode_documents(docs, copy=last if re.fullmatch(r"copy|mix_copy\d*", last) else None)


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mix), ("pieces", encode)]

#: EM and the piece model are not SQL: tests/llm/test_pipeline.py holds run(), stage by stage, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
