"""The comparison over a stream of candidate files (Structured Streaming).

Candidate recommendations often arrive in batches (one export per planning
run or region) while the baseline snapshot, factors, CoV and service levels
are static for the run. The comparison is then a chain of stream-static LEFT
joins with the stream on the preserved side -- supported by Structured
Streaming without state -- followed by the same stateless flags and rule
ladder as the batch path. The only stateful step is the running class
rollup, a streaming aggregation with at most 21 groups.

Each micro-batch joins against the static roles again, so when the static
side is big keep micro-batches large (``maxFilesPerTrigger``) so that its
scan and shuffle are paid for few times.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from stocklens import schema as S
from stocklens.operators import compare, populations, rollups, rules
from stocklens.sources.roles import Roles


def candidate_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Candidate files under ``path`` as a stream, with the declared schema."""
    reader = spark.readStream.schema(S.candidate_schema()).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def classified_stream(stream: DataFrame, static: Roles, snapshot: dt.date,
                      thresholds: rules.Thresholds = rules.Thresholds()) -> DataFrame:
    """Classified rows (P13/P14) of each arriving candidate row."""
    cmp = compare.comparison(static.with_candidate(stream), snapshot)
    return rules.classify(rules.flags(populations.final_su(cmp)), thresholds)


def running_rollup(classified: DataFrame) -> DataFrame:
    """A11 over everything seen so far (use output mode ``complete``)."""
    return rollups.class_rollup(classified)


def write_classified(classified: DataFrame, path: str, checkpoint: str,
                     available_now: bool = True):
    """Append classified rows to a parquet table as candidate files arrive.

    The file sink with a checkpoint location is exactly-once: a restarted
    query (or a lost executor) neither loses nor duplicates rows. With
    ``available_now`` the query processes what is there and stops.
    """
    writer = (
        classified.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
