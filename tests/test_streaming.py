"""Streaming path gives the batch result once all files are processed."""

import uuid

from conftest import SF001
from stocklens import streaming
from stocklens.operators import rollups
from stocklens.plans.analysis import Analysis


def test_stream_rollup_equals_batch(spark, tmp_path):
    a = Analysis.from_tables(spark, SF001)
    src = str(tmp_path / "candidate")
    # candidate rows arrive as three separate exports
    a.roles.candidate.repartition(3).write.parquet(src)
    stream = streaming.candidate_stream(spark, src, max_files_per_trigger=1)
    rolled = streaming.running_rollup(
        streaming.classified_stream(stream, a.roles, a.snapshot)
    )
    name = f"rollup_{uuid.uuid4().hex[:8]}"
    q = (
        rolled.writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.table(name).collect())
    want = sorted(tuple(r) for r in rollups.class_rollup(a.classified).collect())
    assert got == want


def test_stream_classified_rows_equal_batch(spark, tmp_path):
    a = Analysis.from_tables(spark, SF001)
    src = str(tmp_path / "candidate")
    a.roles.candidate.repartition(4).write.parquet(src)
    stream = streaming.candidate_stream(spark, src, max_files_per_trigger=2)
    out = str(tmp_path / "classified")
    q = streaming.write_classified(
        streaming.classified_stream(stream, a.roles, a.snapshot), out, str(tmp_path / "ck")
    )
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    want = a.classified
    assert got.count() == want.count()
    cols = ["product", "location", "code", "label"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
