"""Connected components of a link table: alternating large-star and small-star steps.

Few links (``ONE_TASK`` at most, some megabytes) go through their rounds in one
task, without shuffles: a round is then one small job, however many partitions
the session deals to. More links are aggregated and joined over all tasks. The
steps are the same.

Links with a null end, and of a node with itself, link nothing. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.session import materialize

MOST_ROUNDS = 60
ONE_TASK = 200_000


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, from links (a, b) of longs; the root is the component's smallest node.

    A node with very many links is never gathered: minima are aggregated in part, and joined back (AQE splits a
    hot key). Every round is written, so a lost executor costs a re-read. ``links`` is counted first: give a table
    that is written.
    """
    together = (lambda df: df.coalesce(1)) if links.count() <= ONE_TASK else (lambda df: df)
    start = together(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))).distinct()
    edges = materialize(start, "links")
    mark = _mark(edges)
    for _ in range(MOST_ROUNDS):
        both = together(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = together(small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))).filter("u <> v").distinct()
        edges = materialize(small, "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components not settled in {MOST_ROUNDS} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
