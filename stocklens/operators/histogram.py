"""Equal-width histograms as distributed aggregates.

The source analysis collected the whole table to the driver and binned it
there. Here only the bin counts (at most ``bins`` rows) leave the cluster:

1. keep the rows where some histogram's column is in its ``[lower, upper]``
   (NULL drops out) -- a filter the scan can take;
2. one global aggregate with a ``min``/``max`` pair per histogram: the edges
   span the *data's* range, ``lower``/``upper`` only select rows;
3. unpivot the in-range values to (histogram id, value), look each
   histogram's range up by id (an equi-join against at most one row per
   histogram, so the broadcast is bounded) and compute the bin with column
   arithmetic;
4. ``groupBy(id, bin).count()`` -- partial/final, so a hot bin costs
   nothing and at most ``sum(bins)`` rows per task leave the map side;
5. add a zero row for every bin and sum per bin, so empty bins show 0.

Bin rule (the usual equal-width histogram convention): edges
``e_j = j * step + lo`` with ``step = (hi - lo) / bins`` and the last edge
exactly ``hi``; bins are half-open ``[e_j, e_j+1)`` except the last, which is
closed. The bin is first estimated as ``floor((x - lo) * (bins / (hi - lo)))``
and then corrected by one against the actual edges, so rounding in the
estimate never puts a value on the wrong side of an edge. An empty input uses
the range [0, 1]; a single distinct value ``v`` uses [v - 0.5, v + 0.5].

Steps 2 and 3 both read the same filtered input. Over a lazy comparison that
would run its joins twice, so ``written`` puts the values (a narrow table: one
column for each histogram) into the shared folder first. Six histograms cost
the same two passes as one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.session import materialize

# Histogram settings of the source analysis (H1).
DIFF_RANGE = (-500.0, 500.0, 20)
COV_RANGE = (0.1, 1.6, 10)


@dataclass(frozen=True)
class HistogramSpec:
    column: str
    lower: float
    upper: float
    bins: int


# Histograms of the analysis over population F2 (name -> spec).
SPECS = {
    "hist_final_su": HistogramSpec("final_su_diff", *DIFF_RANGE),
    "hist_final_su_cycle": HistogramSpec("final_su_cycle_diff", *DIFF_RANGE),
    "hist_reco_su": HistogramSpec("reco_su_diff", *DIFF_RANGE),
    "hist_final_days": HistogramSpec("final_days_diff", *DIFF_RANGE),
    "hist_reco_days": HistogramSpec("reco_days_diff", *DIFF_RANGE),
    "hist_cov": HistogramSpec("base_cov", *COV_RANGE),
}


def in_range(df: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    """the single column, inclusive range filter (NULL excluded)."""
    return df.select(F.col(column).alias("v")).filter(F.col("v").between(lower, upper))


def _edge(j: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """Edge ``j``: ``j * step + lo``, and exactly ``hi`` for the last one."""
    return F.when(j >= bins, hi).otherwise(j.cast("double") * ((hi - lo) / bins.cast("double")) + lo)


def _outer_edges(vmin: Column, vmax: Column) -> tuple[Column, Column]:
    """Histogram range from the data: [0, 1] when empty, +-0.5 around one value."""
    lo = F.when(vmin.isNull(), F.lit(0.0)).when(vmin == vmax, vmin - 0.5).otherwise(vmin)
    hi = F.when(vmax.isNull(), F.lit(1.0)).when(vmin == vmax, vmax + 0.5).otherwise(vmax)
    return lo, hi


def values(df: DataFrame, specs: dict[str, HistogramSpec]) -> DataFrame:
    """Columns ``v0``, ``v1``, ...: each spec's in-range values, of the rows that have any."""
    names = list(specs)
    idx = range(len(names))

    def in_range_of(i: int) -> Column:
        s = specs[names[i]]
        return F.col(s.column).between(s.lower, s.upper)

    any_in_range = None
    for i in idx:
        any_in_range = in_range_of(i) if any_in_range is None else any_in_range | in_range_of(i)
    return df.filter(any_in_range).select(
        *[F.when(in_range_of(i), F.col(specs[names[i]].column)).alias(f"v{i}") for i in idx]
    )


def written(df: DataFrame, specs: dict[str, HistogramSpec]) -> DataFrame:
    """``values`` as a table in the shared folder: what makes ``df`` runs once, and both passes read the specs' columns alone."""
    return materialize(values(df, specs), "histogram-values")


def histograms(df: DataFrame, specs: dict[str, HistogramSpec], vals: DataFrame | None = None) -> DataFrame:
    """Rows ``(name, bin, bin_lo, bin_hi, n, label)``: every bin of every spec.

    ``bin`` counts from 0; ``label`` is the bar label: the count as text, NULL
    for an empty bin (H3). ``vals`` are the ``values`` of ``df`` where they are
    at hand already.
    """
    names = list(specs)
    idx = range(len(names))
    vals = values(df, specs) if vals is None else vals

    # pass 1: the data range of each histogram -> one row per histogram
    # (hid, name, lo, hi, bins); at most len(specs) rows, so broadcasting it
    # is safe
    mm = vals.agg(*[c for i in idx
                    for c in (F.min(f"v{i}").alias(f"mn{i}"), F.max(f"v{i}").alias(f"mx{i}"))])
    entries = []
    for i in idx:
        lo, hi = _outer_edges(F.col(f"mn{i}"), F.col(f"mx{i}"))
        entries.append(F.struct(F.lit(i).alias("hid"), F.lit(names[i]).alias("name"),
                                lo.alias("lo"), hi.alias("hi"),
                                F.lit(specs[names[i]].bins).alias("bins")))
    ranges = mm.select(F.explode(F.array(*entries)).alias("h")).select("h.*")

    # pass 2: unpivot the in-range values to (hid, v) -- the position in the
    # value array is the histogram id -- look the range up by id, and bin:
    # estimate floor((v - lo) * (bins / (hi - lo))), then correct by one
    # against the actual edges. Each step is its own projection, so every
    # intermediate is computed once per row.
    long = vals.select(F.posexplode(F.array(*[f"v{i}" for i in idx])).alias("hid", "v")).filter(
        F.col("v").isNotNull())
    v, lo, hi, nb, g = F.col("v"), F.col("lo"), F.col("hi"), F.col("bins"), F.col("g")
    keep = ["hid", "v", "lo", "hi", "bins"]
    est = long.join(F.broadcast(ranges.drop("name")), "hid").select(
        *keep, F.floor((v - lo) * (nb.cast("double") / (hi - lo))).cast("int").alias("g"))
    est = est.select(*keep, F.when(g >= nb, nb - 1).otherwise(g).alias("g"))
    down = est.select(*keep, F.when(v < _edge(g, lo, hi, nb), g - 1).otherwise(g).alias("g"))
    binned = down.select(
        "hid",
        F.when((g != nb - 1) & (v >= _edge(g + 1, lo, hi, nb)), g + 1).otherwise(g).alias("bin"),
    )
    counts = binned.groupBy("hid", "bin").agg(F.count(F.lit(1)).alias("n"))

    # every bin of every histogram with n = 0, plus the counts, summed per
    # bin: empty bins show 0. A union rather than a join, so no predicate on
    # the bin is inferred and pushed back into the per-row binning. Both
    # sides hold at most sum(bins) rows.
    zeros = ranges.select(
        "hid", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"),
        F.lit(0).cast("long").alias("n"),
    )
    per_bin = counts.unionByName(zeros).groupBy("hid", "bin").agg(F.sum("n").alias("n"))
    j = F.col("bin")
    return (
        per_bin.join(F.broadcast(ranges), "hid")
        .select(
            "name",
            j,
            _edge(j, lo, hi, nb).alias("bin_lo"),
            _edge(j + 1, lo, hi, nb).alias("bin_hi"),
            "n",
        )
        .withColumn("label", F.when(F.col("n") > 0, F.col("n").cast("string")))
    )


def histogram(df: DataFrame, column: str, lower: float, upper: float, bins: int) -> DataFrame:
    """H2: one histogram, rows ``(bin, bin_lo, bin_hi, n, label)``."""
    return spec_histogram(df, HistogramSpec(column, lower, upper, bins))


def spec_histogram(df: DataFrame, spec: HistogramSpec, vals: DataFrame | None = None) -> DataFrame:
    return histograms(df, {"h": spec}, vals).drop("name")
