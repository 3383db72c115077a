"""Histogram bins (H2, H3, E18-E20), checked against numpy.histogram."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stocklens.operators.histogram import histogram


def _hist(spark, values, bins, lower=-1e9, upper=1e9):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return [r.asDict() for r in histogram(df, "x", lower, upper, bins).orderBy("bin").collect()]


def _numpy(values, bins, lower=-1e9, upper=1e9):
    a = np.array([v for v in values if v is not None and lower <= v <= upper], dtype=float)
    return np.histogram(a, bins=bins)


def test_e18_edges_and_closed_last_bin(spark):
    out = _hist(spark, [0.0, 5.0, 10.0], 4)  # edges 0, 2.5, 5, 7.5, 10
    assert [r["n"] for r in out] == [1, 0, 1, 1]
    assert out[0]["bin_lo"] == 0.0 and out[-1]["bin_hi"] == 10.0


def test_e19_single_value(spark):
    out = _hist(spark, [3.0, 3.0, 3.0], 4)
    assert out[0]["bin_lo"] == 2.5 and out[-1]["bin_hi"] == 3.5
    assert [r["n"] for r in out] == [0, 0, 3, 0]


def test_e20_empty(spark):
    out = _hist(spark, [None, 7.0], 5, lower=100.0, upper=200.0)
    assert [r["n"] for r in out] == [0] * 5
    assert out[0]["bin_lo"] == 0.0 and out[-1]["bin_hi"] == 1.0
    assert all(r["label"] is None for r in out)


def test_range_filter_is_inclusive_and_drops_null(spark):
    out = _hist(spark, [-500.0, 500.0, 501.0, None, 0.0], 20, lower=-500.0, upper=500.0)
    assert sum(r["n"] for r in out) == 3


def test_labels(spark):
    out = _hist(spark, [1.0, 1.0, 4.0], 3)
    assert [r["label"] for r in out] == ["2", None, "1"]


@settings(max_examples=25, deadline=None)
@given(
    st.lists(st.floats(min_value=-1e4, max_value=1e4, allow_nan=False), min_size=1, max_size=60),
    st.integers(min_value=1, max_value=25),
)
def test_matches_numpy(spark, values, bins):
    counts, edges = _numpy(values, bins)
    out = _hist(spark, values, bins)
    assert [r["n"] for r in out] == counts.tolist()
    assert [r["bin_lo"] for r in out] == edges[:-1].tolist()
    assert out[-1]["bin_hi"] == edges[-1]


def test_matches_numpy_on_edge_values(spark):
    # values sitting exactly on computed edges are where floor() alone fails
    lo, hi, bins = -500.0, 500.0, 20
    edges = np.linspace(lo, hi, bins + 1)
    values = edges.tolist() + [0.1 * i for i in range(-50, 50)]
    counts, _ = np.histogram(np.array(values), bins=bins)
    assert [r["n"] for r in _hist(spark, values, bins)] == counts.tolist()


def test_multi_histogram_equals_single(spark):
    from stocklens.operators.histogram import HistogramSpec, histograms

    rows = [(float(i % 37) - 18.0, (i * 7 % 11) / 10.0 if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double")
    specs = {"ha": HistogramSpec("a", -10.0, 10.0, 7), "hb": HistogramSpec("b", 0.1, 0.8, 4),
             "hc": HistogramSpec("a", 100.0, 200.0, 3)}
    multi = histograms(df, specs)
    for name, s in specs.items():
        one = histogram(df, s.column, s.lower, s.upper, s.bins)
        got = sorted(tuple(r)[1:] for r in multi.filter(multi.name == name).collect())
        assert got == sorted(tuple(r) for r in one.collect()), name
