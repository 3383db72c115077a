"""The dual of the mix against a plain Newton, on constraints that overlap."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklens.llm import mixing


def _plain(sizes, members, goal, steps=400):
    """Damped Newton over all documents, in numpy."""
    a, w, x = members.astype(float), sizes.astype(float), np.zeros(len(goal))
    def f(x):
        with np.errstate(over="ignore"):
            return (w * np.exp(a @ x)).sum() - x @ goal

    for _ in range(steps):
        r = w * np.exp(a @ x)
        g, h = a.T @ r - goal, a.T @ (a * r[:, None])
        if np.abs(g).max() < 1e-13 * goal.max():
            break
        d, t = np.linalg.lstsq(h, g, rcond=1e-13)[0], 1.0
        while t > 1e-9 and f(x - t * d) > f(x) - 1e-4 * t * (g @ d):
            t /= 2
        x = x - t * d
    return np.exp(a @ x)


def _frame(spark, sizes, members):
    rows = [(k, int(s), [int(j) for j in np.flatnonzero(m)]) for k, (s, m) in enumerate(zip(sizes, members, strict=True))]
    return spark.createDataFrame(rows, "id int, size long, constraints array<long>").repartition(3)


def _rates(df, found):
    return np.array([r[1] for r in sorted(df.select("id", found.rate(F.col("constraints"))).collect())])


def _corpus(n=400, seed=1):
    """Source, language and size band of each document: three constraints, and some that are in none of a family."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 900, n)
    source, lang, band = rng.choice(4, n, p=[0.6, 0.2, 0.15, 0.05]), rng.choice(4, n), (sizes > 500).astype(int)
    members = np.zeros((n, 9), bool)
    members[np.arange(n), source] = True
    members[np.arange(n)[lang < 3], 4 + lang[lang < 3]] = True
    members[np.arange(n), 7 + band] = True
    return sizes, members


def test_overlapping_constraints(spark):
    """Feasible by construction: the goals are those of random tilts. Sources and bands each sum to all, so the dual is not unique; rates are."""
    sizes, members = _corpus()
    tilt = np.exp(members @ np.random.default_rng(2).normal(0, 0.7, 9))
    goal = members.T @ (sizes * tilt)
    df = _frame(spark, sizes, members)
    found = mixing.balance(df, goal.tolist())
    assert not found.unmet and 2 <= found.steps < 40
    assert np.allclose(found.reached, goal, rtol=1e-9)
    assert np.allclose(_rates(df, found), tilt, rtol=1e-9) and np.allclose(_rates(df, found), _plain(sizes, members, goal), rtol=1e-9)


def test_far_targets_are_damped(spark):
    sizes, members = _corpus(120, 3)
    goal = (members.T @ sizes) * np.array([1e-4, 20, 1e3, 1, 1, 1, 1, 1, 1])
    members, goal = members[:, :4], goal[:4]
    df = _frame(spark, sizes, members)
    found = mixing.balance(df, goal.tolist())
    assert not found.unmet and np.allclose(found.reached, goal, rtol=1e-9) and np.allclose(_rates(df, found), _plain(sizes, members, goal), rtol=1e-9)


def test_targets_that_no_rates_meet(spark):
    """One constraint inside another with the larger target; one without documents; one of 0."""
    sizes = np.array([10, 20, 30, 40])
    members = np.array([[1, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1]], bool)
    df = _frame(spark, sizes, members)
    found = mixing.balance(df, [30.0, 60.0, 5.0, 0.0])
    assert {1, 2} <= set(found.unmet) or {0, 2} <= set(found.unmet)
    assert found.reached[2] == 0 and found.x[3] == -np.inf
    rates = _rates(df, found)
    assert rates[0] > 0 and rates[2] == rates[3] == 0
    assert not mixing.balance(df, [30.0, 10.0, 0.0, 0.0]).unmet


def test_edges(spark):
    df = _frame(spark, np.array([5, 0]), np.array([[1], [1]], bool))
    assert mixing.balance(df, [7.5]).unmet == () and mixing.balance(df.limit(0), [7.5]).unmet == (0,)
    with pytest.raises(ValueError, match="at most"):
        mixing.balance(df, [1.0] * (mixing.MOST_CONSTRAINTS + 1))
    with pytest.raises(ValueError, match="from 0 on"):
        mixing.balance(df, [-1.0])


def test_sources_many_and_few_have_the_same_rates(spark, monkeypatch):
    docs = spark.range(600).select(F.concat(F.lit("s"), F.col("id") % 7).alias("source"), (F.col("id") % 50 * F.col("id") % 97).alias("size"))
    goals = mixing.targets(docs)
    one = {r.source: (r.rate, r.target / r.source_size) for r in mixing.rated(goals).collect()}
    monkeypatch.setattr(mixing, "MOST_CONSTRAINTS", 3)
    many = {r.source: r.rate for r in mixing.rated(goals).collect()}
    assert len(one) == 7 and all(abs(a - b) < 1e-9 and abs(many[k] - b) < 1e-9 for k, (a, b) in one.items())


def test_a_column_of_the_numbers_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 5)], "doc_id long, text string, source string, Copy int")
    with pytest.raises(ValueError, match="already"):
        mixing.mix(docs, number="copy")
    assert mixing.mix(docs, number="mix_copy").columns == [*docs.columns, "mix_copy"]
