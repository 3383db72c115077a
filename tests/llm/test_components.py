"""Components in one task and over many, against a plain union-find."""

import random

import pytest

from stocklens.llm import components


@pytest.mark.parametrize("one_task", [0, components.ONE_TASK])
def test_against_union_find(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(2000, 2080)] + [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)]
    links += [(-5, 9000), (9000, -(2**62)), (7, 7), (None, 3), (5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
