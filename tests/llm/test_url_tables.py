"""URL rules from tables, against a plain matcher."""

import random
import re

import pytest

from stocklens.llm import url_filter


def _fits(glob, url):
    """By the table of which prefixes fit which; no backtracking."""
    parts = [p for p in re.split(r"(\*\*|\*|.)", glob, flags=re.S) if p]
    row = [True] + [False] * len(url)
    for p in parts:
        if p in ("*", "**"):
            for k in range(1, len(row)):
                row[k] |= row[k - 1] and (p == "**" or url[k - 1] != "/")
        else:
            row = [False] + [row[k] and url[k] == p for k in range(len(url))]
    return row[-1]


def test_hundreds_of_globs_against_a_plain_matcher(monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("ab.é-/", k=rng.randint(0, 5)))
    globs = sorted({"".join(rng.choice((word(), "*", "**")) for _ in range(rng.randint(1, 6))) for _ in range(300)} - {""})
    urls = ["".join(rng.choices("ab.é-/", k=rng.randint(0, 14))) for _ in range(120)] + ["", "a" * 200, "/" * 70]
    auto = url_filter.compile_globs(globs)
    assert len(auto.start) > 10
    for size in (url_filter.STATE_BYTES, 1 << 12):  # one block, many blocks
        monkeypatch.setattr(url_filter, "STATE_BYTES", size)
        got = [row for block in url_filter.matches(auto, [u.encode() for u in urls]) for row in block.tolist()]
        assert got == [[_fits(g, u) for g in globs] for u in urls]


def test_rules_and_globs_from_tables(spark, monkeypatch):
    globs = spark.createDataFrame([("*.bad**",), ("*.bad**",), (None,), ("**/spam*/**",)], "glob string")
    rules = spark.createDataFrame([("x.org/", "allow"), ("x.org/", "block"), ("y.org/", "allow"), (None, "block"), ("z.org/", "odd"), ("y.org/a", "block")], "rule string, verdict string")
    assert url_filter.globs_of(globs) == ("**/spam*/**", "*.bad**") and url_filter.rules_of(rules) == {"x.org/": "block", "y.org/": "allow", "y.org/a": "block"}
    rows = [(1, "http://a.x.org/q", "h"), (1, "http://a.x.org/q", "h"), (2, "http://Y.org/a/b", "h"), (3, "http://y.org/c", "h"), (4, "http://m.bad.net/", "h"), (5, "http://ok.net/x/spam1/y", "h"), (6, "http://ok.net/spam", "h"), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string").withColumnRenamed("verdict", "host")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.judge(df, rules=url_filter.rules_of(rules), blocked=url_filter.globs_of(globs)).collect()), key=str)
    assert got == sorted([(1, "x.org/", "block")] * 2 + [(2, "y.org/a", "block"), (3, "y.org/", "allow"), (4, None, "block"), (5, None, "block"), (6, None, "allow"), (None, None, "allow")], key=str)
    assert {r.verdict for r in url_filter.judge(df, rules={}, blocked=()).collect()} == {"allow"}
    assert url_filter.judge(df.limit(0)).count() == 0
    monkeypatch.setattr(url_filter, "MOST_RULE_BYTES", 5)
    with pytest.raises(ValueError, match="at most 5"):
        url_filter.globs_of(globs)
