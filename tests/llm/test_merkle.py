"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from stocklens.llm import merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row, text):
    doc_id, source, lang, n_chars, _ = row
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _lower(text):
    return text if text is None else text.translate({k: k + 32 for k in range(65, 91)})


def _tree(nodes, fan):
    """The top, and for each node the list of (before, after) up to it."""
    ways, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, spot in enumerate(spots):
            run = spot // fan * fan
            ways[k].append(("".join(nodes[run:spot]), "".join(nodes[spot + 1 : run + fan])))
            spots[k] = spot // fan
        nodes = [H("".join(nodes[k : k + fan])) for k in range(0, len(nodes), fan)]
    return nodes[0], ways


def plain(rows, fan=8):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, _leaf(row, row[4]), row))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = _tree([x[2] for x in groups[name]], fan)
    root, outer = _tree([trees[x][0] for x in names], fan)
    out = []
    for name, beyond in zip(names, outer, strict=True):
        for (_, _, leaf, row), own in zip(groups[name], trees[name][1], strict=True):
            path = own + beyond
            picked = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = _leaf(row, _lower(row[4])) if picked else leaf
            for before, after in path:
                node = H(before + node + after)
            out.append((row[0], leaf, trees[name][0], root, H("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def _rows(sizes):
    out, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            n += 1
            out.append((n * 37 % 100_003, f"s{n % 3}" if n % 5 else None, lang, n if n % 4 else None, None if n % 11 == 0 else f"Text É {n} " * (n % 7)))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, digest int, idx string, n string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "g", 1, "i", "n") for r in rows], SCHEMA).repartition(5)


def _got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 9, None: 1, "": 8}, {"en": 600, "de": 65, "fr": 64, "": 1, None: 3, "é": 2, "zz": 1, "a": 5, "b": 6, "c": 7}], ids=["one", "few", "ten"])
def test_against_plain_tree(spark, sizes):
    rows = _rows(sizes)
    assert _got(merkle.query(_frame(spark, rows))) == plain(rows)


def test_several_tiers(spark):
    """Superblocks of four nodes: tiers upon tiers of leaves and of languages, with awkward rows."""
    rows = _rows({"en": 137, "de": 5, None: 17, "x": 16, "y": 1}) + [(None, "s", "en", 1, "NULL ID")] * 2 + [(12, "s", "en", 1, "TWICE")] * 3
    rows += [(12, "s", "en", 1, "Other"), (-(2**63), None, None, None, None), (2**63 - 1, "s", "de", 0, ""), (3, "s", "de", 9, "LONG " * 100_000)]
    got = merkle.prove(merkle.leaves(_frame(spark, rows)), shape=merkle.Shape(2, 2))
    assert _got(got) == plain(rows, 2)


def test_ways_fold_to_the_root(spark):
    rows = _rows({"en": 70, "de": 2})
    for r in merkle.prove(merkle.leaves(_frame(spark, rows)), ways=True).collect():
        node = r.leaf
        for before, after in zip(r.way[::2], r.way[1::2], strict=True):
            node = H(before + node + after)
        assert node == r.root and r.proof_sha256 == H("".join(r.way))


def test_empty(spark):
    assert merkle.query(spark.createDataFrame([], SCHEMA)).count() == 0
