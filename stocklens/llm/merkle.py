"""Merkle manifest of a dataset, with a proof for every row, by cogrouped subtree exchange.

A row's leaf is the sha256 of its fields, each ``-`` if null, else its length
in bytes, ``:`` and the value. The leaves of a language ascend by doc_id (ties
by leaf); every eight consecutive nodes become the sha256 of their hex
digests, level by level, until one is left, the language's subroot. Subroots,
ordered by language with null first, are reduced in the same way to the root.

Up: leaves are numbered within their language by a range sort and the sizes
of its partitions. 4,096 consecutive nodes are a superblock, which one
group reduces by up to four levels; superblocks' nodes are the next tier. A
language with any number of rows thus needs one tier more for each four
thousand times as many.

Down: in each tier, from the root's on, the nodes of a superblock are
cogrouped with the outer nodes that its proofs need: the siblings on the way
from the superblock to the root, the subroot and the root. The group finishes
its reduction again, joins its own siblings to the outer ones, and hands each
node's way down to the tier below. In the last tier each leaf, tampered or not,
is folded along its way and compared with the root.

No task holds more than a superblock and its way. Rows that repeat are leaves
of their own; which of two equal rows comes first changes nothing. Null ids
come first and are never tampered. Null fields are ``-``; texts of any length
are hashed in the JVM. An empty table gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OUTER = "grp string, block long, level int, before string, after string"
_INFO = -1  # the level of the row that carries subroot and root
_NODE = "grp string, idx long, n long, digest string"


@dataclass(frozen=True)
class Shape:
    """Of a tree: the nodes of a run, and the levels that a superblock reduces."""

    fan: int = 8
    at_once: int = 4

    @property
    def block(self) -> int:
        return self.fan**self.at_once


SHAPE = Shape()


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def levels(nodes: list[bytes], n: int, shape: Shape = SHAPE) -> list[list[bytes]]:
    """The levels over a superblock's nodes, of a group of n nodes: as many as it reduces where the group goes on, else up to its only node."""
    out = [nodes]
    while len(out) <= shape.at_once if n > shape.block else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest(*last[k : k + shape.fan]) for k in range(0, len(last), shape.fan)])
    return out


def siblings(reduced: list[list[bytes]], fan: int) -> list[list[tuple[bytes, bytes]]]:
    """For each level below the top: what stands before and after each node in its run."""
    out = []
    for level in reduced[:-1]:
        runs = [(k, k // fan * fan) for k in range(len(level))]
        out.append([(b"".join(level[run:k]), b"".join(level[k + 1 : run + fan])) for k, run in runs])
    return out


def way(around: list[list[tuple[bytes, bytes]]], place: int, fan: int) -> list[tuple[bytes, bytes]]:
    """The siblings on the way of one node of the lowest level."""
    out = []
    for level in around:
        out.append(level[place])
        place //= fan
    return out


def _outer(rows: pd.DataFrame) -> tuple[list[tuple[bytes, bytes]], bytes | None, bytes | None]:
    """The outer way of a superblock, its subroot and root, as far as they are known in its tier."""
    beyond, subroot, root = [], None, None
    for level, before, after in sorted(zip(rows["level"], rows["before"], rows["after"], strict=True)):
        if level == _INFO:
            subroot, root = before.encode() or None, after.encode()
        else:
            beyond.append((before.encode(), after.encode()))
    return beyond, subroot, root


def _field(name: str, value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[_field(k, v) for k, v in values.items()]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """grp, doc_id, digest, and ``changed``: the leaf of the tampered row, null where the row is not tampered."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *FIELDS[1:])
    own = {c: F.col(c) for c in FIELDS}
    lowered = own | {"text": F.translate("text", _UPPER, _LOWER)}
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # null first, then by bytes
    return d.select(group.alias("grp"), "doc_id", leaf(own).alias("digest"), F.when(picked, leaf(lowered)).alias("changed"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``idx``, each one's place in its ``grp`` by ``order``, and ``n``, the group's size.

    The sort is by range over all groups together, equal rows included, so that neither a large group nor a row that
    repeats lands in one task.
    """
    spread = rows.withColumn("salt", F.monotonically_increasing_id())
    keys = ["grp", *order, "salt"]
    in_order = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt").withColumn("at", F.monotonically_increasing_id())
    written = materialize(in_order, "merkle-order").withColumn("part", F.shiftright("at", 33))
    runs = written.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    group = Window.partitionBy("grp")  # a row per partition of the sort
    before = F.sum("size").over(group.orderBy("part")) - F.col("size")
    runs = runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("size").over(group).alias("n"))
    return written.join(runs, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _block(shape: Shape) -> Column:
    return F.expr(f"idx div {shape.block}").alias("block")


def _reduced(nodes: DataFrame, shape: Shape) -> DataFrame:
    """The next tier: a node for each superblock."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        n = int(rows["n"].iloc[0])
        top = levels([x.encode() for x in rows["digest"]], n, shape)[-1][0]
        return pd.DataFrame({"grp": rows["grp"].iloc[:1], "idx": rows["idx"].iloc[0] // shape.block, "n": -(-n // shape.block), "digest": top.decode()})

    return nodes.select("grp", _block(shape), "idx", "n", "digest").groupBy("grp", "block").applyInPandas(run, _NODE)


def _climb(nodes: DataFrame, shape: Shape) -> tuple[list[DataFrame], DataFrame]:
    """The tiers over ``nodes``, and the one node of each group that is left above them."""
    tiers = [nodes]
    while True:
        above = materialize(_reduced(tiers[-1], shape), "merkle-tier")
        if above.filter("n > 1").isEmpty():
            return tiers, above
        tiers.append(above)


def _handed_down(nodes: DataFrame, outer: DataFrame, below: str, at: Column, shape: Shape, *, subroots: bool) -> DataFrame:
    """The outer rows of the tier below: for each node of this tier, which is the superblock (``below``, ``at``) there, its way."""

    def run(rows: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        own = [x.encode() for x in rows["digest"]]
        reduced = levels(own, int(rows["n"].iloc[0]), shape)
        around = siblings(reduced, shape.fan)
        outward, subroot, root = _outer(beyond)
        root = root or reduced[-1][0]
        out = []
        for place, (group, block) in enumerate(zip(rows["below"], rows["at"], strict=True)):
            out.append((group, block, _INFO, (own[place] if subroots else subroot or b"").decode(), root.decode()))
            out += [(group, block, k, a.decode(), b.decode()) for k, (a, b) in enumerate(way(around, place, shape.fan) + outward)]
        return pd.DataFrame(out, columns=["grp", "block", "level", "before", "after"])

    left = nodes.select("grp", _block(shape), "idx", "n", "digest", F.col(below).alias("below"), at.cast("long").alias("at"))
    return materialize(left.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(run, _OUTER), "merkle-outer")


def prove(marked: DataFrame, *, shape: Shape = SHAPE, ways: bool = False) -> DataFrame:
    """From ``leaves``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    With ``ways`` also ``way``, the sibling digests by level, before and after the node in turn, which is what a holder
    of the row needs to check it against the root.
    """
    ordered = materialize(numbered(marked, "doc_id", "digest"), "merkle-leaves")
    tiers, subroots = _climb(ordered, shape)
    named = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("below"), "digest")
    by_language, _ = _climb(materialize(numbered(named, "below"), "merkle-subroots"), shape)

    outer = marked.sparkSession.createDataFrame([], _OUTER)
    for tier in reversed(by_language[1:]):
        outer = _handed_down(tier, outer, "grp", F.col("idx"), shape, subroots=False)
    outer = _handed_down(by_language[0], outer, "below", F.lit(0), shape, subroots=True)
    for tier in reversed(tiers[1:]):
        outer = _handed_down(tier, outer, "grp", F.col("idx"), shape, subroots=False)

    def run(rows: pd.DataFrame, beyond: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        own = [x.encode() for x in rows["digest"]]
        around = siblings(levels(own, int(rows["n"].iloc[0]), shape), shape.fan)
        outward, subroot, root = _outer(beyond)
        proofs, folds, taken = [], [], []
        for place, changed in enumerate(rows["changed"]):
            path = way(around, place, shape.fan) + outward
            proofs.append(digest(*[x for pair in path for x in pair]).decode())
            node = changed.encode() if changed else own[place]
            for before, after in path:
                node = digest(before, node, after)
            folds.append(node.decode())
            if ways:
                taken.append([x.decode() for pair in path for x in pair])
        out = {"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": subroot.decode(), "root": root.decode(), "proof_sha256": proofs, "folded_root": folds}
        return pd.DataFrame(out | ({"way": taken} if ways else {}))

    # ids as text: pandas has no whole numbers with gaps
    left = ordered.select("grp", _block(shape), "idx", "n", "digest", "changed", F.col("doc_id").cast("string").alias("doc_id"))
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + ", way array<string>" * ways
    done = left.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(run, schema)
    return done.withColumns({"doc_id": F.col("doc_id").cast("long"), "verified": F.col("folded_root") == F.col("root")})


def query(docs: DataFrame) -> DataFrame:
    """op11: one row per document."""
    return prove(materialize(leaves(docs), "merkle-digests"))


def _oracle(leaf_levels: int = 9, language_levels: int = 4, fan: int = SHAPE.fan) -> str:
    """The same in SQL, for up to fan ** levels rows of a language and languages: every level a table of its own."""

    def fields(text: str) -> str:
        sized = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END" for c in (*FIELDS[:-1], text)]
        return f"sha256({' || '.join(sized)})"

    def tier(name: str, k: int) -> str:
        up = f"SELECT g, i // {fan} AS i, (n + {fan - 1}) // {fan} AS n, CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // {fan}, n"
        run = f"OVER (PARTITION BY g, i // {fan} ORDER BY i ROWS BETWEEN"
        around = f"SELECT g, i, n, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}"
        return f"{name}{k + 1} AS ({up}),\ns{name}{k} AS ({around})"

    bits = "list_reduce([xor(c, b)] || range(8), lambda d, e: xor(d >> 1, 3988292384 * (d & 1)))"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {bits}), 4294967295)"
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    joins = [f"JOIN sa{k} ON sa{k}.g = d.g AND sa{k}.i = d.i // {fan**k}" for k in range(leaf_levels)]
    joins += ["JOIN b0 AS own ON own.lang = d.g"] + [f"JOIN sb{k} ON sb{k}.i = own.i // {fan**k}" for k in range(language_levels)]
    steps = [f"sa{k}" for k in range(leaf_levels)] + [f"sb{k}" for k in range(language_levels)]
    shown = ", ".join(f"{s}.n AS n{s}, {s}.l AS l{s}, {s}.r AS r{s}" for s in steps)
    folds = [f"f{k + 1} AS (SELECT *, CASE WHEN n{s} = 1 THEN h{k} ELSE sha256(l{s} || h{k} || r{s}) END AS h{k + 1} FROM f{k})" for k, s in enumerate(steps)]
    proof = " || ".join(f"CASE WHEN n{s} = 1 THEN '' ELSE l{s} || r{s} END" for s in steps)
    return f"""
WITH d0 AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {fields('text')} AS leaf,
                   CASE WHEN {crc} % 3 = 0 THEN {fields(lowered)} END AS changed FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d0),
a0 AS (SELECT g, i, n, leaf AS h FROM d),
{(',' + chr(10)).join(tier('a', k) for k in range(leaf_levels))},
b0 AS (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM a{leaf_levels}),
{(',' + chr(10)).join(tier('b', k) for k in range(language_levels))},
f0 AS (SELECT d.doc_id, d.leaf, own.h AS subroot, coalesce(d.changed, d.leaf) AS h0, {shown} FROM d {' '.join(joins)}),
{(',' + chr(10)).join(folds)}
SELECT doc_id, leaf, subroot, root.h AS root, sha256({proof}) AS proof_sha256, h{len(steps)} AS folded_root, h{len(steps)} = root.h AS verified
FROM f{len(steps)}, b{language_levels} AS root
"""


ORACLE_SQL = _oracle()
