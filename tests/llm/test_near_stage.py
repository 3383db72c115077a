"""The pipeline's near-duplicate stage against brute force, on pairs between its bounds and op8's."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stocklens.llm import components, hashing, jaccard_join


def _sets(texts, size):
    split = [t.lower().split() for t in texts]
    return [{tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} for w in split]


def _components(texts, size, percent):
    sets = _sets(texts, size)
    root = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if 100 * len(x & y) >= percent * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    return root


def _texts():
    out = []
    for base, words in enumerate((100, 100, 60, 400, 7, 30)):
        plain = [f"b{base}w{k}" for k in range(words)]
        out.append(" ".join(plain))
        for changed in range(1, 1 + max(3, words // 40)):  # words replaced far apart
            some = list(plain)
            for k in range(changed):
                some[(k * 2 + 1) * words // (2 * changed)] = f"b{base}c{changed}x{k}"
            out.append(" ".join(some))
        out.append(" ".join(plain[: words * 17 // 20]))
    return out


def test_stage_links_five_words_at_80(spark):
    """Also two words of a hundred replaced: 3-word Jaccard 0.885, 5-word Jaccard 0.811."""
    texts = _texts()
    strict, wide = _components(texts, 3, 90), _components(texts, 5, 80)
    assert strict[2] == 2 and wide[2] == 0
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == sorted(set(wide))


@pytest.mark.parametrize(("before", "shingle", "threshold"), [(0, 5, 80), (1, 3, 90), (8, 1, 60)])
def test_documents_that_share_passages(spark, monkeypatch, before, shingle, threshold):
    """Groups of near copies around common passages: many entries shared, few links; on each entry listed, or on few."""
    monkeypatch.setattr(jaccard_join, "BEFORE", before)
    rng = random.Random(before)
    passages = [[f"p{k}w{j}" for j in range(40)] for k in range(4)]
    texts = []
    for g in range(12):
        own = [f"g{g}w{j}" for j in range(rng.choice((30, 60, 200)))] + rng.choice(passages) + rng.choice(passages)
        for _ in range(rng.randint(1, 12)):
            some = list(own)
            for _ in range(rng.randint(0, 4)):
                some[rng.randrange(len(some))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(some[rng.randint(0, 6) :]))
    texts += [" ".join(passages[0]), " ".join(passages[0][:38]), " ".join(passages[0] + ["more"] * 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs, shingle=shingle, threshold=threshold).collect()}
    assert [got[k] for k in range(len(texts))] == _components(texts, shingle, threshold)


@pytest.mark.parametrize("threshold", [1, 37, 60, 80, 90, 99, 100])
def test_sizes_that_fit_are_in_neighbouring_classes(threshold):
    n = np.arange(1, 5000)
    most = n * 100 // threshold  # of a partner
    at, last = (jaccard_join.size_class(x, threshold).astype(np.int64) for x in (n, most))
    assert (np.diff(at) >= 0).all() and (last - at >= 0).all() and (last - at <= 1).all()


def test_entries_that_only_sizes_that_do_not_fit_share_are_not_dealt(spark, monkeypatch):
    """The rare shingles of a short and a long text are the same ones, the rest is common: no pair, so the short one has no entries."""
    common = [f"c{j}" for j in range(300)]
    passage = [f"p{j}" for j in range(8)]
    short, long = " ".join(passage + common[:20]), " ".join(passage + common)
    texts = [short, long, *[" ".join(common[:20])] * 8, *[" ".join(common)] * 8]
    held = {}

    def keep(df, name):
        held[name] = materialize(df, name)
        return held[name]

    materialize = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", keep)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_join.join(docs).collect()}
    assert [got[k] for k in range(len(texts))] == _components(texts, 3, 90) == [0, 1] + [2] * 8 + [1] * 8
    assert 26 in {r.n for r in held["shingle-nodes"].collect()}
    assert 26 not in {r.n for r in held["shingle-postings"].collect()}


def _nodes_with(spark, shared, sizes, *, entries):
    """Nodes of these sizes with as many entries of their own, and the ``shared`` tokens at the places 3, 4, ..."""
    own = F.transform(F.sequence(F.lit(1), F.lit(entries)), lambda x: F.xxhash64("sid", x))
    rows = spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(zip(sizes, shared, strict=True))], "sid long, n long, shared array<long>")
    prefix = F.concat(F.slice(own, 1, 3), "shared", F.slice(own, 4, entries))
    return rows.repartition(4).select("sid", "n", F.lit(2).alias("level"), F.unhex(F.lit("00" * 32)).alias("parity"), prefix.alias("prefix"))


@pytest.mark.parametrize("most", [jaccard_join.IN_BITMAP, 0])
def test_no_entries_are_kept_by_chance_however_full_a_sketch_would_be(spark, monkeypatch, most):
    """Many more entries than a sketch has cells: only those stay that nodes of fitting sizes share."""
    monkeypatch.setattr(hashing, "SKETCH_BITS", hashing.SLICE_BITS)
    monkeypatch.setattr(jaccard_join, "IN_BITMAP", most)
    sizes, shared = [2000] * 900, [[] for _ in range(900)]
    for k, sid in enumerate((0, 1, 2, 3, 4)):
        sizes[sid], shared[sid] = (2000, 2400, 2000, 60, 2000)[k], ([11, 12, 13], [11, 12, 13], [21, 22], [21, 22], [11])[k]
    nodes = _nodes_with(spark, shared, sizes, entries=4000)
    got = {r.sid: r for r in jaccard_join._postings(nodes, 80).collect()}
    assert sorted(got) == [0, 1]  # 2 and 3 are of far sizes, 4 shares less than its level
    for r in got.values():
        assert (r.tokens, r.places, r.alone, r.level) == ([11, 12, 13], [3, 4, 5], 4000, 2)
        assert (r.fold0, r.fold1, len(r.parity)) == (0, 0, 32)


@pytest.mark.parametrize(("classes", "kept"), [((30, 30), True), ((30, 31), True), ((63, 64), True), ((30, 32), False), ((30, 32, 34), False), ((30, 32, 33), True), ((30, 62), False)])
def test_tokens_of_fitting_sizes(spark, classes, kept):
    """A token is shared where two of its nodes are in one class or in neighbouring ones."""
    sizes = [round(np.exp((c + 0.5) * np.log(100 / 90))) for c in classes]
    assert [int(jaccard_join.size_class(np.array(n), 90)) for n in sizes] == list(classes)
    rows = spark.createDataFrame([(n, [7, -k]) for k, n in enumerate(sizes, 1)], "n long, prefix array<long>")
    assert [r.token for r in jaccard_join._shared_tokens(rows, 90).collect()] == [7] * kept


def test_lists_that_are_joined_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "IN_BITMAP", 0)
    texts = [*_texts(), "", " \t", None, "one", "one", "ONE two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for shingle, threshold in ((3, 90), (5, 80)):
        got = {r.doc_id: r.component_id for r in jaccard_join.join(docs, shingle=shingle, threshold=threshold).collect()}
        some = [k for k, t in enumerate(texts) if t and t.split()]
        assert [got[k] for k in some] == [some[c] for c in _components([texts[k] for k in some], shingle, threshold)]
        assert all(got[k] == k for k in range(len(texts)) if k not in some)


def test_small_tables_are_few_files_however_many_partitions_the_session_has(spark, monkeypatch):
    """Of 64 shuffle partitions no table between the steps is written as more than LEAST_FILES files; the rows are the same."""
    texts = [*_texts(), *[" ".join([f"g{g}w{j}" for j in range(80)] + [f"x{g}y{k}"]) for g in range(40) for k in range(3)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    written = {}

    def keep(df, name):
        out = materialize(df, name)
        written[name] = max(written.get(name, 0), len(out.inputFiles()))
        return out

    materialize = jaccard_join.materialize
    for module in (jaccard_join, components):
        monkeypatch.setattr(module, "materialize", keep)
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(r.doc_id for r in jaccard_join.keep_one(docs, shingle=5, threshold=80).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(set(_components(texts, 5, 80)))
    few = ("shared-tokens", "node-pairs", "wanted-nodes", "node-texts", "node-links", "links", "mixed-tokens", "met-pairs", "rooted-nodes", "rows-that-go")
    assert {k: n for k, n in written.items() if n > jaccard_join.LEAST_FILES and k in few} == {}
    assert set(few) <= set(written)
