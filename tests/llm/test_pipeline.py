"""run() stage by stage against plain Python, on awkward documents."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
from stocklens.llm import mixing, pieces, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, row string, key string, kept boolean"


def _rows():
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdeimnorst", k=rng.randint(3, 7))) for _ in range(n))
    texts = [prose(120)] + [prose(rng.choice((30, 60, 120))) for _ in range(40)]
    near = texts[0].split()
    near[11] = "changed"
    texts += [texts[1], texts[1], " ".join(near), "", None, "  \n ", "few words", "bad bad bad bad bad bad bad bad bad bad bad bad", "#$% &*| " * 20, texts[2]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[3]), (5, texts[5]), (5, texts[5]), (None, texts[4]), (2**40, prose(50))]
    return [(i, t, "en", rng.choice(("web", "book", None)), len(t or ""), k, "r", "k", True) for k, (i, t) in enumerate(rows)]


def _plain(rows):
    """Kept ids and texts after each of the first three stages, given which documents the rules keep."""
    texts = {}
    for r in rows:
        texts.setdefault(r[1] or "", []).append(r[0])
    exact = [(max((i for i in ids if i is not None), default=None), t) for t, ids in texts.items()]
    sets = []
    for _, t in exact:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(exact)))
    for _ in exact:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    near = []
    for k in set(root):
        group = [exact[j] for j in range(len(exact)) if root[j] == k]
        near.append(min(group, key=lambda x: (x[0] is None, x[0] or 0)))
    return exact, near


def test_stages(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, out, ""), f"test-{name}")
        stages[name] = out
    for name in ("quality_rules", "exact_dedup", "jaccard_join"):
        assert stages[name].columns == docs.columns
    assert stages["mixing"].columns == [*docs.columns, "mix_copy"]

    good = Counter((r.doc_id, r.text) for r in stages["quality_rules"].collect())
    verdicts = Counter((r.doc_id, r.n_words) for r in quality_rules.query(docs).filter("kept").collect())
    assert Counter((i, len(WORD.findall(t))) for (i, t), n in good.items() for _ in range(n)) == verdicts
    assert all(len(WORD.findall(t)) >= 10 for _, t in good) and not any("bad bad" in t or "#$%" in t for _, t in good)

    exact, near = _plain([(i, t) for (i, t), n in good.items() for _ in range(n)])
    by_id = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert by_id(stages["exact_dedup"]) == sorted(exact, key=str)
    assert by_id(stages["jaccard_join"]) == sorted(near, key=str) and len(near) < len(exact)

    taken = Counter((r.doc_id, r.text) for r in stages["mixing"].collect())
    words = {r.source: 0 for r in stages["jaccard_join"].collect()}
    for r in stages["mixing"].collect():
        words[r.source] += len(WORD.findall(r.text))
    goals = {r.source: r.target for r in mixing.targets(stages["jaccard_join"].selectExpr("source", "size(split(trim(text), ' +')) AS size")).collect()}
    assert set(taken) <= set(near) and max(taken.values()) <= 2
    assert all(abs(words[s] - t) <= 120 for s, t in goals.items())
    numbers = Counter((r.doc_id, r.text, r.mix_copy) for r in stages["mixing"].collect())
    assert max(numbers.values()) == 1 and {n for *_, n in numbers} <= {0, 1}

    decoded = pieces.decode_documents(stages["pieces"]).collect()
    assert Counter((r.doc_id, r.text) for r in decoded) == taken
    vocab = pieces.vocabulary(open(pieces.MODEL, "rb").read())
    for r in stages["mixing"].collect():
        own = pieces.encode(r.text, vocab, seed=pieces.SEED, variant=pieces._variant(r.doc_id, r.mix_copy), dropout=pieces.DROPOUT).tolist()
        assert any(d.doc_id == r.doc_id and list(d.pieces) == own for d in decoded)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
