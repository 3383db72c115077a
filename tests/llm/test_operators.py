"""Each operator on a small table of awkward rows, against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest

from stocklens.llm import exact_dedup, jaccard_join, language_id, mixing, pieces, quality_classifier, quality_rules, substring_dedup, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i} the of{i % 7}" for i in range(60))
NEAR = BASE.replace("w30 ", "changed ")
TEXTS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, NEAR, "en", "b"), (4, BASE.upper(), "en", "b"), (5, "", "en", "b"), (6, None, None, None),
    (7, "two words", "de", "a"), (8, "TWO words", "de", "a"), (9, " \t\n ", "de", None), (None, BASE, "en", "a"), (2, BASE, "en", "a"),
    (10, "x " + " ".join(f"q{i}" for i in range(55)) + " y", "fr", "c"), (11, "z " + " ".join(f"q{i}" for i in range(55)) + " v", "fr", "c"),
    (12, "same line\nsame line\n\n#$% <b>|&*\nother", "fr", "c"), (13, "a b c d e a b c d e a b c d e", "fr", "c"), (14, "long " * 3000, "de", "a"), (15, "é▁  x  y", None, "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, key string, size int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, s, len(t or ""), "r", 1, "k", 2) for i, t, g, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_quality_rules(docs, empty):
    got = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.query(docs).collect())
    want = Counter()
    for _, t, *_ in TEXTS:
        w, lines = words(t), [x for x in (t or "").split("\n") if WORD.search(x)]
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        want[len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)] += 1
    assert got == want
    assert quality_rules.query(empty).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and not {5, 6, 7, 13} & {r.doc_id for r in kept.collect()}


def test_exact_dedup(docs, empty):
    got = exact_dedup.groups(docs).collect()
    by_text = {}
    for i, t, *_ in TEXTS:
        by_text.setdefault(t or "", []).append(i)
    assert len(got) == len(TEXTS) and sum(r.kept for r in got) == len(by_text)
    for r in got:
        ids = next(v for t, v in by_text.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert (r.keep_id, r.group_size) == (max(x for x in ids if x is not None), len(ids))
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns and left.count() == len(by_text)
    assert exact_dedup.groups(empty).count() == exact_dedup.deduplicate(empty).count() == 0


def test_substring_dedup(docs, empty):
    held = {}
    for i, t, *_ in TEXTS:
        for k in range(len(words(t)) - 49):
            held.setdefault(tuple(words(t)[k : k + 50]), set()).add(10**9 if i is None else i)
    want = Counter()
    for i, t, *_ in TEXTS:
        w = words(t)
        gone = {j for k in range(len(w) - 49) if min(held[tuple(w[k : k + 50])]) < (10**9 if i is None else i) for j in range(k, k + 50)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    assert Counter(rows_of(substring_dedup.query(docs))) == want
    assert substring_dedup.query(empty).count() == 0


def test_jaccard_join(docs, empty):
    sets = []
    for _, t, *_ in TEXTS:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 90 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    names = {k: min((TEXTS[j][0] for j in range(len(sets)) if root[j] == k and TEXTS[j][0] is not None), default=None) for k in root}
    want = Counter((TEXTS[k][0], len(s), names[root[k]] if s else TEXTS[k][0]) for k, s in enumerate(sets))
    assert Counter(rows_of(jaccard_join.query(docs))) == want
    left = jaccard_join.keep_one(docs)
    assert left.columns == docs.columns
    assert left.count() == len({r for r, s in zip(root, sets, strict=True) if s}) + sum(not s for s in sets)
    assert jaccard_join.query(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.query(docs).collect()
    total = sum(len(words(t)) for _, t, *_ in TEXTS)
    assert len(got) == len(TEXTS) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    goals = {r.source_size: r.target for r in got}
    assert abs(sum(goals.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in goals.items())
    assert sorted(map(tuple, got), key=str) == sorted(rows_of(mixing.query(docs)), key=str)
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns
    assert sum(len(words(r.text)) for r in mix.collect()) == sum(r.taken for r in got)
    assert mixing.query(empty).count() == 0


def test_pieces(docs, empty):
    vocab = pieces.vocabulary(open(pieces.MODEL, "rb").read())
    seen = {r.doc_id: r for r in pieces.decode_documents(pieces.encode_documents(docs)).collect()}
    assert all(seen[i].text == t for i, t, *_ in TEXTS)
    plain = [pieces.encode(BASE, vocab, seed=1, variant=0, dropout=0.0).tolist(), pieces.encode(BASE, vocab, seed=1, variant=1, dropout=0.5).tolist()]
    import sentencepiece

    assert plain[0] == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(BASE) != plain[1]
    for unit in (" therefore", "internationalisation", "a" * 40):
        key = pieces._key(unit, seed=3, variant=1)
        assert pieces._merge_short(unit, vocab.scores, key, 9000) == pieces._merge_long(unit, vocab.scores, key, 9000)
    assert pieces.query(empty).count() == 0


def test_classifiers(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (3, 1), (12, 0), (13, 0), (None, 1), (7, None), (13, 0)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        got = quality_classifier.query(docs, some).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality_classifier.query(empty, labels).count() == 0
    got = language_id.query(docs).collect()
    assert len(got) == len(TEXTS) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (5, 6, 9))
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "und"}
    assert language_id.query(empty).count() == 0


def test_url_filter(spark):
    urls = ["http://a.example.org/en/12?x", "https://example.org/es/", "http://ORG/", "http://xorg/a", "http://b.com/de/1#f", "com/fr/", None, "", "http://m.casino-x.net/a", "http://x.net/casino/.org/", "http://a.org"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[k][2:] for k in range(len(urls))] == [
        ("example.org/en/1", "block"), ("example.org/es/", "block"), ("org/", "allow"), (None, "allow"), ("com/de/", "block"), (None, "allow"),
        (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"),
    ]
    assert got[0][:2] == ("a.example.org", "/en/12") and got[5][:2] == ("", "")


def test_warc(spark, tmp_path):
    rows = [(1, "http://b.com/x", "<p>é</p>"), (2, "http://a.com/", "<p>é</p>"), (3, None, None), (4, "u\nx", ""), (None, "http://a.com/", "WARC/1.1\r\n\r\n"), (5, "http://b.com/x", "z" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.archive(df, str(tmp_path / "w")).collect()
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    kinds = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in got}
    assert kinds[1] == (9, "revisit", 2) and kinds[2] == (9, "response", None) and kinds[3] == (0, "revisit", 4) and kinds[4] == (0, "response", None)
    assert warc.archive(df.limit(0), str(tmp_path / "e")).count() == 0


def test_loser_tree():
    runs = [[1, 5, 9], [], [2, 2, 3], [4], [0, 10]]
    merged = [x for (x,) in warc.LoserTree([iter((v,) for v in r) for r in runs], lambda t: t)]
    assert merged == sorted(sum(runs, []))
