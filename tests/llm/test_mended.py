"""Cases that earlier versions of op1, op3, op4, op5 and op6 got wrong or did not test, against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from stocklens.llm import language_id, quality_classifier, quality_rules, substring_dedup, warc

# --- op1


def _plain_em(patterns, iterations=quality_rules.ITERATIONS):
    """EM over (votes, n), in plain Python."""
    good, acc = quality_rules.START_GOOD, [quality_rules.START_ACCURACY] * len(quality_rules.RULES)
    clip = lambda x, r: min(max(x, r[0]), r[1])

    def p_good(votes):
        a, b = good, 1 - good
        for v, (on_good, on_bad) in zip(votes, acc, strict=True):
            a *= on_good if v == 1 else 1 - on_good if v == -1 else 1
            b *= 1 - on_bad if v == 1 else on_bad if v == -1 else 1
        return a / (a + b)

    for _ in range(iterations):
        p = {v: p_good(v) for v in patterns}
        total = sum(patterns.values())
        new_good = clip(sum(p[v] * n for v, n in patterns.items()) / total, quality_rules.GOOD_RANGE)
        new = []
        for k, old in enumerate(acc):
            w1 = sum(p[v] * n for v, n in patterns.items() if v[k])
            w0 = sum((1 - p[v]) * n for v, n in patterns.items() if v[k])
            hit = sum(p[v] * n for v, n in patterns.items() if v[k] == 1)
            miss = sum((1 - p[v]) * n for v, n in patterns.items() if v[k] == -1)
            new.append((clip(hit / w1, quality_rules.ON_GOOD_RANGE) if w1 else old[0], clip(miss / w0, quality_rules.ON_BAD_RANGE) if w0 else old[1]))
        moved = max([abs(new_good - good)] + [abs(x - y) for a, b in zip(new, acc, strict=True) for x, y in zip(a, b, strict=True)])
        good, acc = new_good, new
        if moved < quality_rules.TOLERANCE:
            break
    return {v: p_good(v) for v in patterns}


def test_em_against_a_plain_one(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(600):
        bad = rng.random() < 0.2
        rows.append(tuple((-1 if rng.random() < 0.6 else 0) if bad else rng.choice((1, 1, 1, 0, -1 if rng.random() < 0.05 else 1)) for _ in quality_rules.RULES))
    rows += [(0,) * len(quality_rules.RULES)] * 7  # all abstain
    feats = spark.createDataFrame(rows, ", ".join(f"{r} int" for r in quality_rules.RULES))
    model = quality_rules.fit(feats)
    want = _plain_em(Counter(rows))
    got = feats.distinct().withColumn("p", quality_rules.posterior(model)).collect()
    assert len(got) == len(want) and all(abs(r.p - want[tuple(r)[:-1]]) < 1e-9 for r in got)


def test_one_fault_has_one_verdict_at_every_length(spark):
    rng = random.Random(2)
    few = [f"w{k}" for k in range(30)]
    prose = lambda n: " ".join("".join(rng.choices("abcdeimnorst", k=rng.randint(3, 7))) for _ in range(n))
    docs = [(k, prose(rng.choice((60, 300, 900)))) for k in range(60)]
    lengths = (300, 1900, 2000, 2001, 2100, 20_000)
    docs += [(1000 + n, " ".join(rng.choice(few) for _ in range(n))) for n in lengths] + [(50_000 + n, prose(n)) for n in lengths]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    votes = {r.doc_id: r.v_kinds for r in quality_rules.features(df).select("row.doc_id", "v_kinds").collect()}
    assert {votes[1000 + n] for n in lengths} == {-1} and {votes[50_000 + n] for n in lengths} == {1}
    kept = {r.doc_id: r.kept for r in quality_rules.query(df).collect()}
    assert len({kept[1000 + n] for n in lengths}) == 1 and all(kept[50_000 + n] for n in lengths)


# --- op3


def test_rows_without_id_that_repeat(spark):
    """Thousands of rows of one text and no id, and of one id: each run is met once, and the result is as for single rows."""
    text = " ".join(f"w{k % 97}x{k}" for k in range(300))
    rows = [(None, text)] * 3000 + [(7, text)] * 2000 + [(3, text[: len(text) // 2])] + [(9, text)]
    got = Counter(tuple(r) for r in substring_dedup.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    half = len(rows[-2][1].split())
    whole = hashlib.sha256(text.encode()).hexdigest()
    ours = {r[0]: (r[2], n) for r, n in got.items()}
    assert ours[None] == (300, 3000) and ours[9] == (300, 1) and ours[3] == (0, 1)
    full = half if text.split()[half - 1] == rows[-2][1].split()[-1] else half - 1
    assert ours[7] == (full, 2000) and whole not in {r[3] for r in got if r[0] in (None, 9)}


def test_repeated_rows_make_few_spans(spark):
    text = " ".join(f"a{k}" for k in range(260))
    df = spark.createDataFrame([(1, text)] + [(None, text)] * 400, "doc_id long, text string")
    d = df.withColumns({"doc": F.coalesce("doc_id", F.lit(substring_dedup._LAST)), "key": F.xxhash64("text")})
    sketch = substring_dedup.hashing.seen_twice(df.select("text"), substring_dedup._window_keys)
    runs = substring_dedup._runs(d, sketch)
    one = substring_dedup._runs(d.limit(1), sketch).count()
    spans = substring_dedup._covered(runs).collect()
    assert len(spans) == 1 and len(spans[0].spans) == one


# --- op4


def test_neighbours_against_a_plain_vote():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((quality_classifier.RANK, 90)).astype(np.float32)
    vectors[:, 40:60] = vectors[:, 40:41]  # equals, across the edge of the neighbourhood for some
    vectors /= np.linalg.norm(vectors, axis=0)
    labels = (rng.random(90) < 0.6).astype(float)
    project = rng.standard_normal((quality_classifier.TERMS, quality_classifier.RANK)).astype(np.float32)
    matrix = rng.random((12, quality_classifier.TERMS)).astype(np.float32) * (rng.random((12, quality_classifier.TERMS)) < 0.01)
    got = quality_classifier.Model(project, vectors, labels, np.ones(quality_classifier.WORDS)).scores(matrix)
    for row, score in zip(matrix, got, strict=True):
        z = row.astype(float) @ project.astype(float)
        cosines = [float(z @ v / np.linalg.norm(z)) for v in vectors.T.astype(float)]
        last = sorted(cosines, reverse=True)[quality_classifier.NEIGHBOURS - 1] - 1e-6
        votes = [(max(c, 1e-3) ** quality_classifier.SHARPNESS, y) for c, y in zip(cosines, labels, strict=True) if c >= last]
        assert math.isclose(score, sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs_tol=1e-4)


def test_sparse_rows_are_the_dense_ones():
    weights = np.linspace(1, 2, quality_classifier.WORDS)
    texts = [b"Some words, 12 of them!\nSome words", b"", None, b"x " * 50_000]
    dense = np.stack([quality_classifier.terms(t, weights) for t in texts])
    packed = [quality_classifier._packed(r) for r in dense]
    assert (quality_classifier._rows(packed) == dense).all()
    basis = np.random.default_rng(0).standard_normal((quality_classifier.TERMS, 3)).astype(np.float32)
    assert np.allclose(quality_classifier._projected(packed, basis), dense @ basis, atol=1e-5)


# --- op5


def test_any_id_has_a_time_and_a_place(spark, tmp_path):
    ids = [2**63 - 1, -(2**63), 2**62 + 5, 10**12, -1, 0, 1, None, None, 2**63 - 1]
    rows = [(i, "http://B.com/x" if k % 2 else None, f"<p>{k // 3}</p>", "u", 1) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, url_key string, place int")
    got = warc.histories(warc.archive(df, str(tmp_path / "w"))).collect()
    assert len(got) == len(rows) and all(r.captured.startswith("2024-") and r.captured.endswith("Z") for r in got)
    urls = defaultdict(list)
    for r in got:
        urls[r.url_key].append((r.captured, r.page_id is not None, r.page_id or 0, r.place))
    assert {k: len(v) for k, v in urls.items()} == {"com,b)/x": 5, ")": 5}
    for v in urls.values():
        assert [x[3] for x in sorted(v, key=lambda x: x[3])] == [1, 2, 3, 4, 5] and [x[:3] for x in sorted(v, key=lambda x: x[3])] == sorted(x[:3] for x in v)
    for r in got:
        text = next(h for i, _, h, *_ in rows if len(h) == r.payload_bytes)
        assert r.payload_bytes == len(text)
    digests = {warc.base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for _, _, h, *_ in rows}
    assert {r.payload_digest for r in got} == digests


def test_places_of_one_hot_url(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 < 2, "http://hot.org/").otherwise(F.concat(F.lit("http://a.org/"), "id")).alias("url"), F.lit("x").alias("html"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = warc.histories(warc.archive(df.repartition(6), str(tmp_path / "w"))).filter("url_key = 'org,hot)/'").select("captured", "page_id", "place", "part").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ordered = sorted(got, key=lambda r: (r.captured, r.page_id))
    assert [r.place for r in ordered] == list(range(1, len(got) + 1)) and len({r.part for r in got}) > 1


def test_spool_merges_many_runs_with_few_files(tmp_path, monkeypatch):
    import resource

    monkeypatch.setattr(warc, "SPOOL_ROWS", 50)
    rng = random.Random(3)
    spool, want = warc._Spool(str(tmp_path)), []
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, hard))
    try:
        for run in range(5000):
            rows = sorted(((f"k{rng.randrange(40)}", f"t{rng.randrange(9)}", rng.choice((None, rng.randrange(10**6))), f"run{run}", k, 1, "d", "response", None) for k in range(rng.randint(0, 3))), key=warc._order)
            if rows:
                want += rows
                spool.add(warc._batches(rows))
        assert spool.written >= len(want) // 60 > 100
        merged = list(warc.LoserTree(spool.runs(), warc._order))
        assert len(spool.files) <= warc.FAN_IN and len(os.listdir(tmp_path)) <= warc.FAN_IN
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert merged == sorted(want, key=warc._order)


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Scaled down: files of 4 kB at most, but for single records beyond."""
    monkeypatch.setattr(warc, "FILE_SIZES", ((100, 8), (1000, 2), (None, 1)))
    rows = [(k, f"http://a.org/{k}", "x" * size) for k, size in enumerate([50] * 40 + [900] * 10 + [5000] * 3 + [0, 100, 101, 1000, 1001])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    assert warc.archive(df, path).count() == len(rows)
    for f in os.listdir(path):
        if f.startswith("part-"):
            content = open(os.path.join(path, f), "rb").read()
            assert content.count(b"WARC-Record-ID") == 1 or len(content) < 8 * 700 + 4000
    by_records = Counter(open(os.path.join(path, f), "rb").read().count(b"WARC-Record-ID") for f in os.listdir(path) if f.startswith("part-"))
    assert max(by_records) <= 8 and by_records[1] >= 4


# --- op6


def _plain_profile(texts):
    """Sum of the bound trigrams, letter by letter."""
    out = np.zeros(language_id.DIMENSIONS, np.int64)
    for text in texts:
        codes, last = [0], 0
        for c in (text or "").lower():
            code = ord(c) if c.isalpha() else 0
            if code or last:
                codes.append(code)
            last = code
        if codes[-1]:
            codes.append(0)
        if len(codes) < 3:
            continue
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            v = [language_id._LETTERS[x].astype(np.int64) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


def test_profiles_against_letter_by_letter(spark, monkeypatch):
    monkeypatch.setattr(language_id, "KINDS", 16)  # here on the driver; workers use the module's
    texts = {"uk": ["Україна і мова, 12 слів", "їжак і ніч"], "ru": ["русская речь и был", "быстрый бег"], "en": ["the quick fox", "An odd one! x"], "zh": ["汉字 你好 世界", "漢字"]}
    rows = [(k * 10 + j, t, lang) for k, (lang, some) in enumerate(texts.items()) for j, t in enumerate(some)]
    df = spark.createDataFrame(rows + [(99, "no", None), (98, None, "en"), (97, "", "en"), (None, "w", "en")], "doc_id long, text string, lang string").repartition(3)
    profiles = language_id.learn(df)
    learned = {r.doc_id for r in df.filter((language_id._remainder(F.col("doc_id")) != language_id.HELD_OUT) & F.col("doc_id").isNotNull()).collect()}
    want = {lang: _plain_profile([t for i, t, g in rows if g == lang and i in learned]) for lang in texts}
    assert {k for k, v in want.items() if v.any()} == {k for k, v in profiles.items() if v.any()}
    for lang, profile in profiles.items():
        assert (profile == want[lang]).all()
    own = language_id.letters("Світ у вогні, 你好!")
    counts = sum((c.astype(np.int64) @ v.astype(np.int64)).sum(axis=0) for c, v in language_id._bundles([own]))
    assert (counts == _plain_profile(["Світ у вогні, 你好!"])).all()
    mixed = [language_id.letters("".join(chr(0x4E00 + k * 7 % 3000) for k in range(n))) for n in (300, 0, 2, 900)]  # more trigrams than are numbered by a table
    for k, part in enumerate(mixed):
        got = sum((c[k].astype(np.int64) @ v.astype(np.int64) for c, v in language_id._bundles(mixed)), np.zeros(language_id.DIMENSIONS, np.int64))
        assert (got == _plain_profile(["".join(map(chr, part[1:-1]))])).all()


def test_letters_of_one_script_differ():
    be, ukrainian_i = language_id._LETTERS[0x431], language_id._LETTERS[0x456]
    assert abs(int((be.astype(int) * ukrainian_i).sum())) < 200


def test_ties_and_long_texts(spark):
    df = spark.createDataFrame([(1, "abc abc", "b"), (3, "abc abc", "a"), (4, "abc " * 200_000, None)], "doc_id long, text string, lang string")
    profiles = {"b": _plain_profile(["abc abc"]).astype(float), "a": _plain_profile(["abc abc"]).astype(float)}
    got = {r.doc_id: r for r in language_id.predict(df, dict(sorted(profiles.items()))).collect()}
    assert got[1].lang_pred == "a" and got[4].lang_pred == "a" and got[1].score > 0.999
