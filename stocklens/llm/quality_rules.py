"""Quality rules as weak supervision, in DataFrame operations alone.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns (at most 3^rules rows, whatever the corpus)
estimates the share of good documents and every rule's accuracy on good and on
bad ones; a document is kept when its posterior probability of being good reaches ``KEEP``. One
aggregation per iteration; the driver carries only the parameters.

Features are computed once per document and written to the shared folder.
No step groups rows by anything but the vote pattern, with partial
aggregation, so no key can be hot. Null text has no words; it and texts of
fewer than 10 words fail the base rule and are never kept. An empty table
gives an empty result. Repeated rows count and are returned each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm import native
from stocklens.session import materialize

KEEP = 0.5
ITERATIONS = 30
TOLERANCE = 1e-6
START_GOOD = 0.85
#: A rule's accuracies on good and on bad documents. A rule looks at one kind of fault, so it finds
#: only some of the bad documents; that it blames few good ones is what makes it a rule. The ranges keep the classes from trading places.
START_ACCURACY = (0.98, 0.3)
GOOD_RANGE, ON_GOOD_RANGE, ON_BAD_RANGE = (0.02, 0.98), (0.9, 0.999), (0.1, 0.99)
WINDOW = 5
BLOCK = 1000  # words, of which the distinct ones are counted


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 5-word windows that occur twice or more."""
    w = F.col("words")
    window = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<long>"))
    docs = docs.withColumn("wins", window)
    repeats = F.size(F.array_distinct("wins")) < F.size("wins")
    none = F.array().cast("array<struct<h:long,p:int>>")
    docs = docs.withColumn(
        "sorted", F.when(repeats, F.sort_array(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).otherwise(none)
    )
    s = F.col("sorted")
    twin = lambda e, j: F.coalesce(e["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, j + 1)["h"], F.lit(False))
    docs = docs.withColumn("starts", F.sort_array(F.transform(F.filter(s, twin), lambda e: e["p"])))
    p = F.col("starts")
    gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))).cast("long"))
    return docs.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))


def _kinds() -> Column:
    """The least number of distinct words in a block of ``BLOCK`` words; the last block ends with the text. Shorter texts are one block."""
    n = F.col("n_words").cast("int")
    blocks = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(BLOCK))
    start = lambda at: F.greatest(F.least(at, n - BLOCK), F.lit(0)) + 1
    return F.array_min(F.transform(blocks, lambda at: F.size(F.array_distinct(F.slice("words", start(at), BLOCK))))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """The base figures, ``base_failed`` and one vote column per rule, beside ``row`` (all columns of ``docs``)."""
    text = F.col("row.text")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("words", native.words(text))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    d = d.withColumn("lines", lines)
    count = lambda regex: F.length(F.regexp_replace(F.coalesce(text, F.lit("")), regex, "")).cast("long")
    d = d.withColumns(
        {
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_block": F.least("n_words", F.lit(BLOCK).cast("long")),
            "n_kinds": _kinds(),
            "n_upper": count("[^\\p{Lu}]+"),
            "n_letters": count("\\P{L}+"),
        }
    )
    d = _repeat_words(d)
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    return d.select("row", *figures, "base_failed", *[v.cast("int").alias(f"v_{k}") for k, v in _votes().items()])


def _votes() -> dict[str, Column]:
    """Votes by rule. Every comparison is on integers, so votes are exact."""
    n, chars = F.col("n_words"), F.col("word_chars")
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    share = lambda part, whole, bad, good: vote(part * 100 > whole * bad, (part * 100 <= whole * good) & (whole > 0))
    return {
        "length": vote(n < 10, n >= 40),
        "symbols": share(F.col("n_symbols"), chars, 8, 2),
        "symbol_words": share(F.col("n_symbols"), n, 30, 10),
        "lines": vote(F.col("n_dup_lines") * 100 > F.col("n_lines") * 50, (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 2)),
        "repeats": share(F.col("n_repeat_words"), n, 20, 5),
        "kinds": vote((n >= 20) & (F.col("n_kinds") * 100 < F.col("n_block") * 30), (n >= 20) & (F.col("n_kinds") * 100 >= F.col("n_block") * 40)),
        "capitals": share(F.col("n_upper"), chars, 30, 12),
        "letters": vote(F.col("n_letters") * 100 < chars * 80, F.col("n_letters") * 100 >= chars * 95),
        "word_length": vote((chars < n * 2) | (chars > n * 15), (chars >= n * 3) & (chars <= n * 10) & (n > 0)),
    }


RULES = tuple(f"v_{k}" for k in ("length", "symbols", "symbol_words", "lines", "repeats", "kinds", "capitals", "letters", "word_length"))


def posterior(model: dict) -> Column:
    """P(good | votes) under ``model``: the share of good documents and, by rule, its accuracy on good and on bad ones."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for rule in RULES:
        on_good, on_bad = model[rule]
        says_good = math.log(on_good / (1 - on_bad))
        says_bad = math.log((1 - on_good) / on_bad)
        odds = odds + F.when(F.col(rule) == 1, says_good).when(F.col(rule) == -1, says_bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def fit(feats: DataFrame, *, iterations: int = ITERATIONS) -> dict:
    """EM over the pattern counts of all documents."""
    patterns = materialize(feats.groupBy(*RULES).agg(F.count(F.lit(1)).alias("n")).repartition(1), "vote-patterns")  # counted in parallel; one small file
    model: dict = {r: START_ACCURACY for r in RULES} | {"good": START_GOOD}
    p, n = F.col("p"), F.col("n")
    for _ in range(iterations):
        sums = [F.sum(p * n).alias("good"), F.sum(n).alias("n")]
        for r in RULES:
            voted = F.when(F.col(r) != 0, n).otherwise(0)
            sums += [F.sum(p * voted).alias(f"good_{r}"), F.sum((1 - p) * voted).alias(f"bad_{r}")]
            sums += [F.sum(F.when(F.col(r) == 1, p * n)).alias(f"hit_{r}"), F.sum(F.when(F.col(r) == -1, (1 - p) * n)).alias(f"miss_{r}")]
        row = patterns.withColumn("p", posterior(model)).agg(*sums).first()
        if not row["n"]:
            break
        new: dict = {"good": _within(row["good"] / row["n"], GOOD_RANGE)}
        for r in RULES:
            on_good, on_bad = model[r]
            new[r] = (
                _within((row[f"hit_{r}"] or 0.0) / row[f"good_{r}"], ON_GOOD_RANGE) if row[f"good_{r}"] else on_good,
                _within((row[f"miss_{r}"] or 0.0) / row[f"bad_{r}"], ON_BAD_RANGE) if row[f"bad_{r}"] else on_bad,
            )
        moved = max(abs(x - y) for k in new for x, y in zip(_flat(new[k]), _flat(model[k]), strict=True))
        model = new
        if moved < TOLERANCE:
            break
    return model


def _within(x: float, bounds: tuple[float, float]) -> float:
    return min(max(x, bounds[0]), bounds[1])


def _flat(x) -> tuple:
    return x if isinstance(x, tuple) else (x,)


def query(docs: DataFrame) -> DataFrame:
    """op1: one row per document. Only the id and the text are read."""
    narrow = docs.select("doc_id", "text")
    feats = materialize(features(narrow).withColumn("doc_id", F.col("row.doc_id")).drop("row"), "quality-features")
    p = posterior(fit(feats))
    kept = ~F.col("base_failed") & (F.col("p_good") >= KEEP)
    figures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return feats.withColumn("p_good", p).select("doc_id", *figures, "base_failed", kept.alias("kept"), "p_good")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Votes are written for EM and made anew beside the texts: no copy of those."""
    model = fit(materialize(features(docs).drop("row"), "quality-features"))
    kept = ~F.col("base_failed") & (posterior(model) >= KEEP)
    # The id keeps the optimizer from pushing the filter through the features' projections, whose expressions it would repeat many times.
    judged = features(docs).select("row", kept.alias("kept"), F.monotonically_increasing_id().alias("at"))
    return judged.filter(F.col("kept") & (F.col("at") >= 0)).select("row.*")
