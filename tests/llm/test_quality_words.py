"""Documents of one shape whose fault lies in their words."""

from __future__ import annotations

import random

from stocklens.llm import quality_classifier


def test_words_tell_texts_of_one_shape(spark):
    good, bad = ("stone", "river", "north", "paper", "light", "water", "green", "field"), ("cheap", "pills", "bonus", "prize", "click", "loans", "deals", "spins")
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(bad if k % 2 else good) for _ in range(60)) + ".") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, quality int")
    got = quality_classifier.query(docs, labels).collect()
    assert len(got) == 120 and all(x.predicted == 1 - x.doc_id % 2 for x in got)
