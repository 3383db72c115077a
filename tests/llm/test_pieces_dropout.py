"""Merge-dropout: every occurrence is dealt its own segmentation; blocks of units against one unit at a time."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from stocklens.llm import mixing, pieces

UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n+")
TEXTS = [
    "therefore international considerations " * 40, "", None, " leading  spaces\n\n\nand lines \n é▁漢字😀 x", "a" * 300 + " " + "antidisestablishment" * 9,
    "x", "\n", "   ", "ein Wörterbuch für Donaudampfschifffahrtsgesellschaften", "therefore " * 30, "q▁" * 20,
]


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(open(pieces.MODEL, "rb").read())


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_blocks_as_unit_by_unit(vocab, dropout, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_UNITS", 7)
    flat, counts = pieces.encode_all(TEXTS, range(len(TEXTS)), vocab, seed=5, dropout=dropout)
    want = []
    for k, text in enumerate(TEXTS):
        mine = b""
        for at, unit in enumerate(UNIT.findall(" " + text) if text else []):
            parts = pieces._merge_short(unit, vocab.scores, pieces._key(unit, seed=5, variant=k, at=at), round(dropout * 65536))
            mine += b"".join(vocab.packed.get(t) or b"".join(vocab.packed_bytes[x] for x in t.encode()) for t in parts)
        assert counts[k] == len(mine) // 2
        want.append(mine)
    assert flat.tobytes() == b"".join(want)


def _segmentations(vocab, ids):
    """The segmentations of the units of a text that repeats one word."""
    out, unit, text = [], [], b""
    for i in ids:
        if vocab.raw[i].startswith(b" ") and text:
            out.append(tuple(unit))
            unit = []
        unit.append(i)
        text += vocab.raw[i]
    return {*out, tuple(unit)}


def test_occurrences_differ_inside_a_document_and_between(vocab):
    text = "internationalisation " * 50
    inside = _segmentations(vocab, pieces.encode(text, vocab, seed=17, variant=1, dropout=0.1).tolist())
    assert len(inside) > 2
    many = {tuple(pieces.encode("internationalisation", vocab, seed=17, variant=pieces._variant(i, 0), dropout=0.1).tolist()) for i in range(200)}
    assert len(many) > 2
    # nor do decisions repeat along a long unit
    ids = pieces.encode("ab" * 113 * 8, vocab, seed=17, variant=3, dropout=0.5)
    spelt = [pieces.decode(x, vocab) for x in (ids[:40], ids[-40:])]
    assert spelt[0] != spelt[1]
    sizes = [len(vocab.raw[i]) for i in ids]
    ends = {sum(sizes[:k]) for k in range(len(sizes))}
    assert {e % 226 for e in ends if e < 452} != {e % 226 for e in ends if 904 <= e < 1356}


def test_copies_of_the_mix_differ(spark, vocab):
    rows = [(k, "internationalisation of considerations " * 20, "en", "a" if k < 3 else "b") for k in range(3)] + [(k, f"word{k} " * 400, "en", "b") for k in range(3, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.mix(docs, number="copy")
    assert mix.columns == [*docs.columns, "copy"]
    seen = [(r.doc_id, r.copy) for r in mix.collect()]
    assert len(seen) == len(set(seen)) and max(c for _, c in seen) == 1
    stage = corpus_pipeline.encode(spark, corpus_pipeline.mix(spark, docs, ""), "").collect()
    twice = [[tuple(r.pieces) for r in stage if r.doc_id == i] for i, c in seen if c == 1 and i < 3]
    assert twice and all(len(set(x)) == len(x) == 2 for x in twice)
