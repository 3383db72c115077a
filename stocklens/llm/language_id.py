"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector. A letter trigram is bound from its
letters' vectors, permuted by position and multiplied; a document is the bundle
(sum) of its trigrams; a language is the bundle of its training documents. The
prediction is the language whose profile has the largest cosine.

Every code point has a vector of its own, drawn from its number, so scripts of
any size have distinct letters.

Bundles are linear, so trigrams are counted first and the counts multiplied by
the trigram vectors, for a block of documents and ``KINDS`` trigrams at a time. Profiles are integer
sums: the same in whatever order they are added. What is broadcast is one
vector of ``DIMENSIONS`` integers per language.

Null text and text without letters are ``und`` with score 0, and so is every
text if there is nothing to learn from. Rows without id are never learned
from and never held out. Equal cosines: the first language by code point wins.
Rows that repeat count each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 20240607
BLOCK_DOCS, BLOCK_CHARS = 256, 1_000_000
KINDS = 4096  # trigrams whose vectors are held at once
HELD_LETTERS = 1 << 14
HELD_OUT_OF, HELD_OUT = 4, 2


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class _Letters(dict):
    """The vector of a code point, drawn from its number; 0 stands for any run of other characters."""

    def __missing__(self, code: int) -> np.ndarray:
        if len(self) >= HELD_LETTERS:
            self.clear()
        v = self[code] = np.random.default_rng([SEED, code]).choice(np.array([-1, 1], np.int8), DIMENSIONS)
        return v


_LETTERS = _Letters()


def letters(text: str | None) -> np.ndarray:
    """Code points of a text's letters in lower case, a 0 for what lies between, before and after them; empty without letters."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.concatenate(([0], np.where(_is_letter()[codes], codes, 0), [0])).astype(np.uint32)
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    return codes if len(codes) > 2 else codes[:0]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Blocks of documents: first row, rows, and, for ``KINDS`` trigrams at a time, their counts by document and their vectors."""
    at = 0
    while at < len(texts):
        own, chars = [], 0
        while at + len(own) < len(texts) and len(own) < BLOCK_DOCS and chars < BLOCK_CHARS:
            own.append(letters(texts[at + len(own)]))
            chars += len(own[-1])
        yield at, len(own), _bundles(own)
        at += len(own)


def _bundles(own: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    codes = np.concatenate(own)
    if not len(codes):
        return
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    present = np.flatnonzero(np.bincount(codes))
    number = np.zeros(present[-1] + 1, np.int64)
    number[present] = np.arange(len(present))
    n, place = len(present), number[codes]
    inside = row[:-2] == row[2:]
    grams, row = (place[:-2] * n * n + place[1:-1] * n + place[2:])[inside], row[:-2][inside]
    if n**3 <= 1 << 22:
        seen = np.zeros(n**3, bool)
        seen[grams] = True
        kinds, index = np.flatnonzero(seen), (np.cumsum(seen) - 1)[grams]
    else:
        kinds, index = np.unique(grams, return_inverse=True)
    order = np.argsort(index // KINDS, kind="stable") if len(kinds) > KINDS else np.arange(len(index))
    row, index = row[order], index[order]
    vectors = np.stack([_LETTERS[c] for c in present.tolist()])
    for first in range(0, len(kinds), KINDS):
        some = kinds[first : first + KINDS]
        lo, hi = np.searchsorted(index // KINDS, [first // KINDS, first // KINDS + 1])
        counts = np.bincount(row[lo:hi] * len(some) + index[lo:hi] - first, minlength=len(own) * len(some)).reshape(len(own), len(some))
        yield counts, np.roll(vectors, 2, axis=1)[some // n**2] * np.roll(vectors, 1, axis=1)[some // n % n] * vectors[some % n]


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profile per language, from documents with a language that are not held out."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(DIMENSIONS, np.int64))
        for b in batches:
            langs, texts = b.column(1).to_pylist(), b.column(0).to_pylist()
            for at, n, parts in _blocks(texts):
                mine = np.array(langs[at : at + n])
                for counts, vectors in parts:
                    for lang in np.unique(mine):
                        sums[str(lang)] += np.rint(counts[mine == lang].sum(axis=0).astype(np.float64) @ vectors.astype(np.float64)).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "profile": [v.tolist() for v in sums.values()]})

    rows = (
        docs.filter((_remainder(F.col("doc_id")) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("text", "lang")
        .mapInArrow(bundle, "lang string, profile array<long>")
        .select("lang", F.posexplode("profile"))
        .groupBy("lang", "pos")
        .agg(F.sum("col").alias("v"))
        .groupBy("lang")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("profile"))
        .orderBy("lang")
        .collect()
    )
    return {r["lang"]: np.array(r["profile"], np.float64) for r in rows}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    langs = [k for k, v in profiles.items() if v.any()]
    unit = np.stack([profiles[k] / np.linalg.norm(profiles[k]) for k in langs]).astype(np.float32).T if langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            pred, score = np.full(len(texts), -1), np.zeros(len(texts))
            for at, n, parts in _blocks(texts) if langs else ():
                bundles, some = np.zeros((n, DIMENSIONS), np.float32), np.zeros(n, bool)
                for counts, vectors in parts:
                    bundles += counts.astype(np.float32) @ vectors.astype(np.float32)
                    some |= counts.any(axis=1)
                norm = np.linalg.norm(bundles, axis=1)
                cosine = (bundles @ unit) / np.maximum(norm, 1e-9)[:, None]
                pred[at : at + n] = np.where(some, cosine.argmax(axis=1), -1)
                score[at : at + n] = np.where(some, np.clip(cosine.max(axis=1), 0, 1), 0)
            names = [langs[k] if k >= 0 else "und" for k in pred]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(_remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    """op6: learn on the one part, predict all."""
    return predict(docs, learn(docs))
