"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are its words (A-Z lower-cased, hashed into ``WORDS`` columns
and weighted with their document frequencies over all documents), beside them its
character-class trigrams and a few bands of text statistics (length, repetition,
kinds of words); log counts, projected on the leading singular vectors of a
labelled sample, give its latent vector. Cosines
with every labelled vector are computed exactly, a block of documents at a
time, and the ``NEIGHBOURS`` nearest vote with a power of their similarity;
where the last of these has equals, all of them vote.

The labelled sample is bounded by ``SAMPLE`` rows, the ones with the smallest
MD5 of their id: a parameter, not a cut of what is scored. Broadcast are its
vectors, the projection and the words' weights: SAMPLE x RANK, TERMS x RANK and
WORDS numbers. The sample's terms come to the driver as lists of the columns
that a text has, and become rows a block at a time.

Null and empty texts have the terms of an empty text and are scored alike.
Labels that repeat for an id count as their largest. Rows without id are
scored and never learned from. Without labels of any kind the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm import hashing

SAMPLE = 4000
RANK = 64
NEIGHBOURS = 31
SHARPNESS = 16
THRESHOLD = 0.3
HELD_OUT_OF = 5
STEPS = 20
BLOCK = 256

CLASSES = 10
BANDS = 16
STATISTICS = 6
SHAPES = CLASSES**3 + BANDS * STATISTICS
WORDS = 1 << 12
TERMS = SHAPES + WORDS
SHAPE_WEIGHT = 2.0
WORD_WEIGHT = 2.0


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 128:
        return 9
    for k, group in enumerate(("\n", " \t\r\x0b\x0c", ".,;:'\"-", "!?", "|<>{}[]()/\\_"), start=3):
        if c in group:
            return k
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 8


_CLASS = bytes(_class_of(b) for b in range(256))


def _band(x: float) -> int:
    return min(BANDS - 1, max(0, int(x * BANDS)))


def _columns(raw: bytes) -> np.ndarray:
    """The column of every word."""
    return (hashing.mix(hashing.word_hashes(raw.lower().split())) & np.uint64(WORDS - 1)).astype(np.int64)


def word_weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every word column, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(WORDS, np.int64), 0
        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                sums[np.unique(_columns(t.as_py() or b""))] += 1
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(WORDS + 1)), "n": pa.array(np.append(sums, n))})  # the last: all documents

    counts = np.zeros(WORDS + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1e-3


def terms(text: bytes | None, weights: np.ndarray) -> np.ndarray:
    """Term weights of one text (UTF-8), of length 1; ``weights`` are those of the word columns."""
    raw = text or b""
    kind = np.frombuffer(b"\x04" + raw.translate(_CLASS) + b"\x04", np.uint8).astype(np.int32)
    grams = np.bincount(kind[:-2] * CLASSES**2 + kind[1:-1] * CLASSES + kind[2:], minlength=CLASSES**3) if len(kind) > 2 else np.zeros(CLASSES**3)
    counts = np.bincount(kind, minlength=CLASSES)
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeats = sum(map(bytes.__eq__, words[1:], words)) / n
    stats = (
        np.log2(len(words) + 1) / 16,
        1 - len(set(words)) / n,
        repeats,
        1 - len(set(lines)) / max(1, len(lines)),
        counts[1] / max(1, counts[:3].sum()),
        (counts[6] + counts[7] + counts[8]) / n / 2,
    )
    bands = np.zeros(BANDS * STATISTICS)
    for k, x in enumerate(stats):
        bands[k * BANDS + _band(x)] = 1
    share = np.log1p(1000 * grams / max(1, grams.sum()))
    said = np.log1p(np.bincount(_columns(raw), minlength=WORDS)) * weights
    said *= WORD_WEIGHT / max(1e-9, np.linalg.norm(said))
    out = np.concatenate([share / max(1e-9, np.linalg.norm(share)) * SHAPE_WEIGHT, bands, said])
    return (out / np.linalg.norm(out)).astype(np.float32)


@dataclass
class Model:
    project: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # RANK x labelled documents, columns of length 1
    labels: np.ndarray
    weights: np.ndarray  # of the word columns

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        latent = matrix @ self.project
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
        cosine = latent @ self.vectors
        k = min(NEIGHBOURS, cosine.shape[1])
        last = np.partition(cosine, -k, axis=1)[:, -k]
        row, near = np.nonzero(cosine >= last[:, None])
        weight = np.maximum(cosine[row, near], 1e-3).astype(np.float64) ** SHARPNESS
        sums = [np.bincount(row, x, minlength=len(cosine)) for x in (weight * self.labels[near], weight)]
        return sums[0] / sums[1]


def _packed(row: np.ndarray) -> tuple[bytes, bytes]:
    """The columns and values of a row that are not zero."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes(), row[at].astype("<f4").tobytes()


def _rows(packed: list[tuple[bytes, bytes]]) -> np.ndarray:
    out = np.zeros((len(packed), TERMS), np.float32)
    for k, (at, values) in enumerate(packed):
        out[k, np.frombuffer(at, "<u2")] = np.frombuffer(values, "<f4")
    return out


def _projected(packed: list[tuple[bytes, bytes]], basis: np.ndarray) -> np.ndarray:
    return np.concatenate([_rows(packed[at : at + BLOCK]) @ basis for at in range(0, len(packed), BLOCK)])


def _leading(packed: list[tuple[bytes, bytes]]) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start (twice as many vectors as are wanted)."""
    basis = np.random.default_rng(0).standard_normal((TERMS, 2 * RANK)).astype(np.float32)
    for _ in range(STEPS):
        turned = np.zeros_like(basis)
        for at in range(0, len(packed), BLOCK):
            block = _rows(packed[at : at + BLOCK])
            turned += block.T @ (block @ basis)
        basis, _ = np.linalg.qr(turned)
    _, _, turned = np.linalg.svd(_projected(packed, basis), full_matrices=False)
    return np.ascontiguousarray((basis @ turned.T)[:, :RANK])


def _remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model | None:
    """The model of a bounded sample of labelled documents that are not held out; None without any."""
    known = labels.filter(F.col("quality").isNotNull() & (_remainder(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)

    weights = word_weights(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values = zip(*(_packed(terms(t, weights)) for t in b.column(0).cast(pa.binary()).to_pylist()), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(values, pa.binary()), b.column(1)], ["at", "terms", "label"])

    # repeated ids: as many rows as the tables repeat them, so the sample is bounded again
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(run, "at binary, terms binary, label double")
    rows = rows.orderBy("at", "terms", "label").limit(sample).toPandas()
    if rows.empty:
        return None
    packed = list(zip(rows["at"], rows["terms"], strict=True))
    project = _leading(packed)
    latent = _projected(packed, project)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    return Model(project, np.ascontiguousarray(latent.T), rows["label"].to_numpy(), weights)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary()).to_pylist()
            out = np.full(len(texts), 0.5)
            for at in range(0, len(texts), BLOCK) if model else ():
                out[at : at + BLOCK] = model.scores(np.stack([terms(t, model.weights) for t in texts[at : at + BLOCK]]))
            out = np.clip(out, 0, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    held = F.coalesce(_remainder(F.col("doc_id")) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op4: learn on the one part, score all."""
    return score(docs, fit(docs, labels))
