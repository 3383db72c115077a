"""Vectorised hashes of words and of runs of words, and a bounded sketch of what occurs twice."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

KEPT_WORDS = 200_000
#: Binary logarithms: most cells of each of a sketch's two rows; cells of a slice, the unit in which partial sketches are
#: merged and the least that a row has; cells for a key.
SKETCH_BITS, SLICE_BITS, SPARE_BITS = 26, 20, 3
FLUSH = 2_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S31, _S27, _S29 = np.uint64(31), np.uint64(27), np.uint64(29)


class _Words(dict):
    """Hash of a word; forgets all when it holds ``KEPT_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S31)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S29)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive words: runs of powers of two, doubled, then joined."""
    done, out = 0, None
    power, part = 1, words
    while True:
        if size & power:
            if out is None:
                out = part
            else:  # the runs so far, then one of this power
                n = min(len(out), len(part) - done)
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = mix(out[:n] * _A + part[done : done + n] + np.uint64(power))
            done += power
        power *= 2
        if power > size:
            break
        if len(part) <= power // 2:
            return np.zeros(0, np.uint64)
        part = mix(part[: len(part) - power // 2] * _A + part[power // 2 :] + np.uint64(power * 2 + 1))
    return out[: max(0, len(words) - size + 1)]


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Smallest of every ``size`` consecutive values."""
    if len(x) < size:
        return x[:0]
    step, out = 1, x
    while step * 2 <= size:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = size - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def bits_for(keys: int) -> int:
    """The size of a sketch of so many keys."""
    return min(SKETCH_BITS, max(SLICE_BITS, int(keys).bit_length() + SPARE_BITS))


def _cells(keys: np.ndarray, bits: int) -> np.ndarray:
    """Cell numbers of both rows, the second row's after the first's."""
    mask = np.uint64((1 << bits) - 1)
    second = (mix(keys + _A) & mask) + np.uint64(1 << bits)
    return np.concatenate([keys & mask, second]).astype(np.uint32)


def pack(x: np.ndarray) -> bytes:
    """Small 32-bit numbers, compressed: first all lowest bytes, then the next ones, which are mostly zero."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _partial(keys: list[np.ndarray], bits: int) -> pa.RecordBatch:
    cells, counts = np.unique(_cells(np.concatenate(keys), bits), return_counts=True)
    slices = cells >> SLICE_BITS
    starts = np.flatnonzero(np.concatenate(([True], slices[1:] != slices[:-1])))
    ends = np.append(starts[1:], len(cells))
    low, more = cells & np.uint32((1 << SLICE_BITS) - 1), (counts > 1).astype(np.uint32)
    steps = [pack((np.diff(low[a:b], prepend=np.uint32(0)) << np.uint32(1)) | more[a:b]) for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_pydict({"slice": slices[starts].astype(np.int32), "cells": steps})


def seen(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], *, least: tuple[int, ...], bits: int = SKETCH_BITS) -> list[np.ndarray]:
    """Count-min sketch, counts kept up to two: for each of ``least`` (2 or 1) a bit per cell, whether it was counted so often.

    ``keys_of`` gives arrays of 64-bit keys from a batch. Each task sends its cells by slice, as steps from one
    to the next; slices are
    merged where they meet, a batch at a time, in a fixed array. A bitmap has 16 MB at most, less with ``bits_for`` the
    number of keys.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for keys in keys_of(b):
                held.append(keys)
                n += len(keys)
                if n >= FLUSH:
                    yield _partial(held, bits)
                    held, n = [], 0
        if n:
            yield _partial(held, bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                into = counts.setdefault(k, np.zeros(1 << SLICE_BITS, np.uint8))
                steps = unpack(raw.as_buffer())
                at, more = np.cumsum(steps >> np.uint32(1), dtype=np.int64), (steps & np.uint32(1)).astype(np.uint8)
                into[at] = np.minimum(into[at] + 1 + more, 2)  # a partial sketch has a cell once
        for k, v in counts.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "cells": [b"".join(np.packbits(v >= n).tobytes() for n in least)]})

    schema = "slice int, cells binary"
    merged = rows.mapInArrow(sketch, schema).repartition("slice").mapInArrow(merge, schema).collect()
    out = np.zeros((len(least), (2 << bits) >> SLICE_BITS, (1 << SLICE_BITS) // 8), np.uint8)
    for r in merged:
        out[:, r["slice"]] = np.frombuffer(r["cells"], np.uint8).reshape(len(least), -1)
    return [x.reshape(-1) for x in out]


def seen_twice(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], *, least: int = 2, bits: int = SKETCH_BITS) -> np.ndarray:
    """One bitmap of ``seen``."""
    return seen(rows, keys_of, least=(least,), bits=bits)[0]


def maybe_twice(sketch: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may have been counted as often as the sketch asks: always true where it was."""
    cells = _cells(keys, len(sketch).bit_length() + 1)  # two rows, eight cells a byte
    hit = (sketch[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1
    return (hit[: len(keys)] & hit[len(keys) :]).astype(bool)
