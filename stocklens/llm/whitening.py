"""Embedding whitening by blockwise QR and a bidiagonal qd solver.

Every entry c of a vector becomes the whole number floor(64 * c) + 1,000,000.
The fit is on each distinct vector once.

1. Sums of the distinct vectors, exact, in whole numbers.
2. Blockwise QR: each task centres its vectors, a block at a time, and keeps
   the triangle R of all its blocks; triangles are stacked and reduced again
   until one is left. R'R is n times the covariance, which is never formed.
3. Householder reflections make R bidiagonal.
4. dqds finds the singular values of the bidiagonal with small relative errors.
   A shift is a guess of the smallest value from the last two entries, or, where
   that was too large, Newton's bound from below.
5. Twisted factorisations of the bidiagonal's square, at each squared singular
   value, give its vectors. Vectors of values that lie close together are made
   orthogonal, by inverse iteration where they are too alike.
6. The covariance of the whitened distinct vectors, merged from blocks centred on
   their own means, is compared with the identity.

Triangles and reflections are of the vectors' dimension, not of the number of
rows; the driver holds ``MOST_TRIANGLES`` of them at most.

Rows whose vector is null, empty, or holds a null or non-finite entry are left
out; null ids stay. Repeated vectors are fitted once and returned for every
row. Vectors of unequal length raise an error, as do entries of 2^34 or more.
A deviation is a decimal; op12 returns it as a long, or null where it does not
fit one (from some ten million distinct vectors on). A component without
variance (fewer distinct vectors than dimensions, constant entries) has a null
``whitened`` and is left out of ``identity_error``; without any variance,
``explained`` is null.
Components of equal variance are any orthonormal basis of their space. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.session import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 4096
MOST_TRIANGLES = 64  # on the driver
LARGEST = 1 << 40  # of 64 * c: sums of a batch fit a long

_EPS = float(np.finfo(float).eps)
CLOSE = 1e-3  # relative distance of values whose vectors are made orthogonal
MOST_STEPS = 200_000


# --- the bidiagonal, on one matrix of the vectors' dimension --------------------------


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: (a, b, v) with r = u * bidiagonal(a, b) * v', a the diagonal, b above it; u is not needed."""
    m = np.array(r, float)
    d = m.shape[1]
    v = np.eye(d)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        """The unit vector of the reflection that makes x a multiple of the first axis."""
        most = np.abs(x).max(initial=0.0)
        if most == 0 or not np.any(x[1:]):
            return None
        w = x / most
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = mirror(m[k:, k].copy())
        if w is not None:
            m[k:, k:] -= 2 * np.outer(w, w @ m[k:, k:])
        if k < d - 2:
            w = mirror(m[k, k + 1 :].copy())
            if w is not None:
                m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], bool, float]:
    """One transform: the new q and e, whether the shift was below the smallest value, and the sum of 1 / d."""
    n = len(q)
    nq, ne = [0.0] * n, [0.0] * (n - 1)
    d, inverse = q[0] - shift, 0.0
    for k in range(n - 1):
        if d < 0 or (d == 0 and shift > 0):
            return nq, ne, False, 0.0
        inverse += 1 / d if d else np.inf
        nq[k] = d + e[k]
        t = q[k + 1] / nq[k]
        ne[k] = e[k] * t
        d = d * t - shift
    nq[-1] = d
    return nq, ne, d >= 0, inverse + (1 / d if d > 0 else np.inf)


def _guess(q: list[float], e: list[float]) -> float:
    """The smaller value of the last two rows, a little less: near the smallest of all once e is small."""
    a, b, c = q[-2], q[-1], e[-1]
    trace, product = a + b + c, a * b
    root = np.sqrt(max(trace * trace - 4 * product, 0.0))
    small = 2 * product / (trace + root) if trace + root > 0 else 0.0
    return max(0.0, small * (1 - 2 * np.sqrt(c / (a + c) if a + c > 0 else 0.0)))


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the bidiagonal (a, b), in falling order, by dqds with deflation and splitting."""
    top = max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    if top == 0 or len(a) == 0:
        return np.zeros(len(a))
    q = [float(x) for x in (a / top) ** 2]
    e = [float(x) for x in (b / top) ** 2]
    found: list[float] = []
    parts = [(q, e, 0.0)]  # with what has been shifted away
    tiny = _EPS * _EPS
    steps = 0
    while parts:
        q, e, sigma = parts.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(sigma + q[0])
                break
            # an entry beside the diagonal that is nothing against its neighbours splits the matrix
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= tiny * (sigma + min(q[k], q[k + 1])) or e[k] < 1e-300), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # the small values belong at the end; turned round, the singular values are the same
                q, e = q[::-1], e[::-1]
            steps += 1
            if steps > MOST_STEPS:
                raise RuntimeError("dqds has not settled")
            shift = _guess(q, e)
            nq, ne, good, _ = _dqds(q, e, shift)
            if not good:
                _, _, _, inverse = _dqds(q, e, 0.0)
                shift = 1 / inverse * (1 - n * 4 * _EPS) if 0 < inverse < np.inf else 0.0
                nq, ne, good, _ = _dqds(q, e, shift)
                if not good:
                    shift = 0.0
                    nq, ne, _, _ = _dqds(q, e, 0.0)
                    nq[-1] = max(nq[-1], 0.0)
            q, e, sigma = nq, ne, sigma + shift
    return np.sort(np.array(found))[::-1] * top * top


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The vector of the bidiagonal's square at ``value``: from above and below to the place where they fit best."""
    n = len(a)
    floor = _EPS * _EPS * max(float(np.max(a * a)), 1e-300)
    diagonal, off = a * a, b / a[:-1]  # L D L'
    up, s = np.zeros(n - 1), np.zeros(n)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + diagonal[k]
        pivot = pivot if abs(pivot) > floor else np.copysign(floor, pivot)
        up[k] = diagonal[k] * off[k] / pivot
        s[k + 1] = up[k] * off[k] * s[k] - value
    down, p = np.zeros(n - 1), np.zeros(n)
    p[-1] = diagonal[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = diagonal[k] * off[k] * off[k] + p[k + 1]
        pivot = pivot if abs(pivot) > floor else np.copysign(floor, pivot)
        t = diagonal[k] / pivot
        down[k] = off[k] * t
        p[k] = p[k + 1] * t - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -up[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -down[k] * z[k]
    return z / np.linalg.norm(z)


def _solved(a: np.ndarray, b: np.ndarray, value: float, x: np.ndarray) -> np.ndarray:
    """(bidiagonal' bidiagonal - value) y = x, by elimination with row exchanges."""
    n = len(a)
    above = a[:-1] * b
    rows = np.zeros((n, 4))  # the entry under elimination, two beyond it, the right side
    whole = a * a - value
    whole[1:] += b * b
    least = _EPS * max(float((a * a).max()), float((b * b).max(initial=0)), 1e-200)
    rows[0] = [whole[0], above[0] if n > 1 else 0.0, 0.0, x[0]]
    for k in range(n - 1):
        below = np.array([above[k], whole[k + 1], above[k + 1] if k + 2 < n else 0.0, x[k + 1]])
        if abs(below[0]) > abs(rows[k, 0]):
            below, rows[k] = rows[k].copy(), below
        if abs(rows[k, 0]) < least:
            rows[k, 0] = least
        below = below - below[0] / rows[k, 0] * rows[k]
        rows[k + 1] = [below[1], below[2], 0.0, below[3]]
    if abs(rows[-1, 0]) < least:
        rows[-1, 0] = least
    y = np.zeros(n + 2)
    for k in range(n - 1, -1, -1):
        y[k] = (rows[k, 3] - rows[k, 1] * y[k + 1] - rows[k, 2] * y[k + 2]) / rows[k, 0]
        if abs(y[k]) > 1e200:  # only the direction matters
            y /= 1e200
            rows[:, 3] /= 1e200
    return y[:n]


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, wanted: int) -> np.ndarray:
    """The bidiagonal's right singular vectors of the first ``wanted`` squared values, as columns."""
    n = len(a)
    top = float(np.sqrt(values[0])) if len(values) and values[0] > 0 else 0.0
    out = np.zeros((n, wanted))
    if top == 0:
        return out
    # zeros on the diagonal are moved by less than rounding has moved them already
    a, b, values = a / top, b / top, values / (top * top)
    a = np.where(np.abs(a) < _EPS * _EPS, _EPS * _EPS, a)
    random = np.random.default_rng(7)
    for k in range(wanted):
        z = _twisted(a, b, values[k])
        first = k
        while first > 0 and values[first - 1] - values[k] <= CLOSE * values[k]:
            first -= 1
        near = out[:, first:k]
        if near.shape[1]:
            for attempt in range(6):
                before = np.linalg.norm(z)
                for _ in range(2):
                    z = z - near @ (near.T @ z)
                left = np.linalg.norm(z) / before
                if left > 0.1 and attempt:
                    break
                if left < 0.1:
                    z = random.standard_normal(n)
                    z -= near @ (near.T @ z)
                z = _solved(a, b, values[k], z / np.linalg.norm(z))
            for _ in range(2):
                z = z - near @ (near.T @ z)
        out[:, k] = z / np.linalg.norm(z)
    return out


def components_of(r: np.ndarray, n: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The variances (all) and the unit directions (the first ``wanted``, as columns) of the rows behind the triangle."""
    a, b, v = bidiagonalise(r)
    values = squared_singular_values(a, b)
    w = right_vectors(a, b, values, wanted)
    return values / n, v @ w


# --- over all rows --------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """Number and sums of the distinct vectors, variances, directions (dimension x components)."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    directions: np.ndarray
    identity_error: float | None


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """A batch of lists of one length as a matrix."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and ``x``, the vector in whole numbers, of the rows that have a vector of finite entries."""
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = v.filter(F.coalesce(F.size("v") > 0, F.lit(False))).filter(finite)

    def entry(c):
        fits = F.abs(c) * SCALE < LARGEST
        return F.when(fits, F.floor(F.when(fits, c) * SCALE).cast("long") + OFFSET).otherwise(F.raise_error(F.concat(F.lit("an entry is too large to be whitened: "), c.cast("string"))).cast("long"))

    return v.select("vec_id", F.transform("v", entry).alias("x"))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n. The difference is taken in whole numbers, so that a large common part costs no digits."""
    whole, rest = np.divmod(sums, n)
    return (x - whole).astype(float) - rest / n


def _totals(distinct: DataFrame) -> tuple[int, np.ndarray] | None:
    """Number and sums of the fit's vectors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for b in batches:
            x = _matrix(b.column(0), np.int64)
            if len(x):
                n, sums = n + len(x), x.sum(axis=0).astype(object) + sums
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([sums.tolist()], pa.list_(pa.int64()))})

    parts = distinct.select("x").mapInArrow(part, "n long, sums array<long>")
    each = parts.select("n", F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    rows = sorted(each.collect())
    return (rows[0]["n"], np.array([r["value"] for r in rows], np.int64)) if rows else None


def _triangle(distinct: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred fit: R'R is their scatter."""
    d = len(sums)

    def reduced(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, rows]), mode="r")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, any_row = np.zeros((0, d)), False
        for b in batches:
            x = _matrix(b.column(0), np.int64)
            for at in range(0, len(x), BLOCK_ROWS):
                r, any_row = reduced(r, _centred(x[at : at + BLOCK_ROWS], n, sums)), True
        if any_row:
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, any_row = np.zeros((0, d)), False
        for b in batches:
            for raw in b.column(0):
                r, any_row = reduced(r, np.frombuffer(raw.as_buffer()).reshape(-1, d)), True
        if any_row:
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary())})

    parts = distinct.select("x").mapInArrow(part, "r binary")
    r = np.zeros((0, d))
    for row in parts.repartition(MOST_TRIANGLES).mapInArrow(merge, "r binary").toLocalIterator():
        r = reduced(r, np.frombuffer(row["r"]).reshape(-1, d))
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r[:d]


def _identity_error(distinct: DataFrame, n: int, sums: np.ndarray, weights: np.ndarray) -> float | None:
    """The largest absolute entry of the whitened fit's covariance minus the identity."""
    k = weights.shape[1]
    if k == 0:
        return None

    def joined(one: tuple, two: tuple) -> tuple:
        """Number, mean and scatter about the mean of both."""
        (m, u, s), (o, w, t) = one, two
        gap = w - u
        return m + o, u + gap * (o / (m + o)), s + t + np.outer(gap, gap) * (m * o / (m + o))

    def sent(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"n": pa.array([x[0]], pa.int64()), "m": pa.array([x[1].tobytes() + x[2].tobytes()], pa.binary())})

    def got(size: int, raw: bytes) -> tuple:
        flat = np.frombuffer(raw)
        return size, flat[:k], flat[k:].reshape(k, k)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            x = _matrix(b.column(0), np.int64)
            for at in range(0, len(x), BLOCK_ROWS):
                z = _centred(x[at : at + BLOCK_ROWS], n, sums) @ weights
                mean = z.mean(axis=0)
                mine = (len(z), mean, (z - mean).T @ (z - mean))
                held = mine if held is None else joined(held, mine)
        if held:
            yield sent(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for size, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = got(size, raw) if held is None else joined(held, got(size, raw))
        if held:
            yield sent(held)

    schema, held = "n long, m binary", None
    for row in distinct.select("x").mapInArrow(part, schema).repartition(MOST_TRIANGLES).mapInArrow(merge, schema).toLocalIterator():
        mine = got(row["n"], bytes(row["m"]))
        held = mine if held is None else joined(held, mine)
    return float(np.abs(held[2] / n - np.eye(k)).max())


def fit(vectors: DataFrame, *, components: int = COMPONENTS) -> Fit | None:
    """The whitening of ``whole_vectors``; None without rows."""
    lengths = [r["d"] for r in vectors.select(F.size("x").alias("d")).groupBy("d").count().orderBy("d").limit(2).collect()]
    if not lengths:
        return None
    if len(lengths) > 1:
        raise ValueError(f"vectors of unequal length, such as {lengths[0]} and {lengths[1]}, cannot be whitened together")
    distinct = materialize(vectors.select("x").distinct(), "distinct-vectors")
    n, sums = _totals(distinct)
    wanted = min(components, len(sums))
    variances, directions = components_of(_triangle(distinct, n, sums), n, wanted)
    # rounding leaves about this much variance where there is none
    none = variances[0] * (_EPS * max(len(sums), 64)) ** 2 if variances[0] > 0 else 0.0
    variances = np.where(variances > none, variances, 0.0)
    some = int((variances[:wanted] > 0).sum())
    error = _identity_error(distinct, n, sums, directions[:, :some] / np.sqrt(variances[:some]))
    return Fit(n, sums, variances, directions, error)


def whitened(vectors: DataFrame, model: Fit) -> DataFrame:
    """vec_id, n, deviation, and ``z``, the whitened components (null without variance), of every row."""
    n, sums = model.n, model.sums
    k = model.directions.shape[1]
    some = int((model.variances[:k] > 0).sum())
    weights = model.directions[:, :some] / np.sqrt(model.variances[:some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), np.int64)
            if not len(x):
                continue
            whole, rest = np.divmod(sums, n)
            gaps = x - whole  # n * x - sums = n * gaps - rest
            most = n * int(np.abs(gaps).max()) + n
            if most * most * x.shape[1] < 1 << 63:
                deviation = pa.array(((gaps * n - rest) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                own, left = gaps.tolist(), rest.tolist()
                deviation = pa.array([Decimal(sum((n * g - r) ** 2 for g, r in zip(row, left, strict=True))) for row in own], pa.decimal128(38, 0))
            z = (gaps.astype(float) - rest / n) @ weights
            lists = [[*row, *[None] * (k - some)] for row in z.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), deviation, pa.array(lists, pa.list_(pa.float64()))], ["vec_id", "deviation", "z"])

    return vectors.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), z array<double>")


def query(embeddings: DataFrame) -> DataFrame:
    """op12: a row for every vector and component."""
    vectors = materialize(whole_vectors(embeddings), "whole-vectors")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    total = float(model.variances.sum())
    shares = F.array(*[F.lit(float(e) / total if total else None).cast("double") for e in model.variances[: model.directions.shape[1]]])
    rows = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("z").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
