"""Left joins whose right side has hot keys.

AQE splits a hot key of the preserved side of a left join only. Where the
right side repeats a key so often that one task would read a large part of it,
``left_join`` finds such keys first, and treats the rows of these alone
differently: the right rows of a hot key are dealt to several salts, and each
left row of that key meets every salt. All other rows are joined as ever. Each
pair of rows still meets exactly once, so the fan-out is that of the plain join.

Without hot keys the plan is the plain join's, so several joins on the same
key keep sharing their partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.schema import quoted
from stocklens.session import materialize

# Names of columns that are added on the way.
_HEAVY, _SALTS, _SALT = "_heavy_rows", "_heavy_salts", "_heavy_salt"


def heavy_keys(right: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The keys of more than ``rows`` rows, with their number in ``_heavy_rows``; at most count / rows of them.

    A partial aggregate per task precedes the shuffle, so a hot key sends one row per task.
    """
    if rows < 1:
        raise ValueError("a key is hot from some number of rows on")
    counted = right.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count(F.lit(1)).alias(_HEAVY))
    known = [F.col(quoted(k)).isNotNull() for k in keys]
    out = counted.filter(F.col(_HEAVY) > rows)
    for k in known:
        out = out.filter(k)  # a null key joins with nothing
    return out


def _same(pairs: list[tuple[str, str]]) -> Column:
    out = None
    for one, two in pairs:
        here = F.col(quoted(one)) == F.col(quoted(two))
        out = here if out is None else out & here
    return out


def left_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], *, rows: int | None = None) -> DataFrame:
    """``left`` LEFT JOIN ``right`` on pairs of columns (left's, right's), which have distinct names.

    ``rows``: a key of the right side with more rows is split into parts of about so many; None never splits. Counting
    the right side's keys is a job of its own. The hot rows are written with their salts, so a task that is run
    again meets the same ones.
    """
    plain = left.join(right, _same(on), "left")
    if rows is None:
        return plain
    left_keys, right_keys = [a for a, _ in on], [b for _, b in on]
    heavy = heavy_keys(right, right_keys, rows)
    names = [f"_heavy_key_{k}" for k in range(len(on))]
    heavy = heavy.select(*[F.col(quoted(b)).alias(n) for b, n in zip(right_keys, names, strict=True)], F.ceil(F.col(_HEAVY) / rows).cast("int").alias(_SALTS))
    heavy = materialize(heavy, "heavy-keys")
    if heavy.isEmpty():
        return plain

    at_left = _same(list(zip(left_keys, names, strict=True)))
    at_right = _same(list(zip(right_keys, names, strict=True)))
    rest = left.join(heavy, at_left, "left_anti").join(right.join(heavy, at_right, "left_anti"), _same(on), "left")
    # the salt of a row is written, not worked out again: it depends on the row's place, so that equal rows part too
    hot = right.join(heavy, at_right).withColumn(_SALT, F.pmod(F.monotonically_increasing_id(), F.col(_SALTS)).cast("int"))
    hot = materialize(hot.select(*[quoted(c) for c in right.columns], _SALT), "heavy-rows")
    met = left.join(heavy, at_left).withColumn("_heavy_each", F.explode(F.sequence(F.lit(0), F.col(_SALTS) - 1)))
    met = met.select(*[quoted(c) for c in left.columns], "_heavy_each").join(hot, _same([*on, ("_heavy_each", _SALT)]))
    return rest.unionByName(met.drop("_heavy_each", _SALT))
