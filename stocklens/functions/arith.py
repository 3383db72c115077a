"""NULL- and zero-safe arithmetic, written once as Column expressions.

Spark 4 runs with ANSI mode on, where ``x / 0`` raises. The comparison
expects division by zero to give NULL (a zero conversion factor or an empty
stock total is ordinary data), so every division goes through ``safe_div``
(``try_divide``). Everything here stays a Catalyst expression: no UDF, so it
is code-generated inside the scan/join stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: pseudo-base used when the baseline is zero but the candidate is
# not, so the percent difference stays finite.
ZERO_BASE = 0.01


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def safe_div(num, den) -> Column:
    """``num / den``; NULL when ``den`` is 0 or either side is NULL."""
    return F.try_divide(_c(num), _c(den))


def unit_to_su(units, factor) -> Column:
    """Physical units to normalised units."""
    return _c(units) * _c(factor)


def su_to_unit(su, factor) -> Column:
    """Normalised units to physical units (P4); NULL for a zero factor."""
    return safe_div(su, factor)


def pct_diff(cand, base) -> Column:
    """Zero-guarded percent difference of ``cand`` against ``base`` (P5).

    ===========  ==============  ==================================
    base         cand            result
    ===========  ==============  ==================================
    0            non-NULL, != 0  ``(cand - 0.01) / 0.01 * 100``
    0            0               0
    0 or NULL    NULL            NULL
    NULL         any             NULL
    != 0         any             ``(cand - base) / base * 100``
    ===========  ==============  ==================================

    ``cand <> 0`` is only TRUE for a non-NULL value, so no separate NOT NULL
    guard is needed.
    """
    cand, base = _c(cand), _c(base)
    eps = F.lit(ZERO_BASE)
    return (
        F.when((base == 0) & (cand != 0), (cand - eps) / eps * 100)
        .when((base == 0) & (cand == 0), F.lit(0.0))
        .otherwise(safe_div(cand - base, base) * 100)
    )


def share_pct(part, total) -> Column:
    """``part / total * 100`` as double; NULL for a zero total."""
    return safe_div(_c(part).cast("double"), _c(total).cast("double")) * 100
