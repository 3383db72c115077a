"""Column-level helpers (pure Catalyst expressions)."""

from stocklens.functions.arith import pct_diff, safe_div, share_pct, su_to_unit, unit_to_su

__all__ = ["pct_diff", "safe_div", "share_pct", "su_to_unit", "unit_to_su"]
