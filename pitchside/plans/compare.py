"""Order-insensitive comparison of a Spark result with a DuckDB result (tests and tools)."""

from __future__ import annotations

import math


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits is not None else v
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canonical(cols, rows, digits=None):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(scols, srows, ocols, orows, digits=9):
    """(ok, exact, message)."""
    if sorted(scols) != sorted(ocols):
        return False, False, f"columns differ: spark-only {sorted(set(scols) - set(ocols))}, " \
                             f"sql-only {sorted(set(ocols) - set(scols))}"
    if len(srows) != len(orows):
        return False, False, f"row counts differ: {len(srows)} vs {len(orows)}"
    exact = canonical(scols, srows) == canonical(ocols, orows)
    a, b = canonical(scols, srows, digits), canonical(ocols, orows, digits)
    if a != b:
        sa, sb = set(a), set(b)
        return False, False, f"values differ, e.g. spark {list(sa - sb)[:1]} sql {list(sb - sa)[:1]}"
    return True, exact, "ok"
