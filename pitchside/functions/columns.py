"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """N1: NaN means "missing" in the reference; in Spark ``NaN > 2.5`` is true, so make it NULL."""
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def inverse_or_null(c: Column) -> Column:
    """``1/x`` with zero (and NULL) odds giving NULL (ANSI-safe)."""
    return F.lit(1.0) / F.nullif(nan_to_null(c), F.lit(0.0))


def norm_match_key(home: Column, away: Column) -> Column:
    """P-08: ``lower(home) + " vs " + lower(away)``; a missing name reads "none"."""
    return F.concat(name_key(home), F.lit(" vs "), name_key(away))


def name_key(c: Column) -> Column:
    """``str(x).lower()`` of a team name (missing → "none")."""
    return F.lower(F.coalesce(c, F.lit("None")))


def pct_text(p: Column, decimals: int = 1) -> Column:
    """``f"{p*100:.{d}f}%"`` with Python's half-even rounding (bround before format)."""
    return F.format_string(f"%.{decimals}f%%", F.bround(p * 100, decimals))


def num_text(x: Column, decimals: int) -> Column:
    """``f"{x:.{d}f}"`` with half-even rounding."""
    return F.format_string(f"%.{decimals}f", F.bround(x, decimals))


def json_ascii(s: Column) -> Column:
    """Escape non-ASCII characters as ``\\uXXXX`` (Python ``json.dumps`` default output).

    Each character's UTF-16BE code units are hex-encoded, so characters
    outside the BMP become surrogate pairs exactly like ``json.dumps``.
    """
    chars = F.regexp_extract_all(s, F.lit("(?s)."), 0)

    def esc(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        return F.when(F.octet_length(ch) <= 1, ch).otherwise(
            F.regexp_replace(units, "(.{4})", "\\\\u$1"))

    return F.array_join(F.transform(chars, esc), "")
