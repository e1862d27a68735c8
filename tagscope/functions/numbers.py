"""Number rounding and text forms used at export (COL2-3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the reference's default number of decimals.
DEFAULT_ROUND = 2


def parse_round(r, default: int = DEFAULT_ROUND) -> int:
    """A round parameter as given in a request; bad text falls back to the default."""
    try:
        return int(str(r).strip())
    except (TypeError, ValueError):
        return default


def round_half_away(v: Column, r: int = DEFAULT_ROUND) -> Column:
    """``round(v * 10^r) / 10^r`` with halves away from zero on the scaled
    binary value (so 1.005 -> 1.0 as in Go, not 1.01 as ``F.round(v, 2)``)."""
    scale = float(10 ** r)
    return F.round(v * F.lit(scale), 0) / F.lit(scale)


def plain_text(v: Column) -> Column:
    """Shortest plain decimal text of a double (no exponent): 1.2E7 -> 12000000."""
    d = v.cast("string").try_cast("decimal(38,18)").cast("string")
    d = F.regexp_replace(d, r"(\.[0-9]*?)0+$", "$1")
    d = F.regexp_replace(d, r"\.$", "")
    return (F.when(F.isnan(v), F.lit("NaN"))
            .when(v == F.lit(float("inf")), F.lit("+Inf"))
            .when(v == F.lit(float("-inf")), F.lit("-Inf"))
            .otherwise(d))


def decimal_comma(v: Column) -> Column:
    """COL3: plain text with ``,`` as the decimal mark."""
    return F.translate(plain_text(v), ".", ",")
