"""Row-level expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.fixed_values import (
    BOARD_PREFIXES,
    BOARD_SUFFIXES,
    DATE_FORMATS,
    EPS,
    TRUE_SPELLINGS,
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, so aggregates skip them."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(0.0))


def over(a: Column | str, b: Column | str) -> Column:
    """Ratio with the standing guard in the denominator."""
    return F.try_divide(col(a), col(b) + F.lit(EPS))


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Like :func:`over`, with a zero denominator giving NULL."""
    return F.try_divide(col(a), zero_to_null(b) + F.lit(EPS))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Aggregate correlation of columns without NULLs; NULL when a side is constant.

    Written out, because the built-in one divides by zero there.
    """
    return F.try_divide(F.covar_pop(col(a), col(b)), F.stddev_pop(col(a)) * F.stddev_pop(col(b)))


def clip(c: Column | str, lo: Column | float, hi: Column | float) -> Column:
    """Clamp; NULL stays NULL."""
    c = col(c)
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def clean_and_clip(c: Column | str, bound: float = 1e6) -> Column:
    """Non-finite or missing values become 0, the rest is clamped to ``+/-bound``."""
    return clip(F.coalesce(finite(c), F.lit(0.0)), -bound, bound)


def reported(c: Column | str, digits: int = 9) -> Column:
    """A value at reporting precision: ``digits`` decimals, then single precision.

    The feature store holds single-precision numbers; results are compared and
    exported at that precision so they do not depend on summation order.
    """
    return F.round(col(c), digits).cast("float").cast("double") + F.lit(0.0)


def parse_date_flexible(c: Column | str) -> Column:
    """First of the accepted spellings that fits, per value; NULL if none does."""
    text = F.trim(col(c))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def flag_value(c: Column | str) -> Column:
    """1 for a raised flag, 0 for anything else including unknown spellings."""
    return F.when(col(c).cast("string").isin(*TRUE_SPELLINGS), 1).otherwise(0)


def board(code: Column | str) -> Column:
    """Listing board from code prefix and exchange suffix."""
    code = col(code)
    prefix = F.substring_index(code, ".", 1)
    suffix = F.when(code.contains("."), F.upper(F.substring_index(code, ".", -1))).otherwise(F.lit(""))
    out = F
    for name, (exchange, starts) in BOARD_PREFIXES.items():
        hit = (suffix == exchange) & F.substring(prefix, 1, 3).isin(*starts)
        out = out.when(hit, name)
    for name, suffixes in BOARD_SUFFIXES.items():
        out = out.when(suffix.isin(*suffixes), name)
    return out.otherwise("OTHER")


def short_code(code: Column | str) -> Column:
    """Code with a shortened exchange suffix, as some flag files spell it."""
    code = F.regexp_replace(col(code), r"\.XSHE$", ".XS")
    return F.regexp_replace(code, r"\.XSHG$", ".XSH")
