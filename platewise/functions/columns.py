"""Column helpers used by every operator.

Rounding.  A ratio of exact quantities (money sums, counts, day spans) is
rounded half away from zero on the *exact* rational value, the way
``ROUND(numeric, n)`` behaves in the source dialects: the division is done in
integer arithmetic on decimals, so no binary fraction decides a tie.  Only
genuinely blended results (standard deviations, scores, means of rates) go
through ``rounded``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schemas import ACCOUNT_TIERS

_INT = "decimal(38,0)"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cents(money: Column | str) -> Column:
    """Exact integer number of cents of a decimal money value."""
    return (_c(money) * 100).cast(_INT)


def money(value: Column | str) -> Column:
    """Output form of an exact money amount."""
    return _c(value).cast("double")


def ratio_units(num: Column | str, den: Column | str, digits: int) -> Column:
    """``num / den`` rounded half away from zero to ``digits`` decimals, times 10**digits.

    ``num`` and ``den`` must be integral (counts, cents, day numbers).  NULL
    when ``den`` is 0 or NULL, like ``x / NULLIF(den, 0)``.  Exact: with
    s = +1 when num/den >= 0 and -1 otherwise, the result is the quotient,
    truncated toward zero, of ``a = 2*num*10**digits + s*den`` by ``b = 2*den``,
    computed as ``(a - a % b) / b`` on decimal(38,0), so it stays exact up to
    about 10**32 (a long quotient would overflow on large money products).
    """
    n = _c(num).cast(_INT)
    d = F.nullif(_c(den).cast(_INT), F.lit(0).cast(_INT))
    s = F.when((n < 0) != (d < 0), F.lit(-1)).otherwise(F.lit(1))
    a = n * (2 * 10 ** digits) + s * d
    b = d * 2
    return ((a - a % b) / b).cast(_INT)


def ratio(num: Column | str, den: Column | str, digits: int) -> Column:
    """Exactly rounded ``num / den`` as a double (see :func:`ratio_units`)."""
    return ratio_units(num, den, digits).cast("double") / F.lit(float(10 ** digits))


def pct(num: Column | str, den: Column | str, digits: int) -> Column:
    """``ROUND(100.0 * num / NULLIF(den, 0), digits)`` on exact inputs."""
    return ratio(_c(num).cast(_INT) * 100, den, digits)


def rounded(x: Column | str, digits: int) -> Column:
    """Round a blended value half away from zero, also below zero, like ``ROUND`` of a NUMERIC.

    The value is taken to nine decimals first, so noise in the last binary
    places of a double, or a cut decimal fraction, doesn't decide a tie.
    """
    return F.round(_c(x).cast("decimal(38,9)"), digits).cast("double")


def exact_rate(num: Column | str, den: Column | str) -> Column:
    """``num / den`` of counts as a decimal with 18 places; NULL for a zero denominator."""
    return (_c(num).cast("decimal(20,0)").cast("decimal(38,18)")
            / F.nullif(_c(den).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))).cast("decimal(38,18)")


def as_long(x: Column | str) -> Column:
    return _c(x).cast("long")


def day(ts: Column | str) -> Column:
    """Calendar day of a timestamp (``ts::DATE``)."""
    return F.to_date(_c(ts))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Day boundaries crossed from ``start`` to ``end`` (``DATEDIFF('day', start, end)``)."""
    return F.datediff(day(end), day(start)).cast("long")


def month_start(ts: Column | str) -> Column:
    return F.trunc(day(ts), "month")


def quarter_start(ts: Column | str) -> Column:
    return F.trunc(day(ts), "quarter")


def month_index(later: Column | str, earlier: Column | str) -> Column:
    """Whole months from ``earlier`` to ``later`` (both month starts)."""
    a, b = _c(later), _c(earlier)
    return ((F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)).cast("long")


def date_lit(value: str | dt.date) -> Column:
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    return F.lit(value)


def ts_lit(value: str | dt.date) -> Column:
    """Midnight of a day as a TIMESTAMP_NTZ literal (compares with ``placed_at``)."""
    return date_lit(value).cast("timestamp_ntz")


def tier_rank(tier: Column | str) -> Column:
    """Declaration-order position of an account tier (smb < mid_market < enterprise)."""
    return F.array_position(F.array(*[F.lit(t) for t in ACCOUNT_TIERS]), _c(tier))
