"""Scalar rules where engines disagree, kept in one place.

Each helper returns a Column expression: everything stays JVM-side and inside
whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operands of an exact division: 18 digits before the point, 9 after it.
DIV_OPERAND = "decimal(27,9)"
# Sums of measures keep this many decimals (their columns are doubles, read
# as the decimal number they print as, never cut to the result's scale).
MEASURE = "decimal(28,9)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_to_int(x) -> Column:
    """``x::int`` for fractions (F10): round half away from zero, then cast.

    Spark's plain cast truncates (2.5 -> 2); ``round`` is HALF_UP on the
    decimal value, so 2.5 -> 3 and -2.5 -> -3.
    """
    return F.round(_c(x)).cast("int")


def divide(num, den, scale: int = 8, lenient: bool = False) -> Column:
    """``num / den`` rounded once, HALF_UP on the true quotient, to ``scale``
    decimals (F11, F8): decimal(28+scale, scale).

    Spark's own decimal division rounds to an intermediate scale, and rounding
    that again can turn 0.004999... into 0.01.  Here the quotient at ``scale``
    is found as a whole number: twice the shifted numerator plus the divisor,
    less its remainder, over twice the divisor divides without a rest.
    Operands have up to 18 digits before the point and 9 after it; beyond that
    the cast raises.  A zero divisor raises under ANSI mode (the default);
    ``lenient`` gives NULL instead.
    """
    n, d = _c(num).cast(DIV_OPERAND), _c(den).cast(DIV_OPERAND)
    if lenient:
        d = F.nullif(d, F.lit(0).cast(DIV_OPERAND))
    twice = F.lit(Decimal(2 * 10**scale)).cast(f"decimal({scale + 1},0)")
    two_d = (F.abs(d) * F.lit(Decimal(2)).cast("decimal(1,0)")).cast("decimal(28,9)")
    top = (F.abs(n) * twice + F.abs(d)).cast("decimal(37,9)")
    whole = ((top - top % two_d) / two_d).cast("decimal(28,0)")
    unit = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({max(scale, 1)},{scale})")
    q = whole * unit if scale else whole
    return F.when((n < 0) != (d < 0), -q).otherwise(q).cast(f"decimal({28 + scale},{scale})")


def months_before(as_of, months: int) -> Column:
    """``dateadd('mm', -n, as_of)`` keeping the time of day.

    ``add_months`` drops the time of day, so interval arithmetic is used.
    ``as_of`` is a ``datetime``/``str`` literal or a timestamp Column.
    """
    if isinstance(as_of, (str, _dt.datetime, _dt.date)):
        text = as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ") if isinstance(as_of, _dt.datetime) else as_of.isoformat()
        ts = F.lit(text).cast("timestamp_ntz")
    else:
        ts = as_of
    return ts - F.expr(f"INTERVAL {int(months)} MONTH")


def days_between(start, end) -> Column:
    """``DATEDIFF(DAY, start, end)`` (F7): whole days from start to end."""
    return F.date_diff(_c(end), _c(start))


def hour_of(ts) -> Column:
    """``DATE_PART('HH', ts)``."""
    return F.hour(_c(ts))


def to_char_thousands(n) -> Column:
    """``TO_CHAR(n, '999,999,999')`` (F13) with Spark's own ``to_char``:
    grouped digits, blank-padded to 11, ``#`` on overflow, NULL stays NULL."""
    return F.to_char(_c(n).cast("decimal(18,0)"), F.lit("999,999,999"))
