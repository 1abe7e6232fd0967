"""Exact-arithmetic helpers.

Money stays DECIMAL until the last step; averages are formed as
``sum / count`` in double (the same IEEE division in every engine) and pass
through DECIMAL(38,10) before rounding, so half-up rounding is decided on the
decimal value and binary noise below 1e-10 is absorbed.  Durations are summed
as whole seconds (BIGINT, exact) and divided once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400
SECONDS_PER_HOUR = 3600


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, digits: int = 2) -> Column:
    """Round half-up on the decimal value, return DOUBLE."""
    return F.round(col_(c).cast("double").cast("decimal(38,10)"), digits).cast("double")


def money(c) -> Column:
    """A DECIMAL money value (sum or single) as a DOUBLE rounded to cents."""
    return F.round(col_(c), 2).cast("double")


def ratio(num, den) -> Column:
    """num / den in double; NULL when den is 0 or NULL."""
    return col_(num).cast("double") / F.nullif(col_(den).cast("double"), F.lit(0.0))


def mean(c) -> Column:
    """Aggregate: sum / count of non-null values, in double (NULL if none)."""
    x = col_(c)
    return ratio(F.sum(x), F.count(x))


def pct(num, den) -> Column:
    return ratio(col_(num).cast("double") * F.lit(100.0), den)


def share_if(cond: Column) -> Column:
    """Aggregate: percentage of rows where ``cond`` is true; NULL conds count
    as false and stay in the denominator (pandas ``(x == v).mean()``)."""
    return pct(F.count_if(F.coalesce(cond, F.lit(False))), F.count(F.lit(1)))


def seconds_between(start, end) -> Column:
    """Whole seconds from ``start`` to ``end`` (NULL if either is NULL)."""
    return F.timestamp_diff("SECOND", col_(start), col_(end))


def days_from_seconds(sec) -> Column:
    return col_(sec).cast("double") / F.lit(float(SECONDS_PER_DAY))


def mean_days(sec) -> Column:
    """Aggregate: mean of a seconds column, expressed in days."""
    x = col_(sec)
    return ratio(F.sum(x), F.count(x) * F.lit(SECONDS_PER_DAY))


def brl(c) -> Column:
    """Currency display: millions as 'R$x.xxM', thousands as 'R$x.xK',
    else 'R$x.xx' (rounded half-up first, so the text is engine-independent)."""
    x = col_(c).cast("double")
    return (F.when(x >= 1_000_000, F.format_string("R$%.2fM", rnd(x / F.lit(1_000_000.0), 2)))
            .when(x >= 1_000, F.format_string("R$%.1fK", rnd(x / F.lit(1_000.0), 1)))
            .otherwise(F.format_string("R$%.2f", rnd(x, 2))))
