"""Calendar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from souklens.functions.numeric import col_


def year_month(ts) -> Column:
    """'YYYY-MM' of a timestamp (pandas Period('M') rendering)."""
    return F.date_format(col_(ts), "yyyy-MM")


def year_quarter(ts) -> Column:
    """'YYYYQn' (pandas Period('Q') rendering)."""
    t = col_(ts)
    return F.concat(F.year(t).cast("string"), F.lit("Q"), F.quarter(t).cast("string"))


def quarter_label(ts) -> Column:
    return F.concat(F.lit("Q"), F.quarter(col_(ts)).cast("string"))


def day_name(ts) -> Column:
    return F.date_format(col_(ts), "EEEE")


def month_name(ts) -> Column:
    return F.date_format(col_(ts), "MMMM")
