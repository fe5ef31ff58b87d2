"""Scalar column helpers used by the operators.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ymd_to_date(c) -> Column:
    """YYYYMMDD integer -> DATE; unparsable values become NULL (pandas ``errors='coerce'``)."""
    return F.try_to_date(_c(c).cast("string"), "yyyyMMdd")


def date_to_ymd(c) -> Column:
    """DATE/TIMESTAMP -> YYYYMMDD integer."""
    return F.date_format(_c(c), "yyyyMMdd").cast("int")


def ymd_lit(d: dt.date) -> Column:
    return F.lit(int(d.strftime("%Y%m%d")))


def days_between(later, earlier) -> Column:
    """Whole days ``later - earlier`` (either side may be a DATE column or a date)."""
    a = F.lit(later) if isinstance(later, dt.date) else _c(later)
    b = F.lit(earlier) if isinstance(earlier, dt.date) else _c(earlier)
    return F.datediff(a, b)


def month_index(c) -> Column:
    """Months since year 0: ``12*year + month - 1``; differences give whole-month offsets."""
    c = _c(c)
    return F.year(c) * 12 + F.month(c) - 1


def months_between_idx(later, earlier) -> Column:
    return month_index(later) - month_index(earlier)


def safe_div(num, den) -> Column:
    """Division where x/0 is NULL (pandas inf -> NaN -> NULL)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def r6(c) -> Column:
    """Round derived doubles to 6 decimals so two engines agree bit for bit."""
    return F.bround(_c(c).cast("double"), 6)


def clip_low(c, lo) -> Column:
    return F.greatest(_c(c), F.lit(lo))


def clip_high(c, hi) -> Column:
    return F.least(_c(c), F.lit(hi))


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def ordered_argmax(cols: list[str], values: dict[str, Column] | None = None) -> Column:
    """Name of the column with the largest value; ties go to the earlier column.

    Pure expression: ``greatest`` then the first column equal to it.
    """
    vals = {c: (values or {}).get(c, F.col(c)) for c in cols}
    top = F.greatest(*vals.values())
    expr = None
    for c in cols:
        cond = vals[c] == top
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return expr
