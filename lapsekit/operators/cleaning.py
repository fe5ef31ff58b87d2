"""Projections, filters, cleaning and key-contract joins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lapsekit.session import cut_lineage

from lapsekit.functions import ymd_to_date


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of(df: DataFrame, date_col: str, cutoff) -> DataFrame:
    """keep rows dated on or before the cutoff.

    ``cutoff`` may be a ``date`` (DateType column) or a YYYYMMDD ``int`` (raw
    integer column).  Comparing the raw column with a literal keeps the
    predicate pushable into the Parquet scan (no cast around the column).
    """
    return df.filter(F.col(date_col) <= F.lit(cutoff))


def dedupe(df: DataFrame) -> DataFrame:
    """exact duplicate rows removed (``SELECT DISTINCT *``)."""
    return df.distinct()


def null_before(c, min_date) -> Column:
    """date sentinel (anything before ``min_date``) -> NULL."""
    c = _c(c)
    return F.when(c >= F.lit(min_date), c)


def fill_category(c, default: str = "unknown") -> Column:
    """F6."""
    return F.coalesce(_c(c), F.lit(default))


def clipped_days(later, earlier) -> Column:
    """day difference clipped at 0; NULL stays NULL."""
    a = F.lit(later) if isinstance(later, dt.date) else _c(later)
    b = F.lit(earlier) if isinstance(earlier, dt.date) else _c(earlier)
    d = F.datediff(a, b)
    return F.when(d.isNotNull(), F.greatest(d, F.lit(0)))


def label_when(cases: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """first matching condition wins (``np.select``/CASE)."""
    e = None
    for cond, val in cases:
        e = F.when(cond, F.lit(val)) if e is None else e.when(cond, F.lit(val))
    return e.otherwise(F.lit(default)) if default is not None else e


def key_contract(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One-row frame ``rows, distinct_keys, unique`` used by J2 and Q10."""
    keys = [key] if isinstance(key, str) else list(key)
    k = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(k).alias("distinct_keys")) \
             .withColumn("unique", F.col("rows") == F.col("distinct_keys"))


def join_1to1(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join that enforces ``validate='one_to_one'``.

    Both sides are written once; the check and the join read the written rows.
    """
    left, right = cut_lineage(left), cut_lineage(right)
    for side, name in ((left, "left"), (right, "right")):
        r = key_contract(side, key).first()
        if not r["unique"]:
            raise ValueError(f"join_1to1: {name} side has duplicate {key} ({r['rows']} rows, {r['distinct_keys']} keys)")
    return left.join(right, key, how)


def semi_keep(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key is in ``keys`` (left semi join)."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def latest_by_row_number(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """W2/W3 as a window (plans to WindowGroupLimit + Window)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
