"""Global order statistics without single-partition windows.

Spark's ``Window.orderBy`` without ``partitionBy`` moves every row into one
task.  Everything here instead:

1. range-partitions the rows by the whole sort order, tie-break key included
   (Spark samples the cut points, so partitions hold like numbers of rows
   whatever the values look like, and a score shared by a third of the rows is
   cut by its keys),
2. numbers the partitions and writes the result, which fixes them,
3. aggregates per partition (a tiny frame) and prefix-sums that,
4. joins the offsets back (broadcast if that frame is small, see ``small``),
5. finishes with a window partitioned by ``(group, partition)``.

Sort values may be numbers, strings or dates; NULL scores come last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lapsekit.session import cut_lineage

#: Rows up to which ``small`` broadcasts a frame.
SMALL_ROWS = 100_000
PART = "__part"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small; else as it is (a shuffled join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                   check: bool = False) -> DataFrame:
    """Equi-join on which NULL keys meet; the keys are taken from the left side. ``check``: see ``small``."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        cond = e if cond is None else cond & e
    return left.join(small(renamed) if check else renamed, cond, how).drop(*[f"__k_{k}" for k in keys])


def place(df: DataFrame, order: Sequence[Column], groups: Sequence[str] = ()) -> DataFrame:
    """Rows in range partitions of ``(groups, order)`` with the partition number in ``__part``, written once."""
    keys = [F.col(g).asc_nulls_first() for g in groups] + list(order)
    return cut_lineage(df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()))


def sorted_prefix(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], groups: Sequence[str] = (),
                  inclusive: bool = True, totals: bool = False) -> DataFrame:
    """Running sums in a global order of values.

    ``order``: the full (unique within group) sort order.  Adds one column per
    entry of ``sums`` with the running total up to and including the row
    (``inclusive``), or strictly before it; with ``totals`` also ``<name>_total``.
    """
    groups = list(groups)
    d = place(df, order, groups)
    tot = d.groupBy(*groups, PART).agg(*[F.sum(e).alias(f"__t_{k}") for k, e in sums.items()])
    wg = Window.partitionBy(*groups)
    wb = wg.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offs = tot.select(*groups, PART, *[F.coalesce(F.sum(f"__t_{k}").over(wb), F.lit(0)).alias(f"__o_{k}") for k in sums],
                      *[F.sum(f"__t_{k}").over(wg).alias(f"{k}_total") for k in sums if totals])
    j = null_safe_join(d, cut_lineage(offs), [*groups, PART], check=True)
    end = Window.currentRow if inclusive else -1
    wr = Window.partitionBy(*groups, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return j.withColumns({k: F.col(f"__o_{k}") + F.coalesce(F.sum(e).over(wr), F.lit(0)) for k, e in sums.items()}) \
            .drop(*[f"__o_{k}" for k in sums], PART)


def ordered_prefix(df: DataFrame, order: Sequence[Column], sums: dict[str, Column],
                   bucket: str, groups: Sequence[str] = ()) -> DataFrame:
    """P0 for an order by a hash: ``bucket`` is the hash's prefix, so buckets are even without looking at the data.

    Adds one column per entry of ``sums`` with the running total up to and
    including the row. Everything stays lazy. Rows whose group is NULL form a group.
    """
    groups = list(groups)
    tot = df.groupBy(*groups, bucket).agg(*[F.sum(e).alias(f"__t_{k}") for k, e in sums.items()])
    wb = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*groups, bucket,
                      *[F.coalesce(F.sum(f"__t_{k}").over(wb), F.lit(0)).alias(f"__o_{k}") for k in sums])
    j = null_safe_join(df, offs, [*groups, bucket])
    wr = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.withColumns({k: F.col(f"__o_{k}") + F.coalesce(F.sum(e).over(wr), F.lit(0)) for k, e in sums.items()}) \
            .drop(*[f"__o_{k}" for k in sums])


def rank_rows(df: DataFrame, score: str, key: str, descending: bool = True,
              groups: Sequence[str] = (), rank_col: str = "rank", n_col: str | None = "n") -> DataFrame:
    """Unique 1-based rank by ``score`` (desc by default, NULL scores last), ties by ``key`` ascending;
    ``n_col`` gets the group's row count."""
    sc = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    r = sorted_prefix(df, [sc, F.col(key).asc()], {rank_col: F.lit(1)}, groups, totals=bool(n_col))
    r = r.withColumn(rank_col, F.col(rank_col).cast("long"))
    return r.withColumnRenamed(f"{rank_col}_total", n_col) if n_col else r


def equal_bins(df: DataFrame, score: str, key: str, n_bins: int = 10, out: str = "bin") -> DataFrame:
    """Unique descending rank then ``qcut`` into equal bins.

    qcut edges are linear in rank: bin = max(1, ceil((rank-1)*n_bins/(n-1))).
    """
    r = rank_rows(df, score, key, descending=True)
    b = F.when(F.col("n") <= 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil((F.col("rank") - 1) * n_bins / (F.col("n") - 1))))
    return r.withColumn(out, b.cast("int"))


def top_fraction(df: DataFrame, score: str, key: str, frac: float, out: str = "selected",
                 rounding: str = "floor") -> DataFrame:
    """Flag the exact top ``k`` rows, k = max(1, floor(n*frac)) (or round/ceil)."""
    r = rank_rows(df, score, key, descending=True)
    raw = F.col("n") * F.lit(frac)
    k = {"floor": F.floor(raw), "ceil": F.ceil(raw), "round": F.bround(raw)}[rounding]
    return r.withColumn(out, (F.col("rank") <= F.greatest(k, F.lit(1))).cast("int"))


def avg_percentile(df: DataFrame, score: str, out: str = "percentile") -> DataFrame:
    """``rank(pct=True, method='average') * 100`` rounded to 2 (ascending score).

    Per distinct score: (first_rank + last_rank) / 2 / n; computed on the
    distinct-score frame (no hot keys after the groupBy) and joined back.
    """
    cnt = df.groupBy(score).agg(F.count(F.lit(1)).alias("__c"))
    cnt = sorted_prefix(cnt, [F.col(score).asc()], {"__before": F.col("__c")}, inclusive=False, totals=True)
    cnt = cnt.withColumn(out, F.bround((F.col("__before") + (F.col("__c") + 1) / 2.0) / F.col("__before_total") * 100, 2))
    return null_safe_join(df, cnt.select(score, out), [score])


def risk_grade(p: Column, cuts=(95, 85, 70), labels=("critical", "high", "medium", "low")) -> Column:
    """Grade from percentile."""
    e = F.when(p >= cuts[0], labels[0])
    for c, lab in zip(cuts[1:], labels[1:-1]):
        e = e.when(p >= c, lab)
    return e.otherwise(labels[-1])


def top_k(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Global sort + limit (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return df.orderBy(*order).limit(n)


def paginate(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """LIMIT/OFFSET page (1-based page). Page k sorts k pages; ``SortedPages`` reads one."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


class SortedPages:
    """W13 for deep pages: a table written once in range partitions of its sort key, each a folder of its own.

    A page reads the folder in which it begins and as many of the next ones as hold its rows, whatever its number.
    ``order`` is a list of (column, ascending); the columns together must be unique and not NULL. The index has a row per
    folder: its first key and its number of rows.
    """

    INDEX = "_index"

    def __init__(self, spark, path: str, order: Sequence[tuple[str, bool]], schema):
        self.spark, self.path, self.order, self.schema = spark, path.rstrip("/"), list(order), schema
        rows = sorted(spark.read.parquet(f"{self.path}/{self.INDEX}").collect(), key=lambda r: r["part"])
        self.parts, self.first = [r["part"] for r in rows], [r["first"] for r in rows]
        self.rows = [r["rows"] for r in rows]

    @classmethod
    def write(cls, df: DataFrame, path: str, order: Sequence[tuple[str, bool]], partitions: int | None = None) -> SortedPages:
        keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
        placed = df.repartitionByRange(*([partitions] if partitions else []), *keys)
        names = [c for c, _ in order]
        path = path.rstrip("/")
        (placed.withColumn(PART, F.spark_partition_id()).sortWithinPartitions(*keys).write.partitionBy(PART).parquet(f"{path}/rows"))
        schema = T.StructType([*df.schema.fields, T.StructField(PART, T.IntegerType())])
        rows = df.sparkSession.read.schema(schema).parquet(f"{path}/rows")
        by = F.struct(*[F.col(c) if up else cls._turned(df, c) for c, up in order])
        index = rows.groupBy(F.col(PART).alias("part")).agg(F.min_by(F.struct(*names), by).alias("first"), F.count(F.lit(1)).alias("rows"))
        index.coalesce(1).write.parquet(f"{path}/{cls.INDEX}")
        return cls(df.sparkSession, path, order, schema)

    @staticmethod
    def _turned(df: DataFrame, column: str) -> Column:
        kind = df.schema[column].dataType.typeName()
        if kind in ("string", "binary", "boolean", "date", "timestamp", "timestamp_ntz"):
            raise ValueError(f"{column}: only numbers can be in descending order")
        return -F.col(column)

    def _read(self, parts: list[int]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return rows.filter(F.col(PART).isin(parts)).drop(PART)  # partition pruning: other folders aren't opened

    def _sorted(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in self.order])

    def _from(self, at: int, rows: int) -> list[int]:
        """Folder number ``at`` of the index and the next ones, until those behind the first hold ``rows`` rows."""
        end, held = at + 1, 0
        while end < len(self.parts) and held < rows:
            held += self.rows[end]
            end += 1
        return self.parts[at:end]

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of a 1-based page, as OFFSET would give them."""
        skip, at = (number - 1) * size, 0
        while at < len(self.parts) and skip >= self.rows[at]:
            skip -= self.rows[at]
            at += 1
        return self._sorted(self._read(self._from(at, size) if at < len(self.parts) else [])).offset(skip).limit(size)

    def cursor(self, page: DataFrame) -> tuple | None:
        """Key of a page's last row; None of an empty page."""
        rows = page.select(*[c for c, _ in self.order]).collect()  # at most a page
        return tuple(rows[-1]) if rows else None

    def after(self, cursor: tuple | None, size: int) -> DataFrame:
        """The next ``size`` rows behind a key, which need not be there any more; None begins at the start."""
        if cursor is None:
            return self.page(1, size)
        before = lambda first: next((x < y if up else x > y for x, y, (_, up) in zip(first, cursor, self.order) if x != y), True)
        at = max((i for i, first in enumerate(self.first) if before(tuple(first))), default=0)
        behind, same = F.lit(False), F.lit(True)
        for value, (c, up) in zip(cursor, self.order):
            behind = behind | (same & (F.col(c) > F.lit(value) if up else F.col(c) < F.lit(value)))
            same = same & (F.col(c) == F.lit(value))
        return self._sorted(self._read(self._from(at, size)).filter(behind)).limit(size)


def sketch_bound(k: int) -> float:
    """Normalised rank error of a KLL sketch with parameter k, at 99 % confidence for a single quantile."""
    return 2.296 / k ** 0.9021


def sketch_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], groups: Sequence[str] = (), k: int = 800) -> DataFrame:
    """G17 by mergeable KLL sketches: one pass, a few kilobytes a column and task whatever the number of rows.

    Result: one row per (groups, column, p) with ``value`` (a value of the column), ``n`` (its values) and ``bound``, the
    normalised rank error that the value's rank keeps with 99 % confidence. ``exact_quantiles`` is the exact way; the
    caller chooses. NULLs don't count; a column without values has no row.
    """
    groups = list(groups)
    own = df.groupBy(*groups).agg(*[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)).alias(c) for c in cols],
                                  *[F.count(c).alias(f"__n_{c}") for c in cols])
    long = own.select(*groups, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("sketch"), F.col(f"__n_{c}").alias("n"))
                                                   for c in cols])).alias("s")).select(*groups, "s.*").filter("n > 0")
    parts = [F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probs]
    return long.select(*groups, "column", "n", F.explode(F.array(*parts)).alias("q")).select(
        *groups, "column", "q.p", "q.value", "n", F.lit(sketch_bound(k)).alias("bound"))


def quantile_rank_errors(df: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Exact normalised rank error of ``sketch_quantiles`` without groups: how far p lies outside the ranks that the value
    takes up in its column."""
    rows = quantiles.collect()  # a row per column and probability
    counts = []
    for i, r in enumerate(rows):
        c = F.col(r["column"]).cast("double")
        counts += [F.count_if(c < r["value"]).alias(f"below{i}"), F.count_if(c <= r["value"]).alias(f"upto{i}")]
    got = df.agg(*counts).first() if counts else None
    out = [(r["column"], r["p"], r["value"], max(got[f"below{i}"] / r["n"] - r["p"], r["p"] - got[f"upto{i}"] / r["n"], 0.0), r["bound"])
           for i, r in enumerate(rows)]
    return df.sparkSession.createDataFrame(out, "column string, p double, value double, rank_error double, bound double")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    groups: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas ``quantile``/DuckDB ``quantile_cont``).

    Distributed: unpivot to (column, value), count per distinct value, prefix
    the counts (P0), then pick the values at ranks floor/ceil of ``(n-1)*p``.
    Result: one row per (groups, column, p) with ``value``.
    """
    groups = list(groups)
    long = df.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("__kv")) \
        .select(*groups, "__kv.column", "__kv.v").filter(F.col("v").isNotNull())
    g2 = groups + ["column"]
    cnt = long.groupBy(*g2, "v").agg(F.count(F.lit(1)).alias("__c"))
    cnt = cut_lineage(sorted_prefix(cnt, [F.col("v").asc()], {"__cum": F.col("__c")}, g2, totals=True))
    pr = df.sparkSession.createDataFrame([(float(p),) for p in probs], "p double")
    # Each value covers 0-based ranks [cum - c, cum - 1]; a cell meets every probability (a short fixed list).
    j = cnt.crossJoin(F.broadcast(pr)).select(
        *g2, "p", "v", (F.col("__cum") - F.col("__c")).alias("__from"), (F.col("__cum") - 1).alias("__to"),
        ((F.col("__cum_total") - 1) * F.col("p")).alias("__pos")) \
        .withColumn("__lo", F.floor("__pos")).withColumn("__hi", F.ceil("__pos"))
    inlo = (F.col("__lo") >= F.col("__from")) & (F.col("__lo") <= F.col("__to"))
    inhi = (F.col("__hi") >= F.col("__from")) & (F.col("__hi") <= F.col("__to"))
    q = j.filter(inlo | inhi).groupBy(*g2, "p").agg(F.max(F.when(inlo, F.col("v"))).alias("__vlo"), F.max(F.when(inhi, F.col("v"))).alias("__vhi"),
                                F.first("__pos").alias("__pos"), F.first("__lo").alias("__lo"))
    return q.select(
        *g2, "p", (F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * (F.col("__pos") - F.col("__lo"))).alias("value"))


def top_abs_per_row(df: DataFrame, key: str, cols: Sequence[str], k: int = 10) -> DataFrame:
    """Unpivot, then the ``k`` largest ``|value|`` per row key (ties by column name)."""
    long = df.unpivot([key], list(cols), "feature", "value")
    w = Window.partitionBy(key).orderBy(F.abs("value").desc(), F.col("feature").asc())
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
