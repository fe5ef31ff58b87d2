"""Survival analysis as Spark aggregations (V1-V6).

Row-level data is reduced once to one row per distinct duration (events,
removed).  That frame is bounded by the number of distinct durations (days),
not by the number of customers; the at-risk counts are suffix sums over it
computed with P0, so no row-level single-partition window is used.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lapsekit.functions import r6
from lapsekit.operators.ordering import sorted_prefix
from lapsekit.session import cut_lineage


def _life_table(df: DataFrame, duration: str, event: str, groups: Sequence[str]) -> DataFrame:
    groups = list(groups)
    t = df.groupBy(*groups, F.col(duration).alias("duration")).agg(
        F.sum(F.col(event)).cast("long").alias("events"), F.count(F.lit(1)).alias("removed"))
    t = sorted_prefix(t, [F.col("duration").asc()], {"__before": F.col("removed")}, groups, inclusive=False, totals=True)
    return t.withColumn("at_risk", F.col("__before_total") - F.col("__before")).drop("__before", "__before_total")


def km_curve(df: DataFrame, duration: str, event: str, groups: Sequence[str] = ()) -> DataFrame:
    """V1/V3: Kaplan-Meier S(t) at every distinct duration (censored times keep S).

    S(t) = exp(sum log(1 - d/n)) with an explicit zero once d == n; the
    cumulative hazard H(t) = sum d/n (Nelson-Aalen, V5) comes with it.
    """
    groups = list(groups)
    t = _life_table(df, duration, event, groups)
    frac = F.col("events") / F.col("at_risk")
    t = t.withColumns({"__log": F.when(frac < 1, F.log(1 - frac)).otherwise(F.lit(0.0)),
                       "__zero": F.when(frac >= 1, 1).otherwise(0), "__h": frac})
    t = sorted_prefix(t, [F.col("duration").asc()],
                      {"__slog": F.col("__log"), "__szero": F.col("__zero"), "__sh": F.col("__h")}, groups)
    return t.select(*groups, "duration", "at_risk", "events", (F.col("removed") - F.col("events")).alias("censored"),
                    r6(F.when(F.col("__szero") > 0, F.lit(0.0)).otherwise(F.exp("__slog"))).alias("survival"),
                    r6("__sh").alias("cumulative_hazard"))


def exponential_reference(curve: DataFrame, rate: float | Column) -> DataFrame:
    """V1: exponential reference curve exp(-rate/365 * t) next to the KM curve; ``rate`` is per year."""
    return curve.withColumn("exponential_survival", r6(F.exp(-_lit(rate) / 365.0 * F.col("duration"))))


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def rmst(curve: DataFrame, horizon: float, groups: Sequence[str] = ()) -> DataFrame:
    """V2: restricted mean survival time: area under the KM step curve on [0, horizon].

    The curve has one row per distinct duration (bounded by the time axis),
    so ``lead`` over it is a window on a small frame."""
    groups = list(groups)
    w = Window.partitionBy(*groups).orderBy("duration")
    c = curve.filter(F.col("duration") < horizon).withColumn(
        "__next", F.least(F.coalesce(F.lead("duration").over(w), F.lit(horizon)), F.lit(horizon)))
    first = curve.groupBy(*groups).agg(F.min("duration").alias("__t0"))
    area = c.groupBy(*groups).agg(F.sum(F.col("survival") * (F.col("__next") - F.col("duration"))).alias("__a"))
    j = area.join(first, groups, "inner") if groups else area.crossJoin(first)
    return j.select(*groups, r6(F.col("__a") + F.least(F.greatest(F.col("__t0"), F.lit(0)), F.lit(horizon)))
                    .alias("rmst"), F.lit(float(horizon)).alias("horizon"))


def smoothed_hazard(curve: DataFrame, bandwidth: float, groups: Sequence[str] = ()) -> DataFrame:
    """V5: Epanechnikov-kernel smoothed hazard at each distinct duration:
    h(t) = 1/b * sum_T K((t - T)/b) dH(T), K(x) = 0.75 (1 - x^2) on |x| <= 1.

    Band join as an equi-join on bandwidth buckets (each event time is
    replicated to its neighbour buckets), never a cross join."""
    groups = list(groups)
    ev = curve.filter(F.col("events") > 0).select(
        *groups, F.col("duration").alias("T"), (F.col("events") / F.col("at_risk")).alias("dH"))
    ev = ev.withColumn("__k", F.explode(F.array(*[F.floor(F.col("T") / bandwidth) + i for i in (-1, 0, 1)])))
    pts = curve.select(*groups, "duration").withColumn("__k", F.floor(F.col("duration") / bandwidth))
    j = pts.join(ev, groups + ["__k"]).filter(F.abs(F.col("duration") - F.col("T")) <= bandwidth)
    x = (F.col("duration") - F.col("T")) / bandwidth
    h = j.groupBy(*groups, "duration").agg((F.sum(0.75 * (1 - x * x) * F.col("dH")) / bandwidth).alias("__h"))
    return curve.select(*groups, "duration").join(h, groups + ["duration"], "left") \
        .select(*groups, "duration", r6(F.coalesce("__h", F.lit(0.0))).alias("smoothed_hazard"))


def _pack(rows: list[tuple[float, np.ndarray]]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.float64()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                                      names=["t", "sums"])


def _cox_sums(beta: list[float]):
    """Per partition and duration: events, event covariates, and the sums of order 0, 1 and 2 of the rows and of those with
    an event."""
    def run(batches):
        b = np.array(beta)
        p = len(b)
        upper = np.triu_indices(p)
        total: dict[float, np.ndarray] = {}

        def orders(xs, ws):
            return [[ws.sum()], ws @ xs, ((xs * ws[:, None]).T @ xs)[upper]]

        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.column("t").to_numpy(zero_copy_only=False).astype(float)
            e = batch.column("e").to_numpy(zero_copy_only=False).astype(float)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(t), p)
            w = np.exp(x @ b)
            order = np.argsort(t, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(t[order])) + 1):
                own = np.concatenate([[e[rows].sum()], e[rows] @ x[rows], *orders(x[rows], w[rows]), *orders(x[rows], w[rows] * e[rows])])
                at = float(t[rows[0]])
                total[at] = total[at] + own if at in total else own
        yield _pack(list(total.items()))

    return run


def _cox_merge(batches):
    """Add up the sums of equal durations, which come one after the other."""
    at, total = None, None
    for batch in batches:
        done = []
        for t, sums in zip(batch.column("t").to_pylist(), batch.column("sums")):
            own = np.frombuffer(sums.as_buffer())
            if t == at:
                total = total + own
            else:
                if at is not None:
                    done.append((at, total))
                at, total = t, own
        if done:
            yield _pack(done)
    if at is not None:
        yield _pack([(at, total)])


def _tied(d: int, risk: float, tied: float, chunk: int = 1 << 20) -> np.ndarray:
    """Sums over c = 0, 1/d, .., (d-1)/d of 1/f, c/f, 1/f^2, c/f^2, c^2/f^2 with f = risk - c * tied: the l-th of d tied events
    leaves a risk set without the l/d-th part of the tied rows."""
    out = np.zeros(5)
    for first in range(0, d, chunk):
        c = np.arange(first, min(d, first + chunk)) / d
        f = risk - c * tied
        out += [(1 / f).sum(), (c / f).sum(), (1 / f ** 2).sum(), (c / f ** 2).sum(), (c ** 2 / f ** 2).sum()]
    return out


def _cox_step(p: int, above, ties: str):
    """Contribution of a partition's durations to gradient and Hessian; ``above``: sums of the later ones, by partition."""
    upper, k = np.triu_indices(p), 1 + p + p * (p + 1) // 2

    def square(v):
        out = np.zeros((p, p))
        out[upper] = v
        return out + np.triu(out, 1).T

    def run(batches):
        import pyarrow as pa

        risk, grad, hess = None, np.zeros(p), np.zeros((p, p))
        for batch in batches:
            parts = batch.column("part").to_pylist()
            for part, sums in zip(parts, batch.column("sums")):
                own = np.frombuffer(sums.as_buffer())
                risk = (above.value[part] if risk is None else risk) + own[1 + p:1 + p + k]
                d = int(own[0])
                if not d:
                    continue
                s0, s1, s2 = risk[0], risk[1:1 + p], square(risk[1 + p:])
                tied = own[1 + p + k:] if ties == "efron" else np.zeros(k)
                t1, t2 = tied[1:1 + p], square(tied[1 + p:])
                if ties == "efron" and d > 1:
                    a, b, a2, b2, c2 = _tied(d, s0, tied[0])
                else:
                    a, b, a2, b2, c2 = d / s0, 0.0, d / s0 ** 2, 0.0, 0.0
                grad += own[1:1 + p] - a * s1 + b * t1
                cross = np.outer(s1, t1)
                hess += a * s2 - b * t2 - a2 * np.outer(s1, s1) + b2 * (cross + cross.T) - c2 * np.outer(t1, t1)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([grad, hess.ravel()]).tobytes()], pa.binary())], names=["part_sum"])

    return run


def _part_total(p: int):
    k = 1 + p + p * (p + 1) // 2

    def run(batches):
        import pyarrow as pa

        total, part = None, 0
        for batch in batches:
            for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums")):
                own = np.frombuffer(sums.as_buffer())[1 + p:1 + p + k]
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "total"])

    return run


def cox_fit(df: DataFrame, duration: str, event: str, covariates: Sequence[str], penalizer: float = 0.1,
            max_iter: int = 25, tol: float = 1e-9, ties: str = "efron") -> DataFrame:
    """V6: Cox proportional hazards, Efron (or ``ties="breslow"``) ties, ridge penalty on standardised
    covariates (0.5 * penalizer * n * ||beta||^2), Newton-Raphson.

    Every iteration is ONE distributed pass over the written input: per distinct duration the sums of exp(b.x),
    x exp(b.x), x x' exp(b.x) over all rows and over the events, and of the event covariates. These meet in range
    partitions of the duration, latest first; the risk sets are running sums (P0: one total per partition reaches the
    driver, however many durations there are), and each partition gives one gradient and Hessian.
    Returns (covariate, coef, hazard_ratio, se) on the original scale.
    """
    if ties not in ("efron", "breslow"):
        raise ValueError(f"unknown ties {ties}")
    cov = list(covariates)
    p = len(cov)
    df = cut_lineage(df.select(duration, event, *cov))  # every step reads it again
    st = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cov)],
                *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(cov)]).first()
    n = st["n"]
    mean = np.array([st[f"m{i}"] or 0.0 for i in range(p)], dtype=float)
    sd = np.array([st[f"s{i}"] or 1.0 for i in range(p)], dtype=float)
    sd[sd == 0] = 1.0
    base = cut_lineage(df.select(F.col(duration).alias("t"), F.col(event).alias("e"), F.array(*[
        ((F.col(c) - float(mean[i])) / float(sd[i])).cast("double") for i, c in enumerate(cov)]).alias("x")))
    spark = df.sparkSession
    beta = np.zeros(p)
    hess = np.eye(p)
    for _ in range(max_iter):
        parts = base.mapInArrow(_cox_sums(beta.tolist()), "t double, sums binary")
        per_t = parts.repartitionByRange(F.desc("t")).sortWithinPartitions(F.desc("t")).mapInArrow(_cox_merge, "t double, sums binary")
        per_t = cut_lineage(per_t.withColumn("part", F.spark_partition_id()))
        totals = {r["part"]: np.frombuffer(r["total"]) for r in
                  per_t.select("part", "sums").mapInArrow(_part_total(p), "part int, total binary").collect()}  # one row a partition
        above, so_far = {}, np.zeros(1 + p + p * (p + 1) // 2)
        for part in sorted(totals):
            above[part] = so_far
            so_far = so_far + totals[part]
        shared = spark.sparkContext.broadcast(above)
        got = per_t.select("part", "sums").mapInArrow(_cox_step(p, shared, ties), "part_sum binary").collect()  # one row a partition
        got = np.sum([np.frombuffer(r[0]) for r in got], axis=0) if got else np.zeros(p + p * p)
        grad = got[:p] - n * penalizer * beta
        hess = got[p:].reshape(p, p) + n * penalizer * np.eye(p)
        step = np.linalg.solve(hess, grad)
        beta = beta + step
        if np.max(np.abs(step)) < tol:
            break
    se = np.sqrt(np.diag(np.linalg.inv(hess))) / sd
    coef = beta / sd
    rows = [(c, float(coef[i]), float(np.exp(coef[i])), float(se[i])) for i, c in enumerate(cov)]
    return spark.createDataFrame(rows, "covariate string, coef double, hazard_ratio double, se double")
