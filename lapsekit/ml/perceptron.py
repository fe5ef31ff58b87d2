"""Multilayer perceptron whose loss takes row weights, trained by gradients summed over the partitions.

Every step is one pass over the written rows: a task adds up loss and gradient of its rows, few sums reach the driver, and L-BFGS
picks the next parameters. Rows never leave their tasks; parameters are broadcast (their number is fixed by the layers).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.session import cut_lineage

#: Partial sums that are added up at a time, and that may reach the driver.
FAN_IN = 32
BATCH = 4096


def unpack(theta: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers[:-1], layers[1:]):
        out.append((theta[at:at + a * b].reshape(a, b), theta[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def start(layers: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in zip(layers[:-1], layers[1:])])


def forward(theta: np.ndarray, layers: Sequence[int], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Logits, and the inputs of every layer."""
    inputs, parts = [x], unpack(theta, layers)
    for w, b in parts[:-1]:
        inputs.append(np.maximum(inputs[-1] @ w + b, 0))
    w, b = parts[-1]
    return (inputs[-1] @ w + b)[:, 0], inputs


def loss_and_gradient(theta: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight sum, weighted log loss and its gradient, of one batch."""
    logit, inputs = forward(theta, layers, x)
    loss = weight * (np.logaddexp(0, logit) - y * logit)
    with np.errstate(over="ignore"):
        back = (weight * (1 / (1 + np.exp(-logit)) - y))[:, None]
    grads = []
    for (w, _), own in zip(unpack(theta, layers)[::-1], inputs[::-1]):
        grads.append(np.concatenate([(own.T @ back).ravel(), back.sum(axis=0)]))
        back = (back @ w.T) * (own > 0)
    return np.concatenate([[weight.sum(), loss.sum()], *grads[::-1]])


def _rows(batch):
    x = batch.column("x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def _pass(shared, layers):
    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                own = loss_and_gradient(shared.value, layers, _rows(part), part.column("y").to_numpy(zero_copy_only=False).astype(float),
                                        part.column("w").to_numpy(zero_copy_only=False).astype(float))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def _add(batches):
    import pyarrow as pa

    total = None
    for batch in batches:
        for value in batch.column(0):
            own = np.frombuffer(value.as_buffer())
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


class Objective:
    """Mean weighted log loss over the rows (x, y, w) plus a ridge term, and its gradient."""

    def __init__(self, rows: DataFrame, layers: Sequence[int], ridge: float):
        self.rows, self.layers, self.ridge = rows, list(layers), ridge
        self.partitions = rows.rdd.getNumPartitions()
        self.passes = 0

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        shared = self.rows.sparkSession.sparkContext.broadcast(theta)
        parts, n = self.rows.mapInArrow(_pass(shared, self.layers), "part binary"), self.partitions
        while n > FAN_IN:
            n = -(-n // FAN_IN)
            parts = parts.repartition(n).mapInArrow(_add, "part binary")
        got = [np.frombuffer(r[0]) for r in parts.collect()]  # at most FAN_IN rows
        shared.unpersist()
        self.passes += 1
        if not got:
            raise ValueError("no rows to train on")
        total = np.sum(got, axis=0)
        return (total[1] / total[0] + self.ridge / 2 * theta @ theta, total[2:] / total[0] + self.ridge * theta)


def minimise(f, theta: np.ndarray, steps: int, memory: int = 10, tol: float = 1e-6, go_on=lambda theta: True) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with backtracking; returns the parameters and the loss after each step. ``go_on`` is asked after each."""
    value, grad = f(theta)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    history = [value]
    for _ in range(steps):
        direction, alphas = -grad, []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ direction))
            direction = direction - alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            direction = direction * (s @ y) / (y @ y)
        for (s, y, rho), alpha in zip(past, reversed(alphas)):
            direction = direction + (alpha - rho * (y @ direction)) * s
        slope = grad @ direction
        if slope >= 0:  # no descent: begin anew with the gradient
            past, direction, slope = [], -grad, -(grad @ grad)
        size = 1.0 if past else min(1.0, 1.0 / max(np.abs(grad).sum(), 1e-12))
        for _ in range(20):
            new = theta + size * direction
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            return theta, history
        s, y = new - theta, new_grad - grad
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            past = [*past, (s, y, 1 / (s @ y))][-memory:]
        done = value - new_value <= tol * max(1.0, abs(value))
        theta, value, grad = new, new_value, new_grad
        history.append(value)
        if done or not go_on(theta):
            break
    return theta, history


class Patience:
    """Keeps the parameters with the least loss on other rows; no more steps after ``patience`` without a lesser one."""

    def __init__(self, f, theta: np.ndarray, patience: int):
        self.f, self.patience, self.best, self.least, self.worse = f, patience, theta, f(theta)[0], 0

    def __call__(self, theta: np.ndarray) -> bool:
        value = self.f(theta)[0]
        self.worse = 0 if value < self.least else self.worse + 1
        if value < self.least:
            self.best, self.least = theta, value
        return self.worse < self.patience


@dataclass
class Perceptron:
    """A trained net: parameters of its layers and the losses on the way."""

    theta: np.ndarray
    layers: list[int]
    history: list[float]

    def score(self, df: DataFrame, features: str = "features", out: str = "churn_probability") -> DataFrame:
        """``df`` with the probability of the positive class, computed in the tasks that hold the rows."""
        shared = df.sparkSession.sparkContext.broadcast((self.theta, self.layers))

        @F.arrow_udf("double")
        def probability(x):
            import pyarrow as pa

            theta, layers = shared.value
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, layers[0]))
            logit, _ = forward(theta, layers, rows)
            with np.errstate(over="ignore"):
                return pa.array(1 / (1 + np.exp(-logit)), pa.float64())

        return df.withColumn(out, probability(vector_to_array(features)))


def fit_perceptron(df: DataFrame, features: str, label: str, hidden: Sequence[int] = (128, 64), pos_weight: float = 1.0,
                   weight_col: str | None = None, steps: int = 60, ridge: float = 1e-4, seed: int = 42,
                   valid: DataFrame | None = None, patience: int = 5) -> Perceptron:
    """Fit on all rows of ``df`` (``features``: vector column). A positive row's loss counts ``pos_weight`` times, any row's
    ``weight_col`` times besides; a weight of k equals k copies of the row. With ``valid`` (same columns) the parameters of the
    step with the least loss on it are kept and training stops ``patience`` steps after. Rows with a NULL label teach nothing."""
    def rows_of(d: DataFrame) -> DataFrame:
        w, y = F.lit(1.0) if weight_col is None else F.col(weight_col).cast("double"), F.col(label).cast("double")
        out = d.filter(F.col(label).isNotNull()).select(vector_to_array(features).alias("x"), y.alias("y"),
                                                        (w * F.when(y > 0, F.lit(float(pos_weight))).otherwise(F.lit(1.0))).alias("w"))
        return cut_lineage(out)  # every step reads it again

    rows = rows_of(df)
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no rows to train on")
    layers = [first[0], *hidden, 1]
    theta = start(layers, seed)
    watch = None if valid is None or valid.isEmpty() else Patience(Objective(rows_of(valid), layers, 0.0), theta, patience)
    theta, history = minimise(Objective(rows, layers, ridge), theta, steps, go_on=watch or (lambda theta: True))
    return Perceptron(theta if watch is None else watch.best, layers, history)
