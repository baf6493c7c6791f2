"""Multilayer-perceptron regressor trained data-parallel.

Spark ML has no MLP regressor.  Each epoch broadcasts the weights; every task
takes mini-batch Adam steps over its partition with numpy (Arrow batches, no
row becomes a Python object) and yields its weights; tasks sum those of many
tasks weighted by rows and the driver receives few sums.  The rows of a task
are packed once into a few blobs, so an epoch moves no single values.  Columns
that never vary keep their initial weights.  Only weights (a few thousand
numbers for each 64 tasks) move through the driver.  A part of the rows, by hash, is held back; training stops when
their loss has not improved for ``patience`` epochs, and the best weights
stay.  Inputs and target are standardised (population statistics).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.models.features import PopulationScaler


def _init(sizes: Sequence[int], seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    params = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        params.append(rng.normal(0.0, np.sqrt(2.0 / a), size=(a, b)))
        params.append(np.zeros(b))
    return params


def _flatten(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def _unflatten(vec: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    out, i = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append(vec[i:i + a * b].reshape(a, b))
        i += a * b
        out.append(vec[i:i + b])
        i += b
    return out


def _forward(params: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    acts = [x]
    h = x
    n_layers = len(params) // 2
    for k in range(n_layers):
        z = h @ params[2 * k] + params[2 * k + 1]
        h = np.maximum(z, 0.0) if k < n_layers - 1 else z
        acts.append(h)
    return h[:, 0], acts


def _grad(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, grads: list[np.ndarray]) -> None:
    """Sums of the rows' gradients, into ``grads`` (shaped as ``params``)."""
    pred, acts = _forward(params, x)
    delta = (pred - y)[:, None]             # d(0.5 * sum err^2) / d out
    n_layers = len(params) // 2
    for k in reversed(range(n_layers)):
        np.matmul(acts[k].T, delta, out=grads[2 * k])
        delta.sum(axis=0, out=grads[2 * k + 1])
        if k > 0:
            delta = (delta @ params[2 * k].T) * (acts[k] > 0)


class _Adam:
    """Steps of Adam on flat weights, moments as given; works in place."""

    def __init__(self, theta: np.ndarray, state: np.ndarray, sizes: Sequence[int], lr: float):
        self.theta, self.state, self.lr = theta, state, lr
        self.m, self.v = state[:len(theta)], state[len(theta):]
        self.g, self.a, self.b = (np.empty_like(theta) for _ in range(3))
        self.params, self.grads = _unflatten(theta, sizes), _unflatten(self.g, sizes)      # views

    def step(self, x: np.ndarray, y: np.ndarray, t: int) -> None:
        m, v, g, a, b = self.m, self.v, self.g, self.a, self.b
        _grad(self.params, x, y, self.grads)
        g /= len(x)
        m *= 0.9
        np.multiply(g, 0.1, out=a)
        m += a
        v *= 0.999
        np.multiply(g, 0.001, out=a)
        a *= g
        v += a
        np.divide(v, 1 - 0.999 ** t, out=a)
        np.sqrt(a, out=a)
        a += 1e-8
        np.divide(m, 1 - 0.9 ** t, out=b)
        b *= self.lr
        b /= a
        self.theta -= b


#: Tasks whose weights one task sums.
SUMMED = 64


def _packed(data: DataFrame, inputs: int) -> DataFrame:
    """(x, y, held) of each Arrow batch of rows as one row of blobs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, inputs)
                y, h = b.column("y").to_numpy(), b.column("held").to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in ((x, float), (y, float), (h, bool))], names=["x", "y", "held"])

    return data.mapInArrow(run, "x binary, y binary, held binary")


SENT = "task int, w binary"


def _sent(task: int, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([w.tobytes()], pa.binary())], names=["task", "w"])


def _added(parts: Iterable[tuple[int, bytes]]) -> np.ndarray | None:
    """The sum of vectors, in the order of their tasks."""
    total = None
    for _, w in sorted(parts):
        w = np.frombuffer(w, float)
        total = w if total is None else total + w
    return total


class DistributedMLP:
    """Defaults: layers 64 and 32, batches of 32, rate 0.001, at most 100
    epochs, a fifth held back, patience 10."""

    def __init__(self, features: Sequence[str], target: str, hidden: Sequence[int] = (64, 32), epochs: int = 100, batch: int = 32,
                 lr: float = 0.001, hold_back: float = 0.2, patience: int = 10, rows_per_task: int = 100_000, seed: int = 42):
        self.features, self.target = list(features), target
        self.sizes = [len(self.features), *hidden, 1]
        self.epochs, self.batch, self.lr, self.seed = epochs, batch, lr, seed
        self.hold_back, self.patience, self.rows_per_task = hold_back, patience, rows_per_task
        self.scaler = PopulationScaler([*self.features, target])
        self.params: list[np.ndarray] = []
        self.history: list[float] = []      # loss of the held-back rows after each epoch

    def _varying(self, df: DataFrame) -> list[int]:
        """Inputs that training moves the weights of: a column whose every
        value is its mean is zero once standardised, and so are its gradients."""
        row = df.agg(F.count(F.lit(1)), *[x for c in self.features for x in (F.count(c), F.min(c).cast("double"), F.max(c).cast("double"))]).first()
        zero = [row[3 * i + 1] == row[0] and row[3 * i + 2] == row[3 * i + 3] == self.scaler.mean[c] for i, c in enumerate(self.features)]
        return [i for i, z in enumerate(zero) if not z] or list(range(len(self.features)))

    def _matrix(self, df: DataFrame) -> DataFrame:
        s = self.scaler.transform(df, suffix="__s")
        x = F.array(*[F.col(f"`{c}__s`") for c in self.features])
        return s.select(x.alias("x"), F.col(f"{self.target}__s").alias("y"),
                        (F.pmod(F.xxhash64(x, F.lit(self.seed)), F.lit(1000)) < int(1000 * self.hold_back)).alias("held"))

    def _epoch(self, data: DataFrame, theta: np.ndarray, state: np.ndarray, steps: int, number: int, inputs: int, tasks: int) -> tuple[np.ndarray, np.ndarray, float, float]:
        """One pass: mean weights and Adam moments over the tasks, and the
        summed loss and number of held-back rows under the incoming weights."""
        shared = data.sparkSession.sparkContext.broadcast((theta, state))
        sizes, batch, lr, seed = [inputs, *self.sizes[1:]], self.batch, self.lr, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            theta, state = (x.copy() for x in shared.value)
            start, adam = _unflatten(theta.copy(), sizes), _Adam(theta, state, sizes, lr)
            rng = np.random.default_rng(seed + number)
            t, rows, loss, held = steps, 0, 0.0, 0
            for blobs in (r for b in batches for r in zip(*(b.column(c) for c in ("x", "y", "held")))):
                x, y, h = (np.frombuffer(v.as_buffer(), k) for v, k in zip(blobs, (float, float, bool)))
                x = x.reshape(len(y), sizes[0])
                if h.any():
                    loss += float(np.sum((_forward(start, x[h])[0] - y[h]) ** 2))
                    held += int(h.sum())
                x, y = x[~h], y[~h]
                order = rng.permutation(len(x))
                x, y = x[order], y[order]
                for a in range(0, len(order), batch):
                    t += 1
                    adam.step(x[a:a + batch], y[a:a + batch], t)
                rows += len(x)
            yield _sent(TaskContext.get().partitionId(), np.concatenate([theta * rows, state * rows, [rows, loss, held]]))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _added(r for b in batches for r in zip(b.column("task").to_pylist(), b.column("w").to_pylist()))
            if total is not None:
                yield _sent(TaskContext.get().partitionId(), total)

        sums = data.mapInArrow(run, SENT).repartition(-(-tasks // SUMMED), "task").mapInArrow(add, SENT)
        total = _added((r["task"], r["w"]) for r in sums.collect())
        total = np.zeros(3 * len(theta) + 3) if total is None else total
        shared.unpersist()
        mean = total[:-3] / max(total[-3], 1.0)
        return mean[:len(theta)], mean[len(theta):], float(total[-2]), float(total[-1])

    def fit(self, df: DataFrame) -> "DistributedMLP":
        self.scaler.fit(df)
        varying = self._varying(df)
        data = self._matrix(df)
        n = data.count()
        tasks = max(1, -(-n // self.rows_per_task))
        data = _packed(data.repartition(tasks).select(F.array(*[F.col("x")[i] for i in varying]).alias("x"), "y", "held"), len(varying)).persist()
        initial = _init(self.sizes, self.seed)
        theta = _flatten([initial[0][varying], *initial[1:]])
        state = np.zeros(2 * len(theta))
        best, best_theta, waited = np.inf, theta, 0
        steps = max(1, int(n * (1 - self.hold_back) / tasks / self.batch))
        for epoch in range(self.epochs + 1):       # the last pass only measures
            new, new_state, loss, held = self._epoch(data, theta, state, epoch * steps, epoch, len(varying), tasks)
            value = loss / held if held else 0.0
            self.history.append(value)
            if value < best - 1e-4 * 1e-2:
                best, best_theta, waited = value, theta, 0
            else:
                waited += 1
            if waited >= self.patience:
                break
            theta, state = new, new_state
        data.unpersist()
        best_params = _unflatten(best_theta, [len(varying), *self.sizes[1:]])
        initial[0][varying] = best_params[0]
        self.params = [initial[0], *best_params[1:]]
        return self

    def predictor(self):
        """A function from a matrix of inputs to predictions, of plain values."""
        params = [p.copy() for p in self.params]
        mean, std = (np.array([x[c] for c in self.features]) for x in (self.scaler.mean, self.scaler.std))
        tm, ts = self.scaler.mean[self.target], self.scaler.std[self.target]
        return lambda x: _forward(params, (x - mean) / std)[0] * ts + tm

    def transform(self, df: DataFrame, out: str = "prediction", floor: float | None = 0.0) -> DataFrame:
        """Adds ``out``; the forward pass runs per Arrow batch on executors."""
        sc = df.sparkSession.sparkContext
        bw = sc.broadcast(_flatten(self.params))
        sizes, feats = self.sizes, self.features
        mean = np.array([self.scaler.mean[c] for c in feats])
        std = np.array([self.scaler.std[c] for c in feats])
        tm, ts = self.scaler.mean[self.target], self.scaler.std[self.target]
        from pyspark.sql.types import DoubleType, StructField, StructType
        schema = StructType(list(df.schema.fields) + [StructField(out, DoubleType())])

        def score(it):
            params = _unflatten(bw.value, sizes)
            for pdf in it:
                if len(pdf) == 0:
                    yield pdf.assign(**{out: pd.Series(dtype=float)})
                    continue
                x = (pdf[feats].to_numpy(dtype=float) - mean) / std
                pred, _ = _forward(params, x)
                y = pred * ts + tm
                if floor is not None:
                    y = np.maximum(y, floor)
                yield pdf.assign(**{out: y})

        return df.mapInPandas(score, schema)
