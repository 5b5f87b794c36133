"""Dense regression networks trained in the tasks: one hidden layer (SLP) or several (MLP)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strucreg.operators import optimizers
from strucreg.operators.partial_sums import matrix
from strucreg.operators.training import EarlyStopping, Fit, Model, activate, glorot, models_for, pack, run_epochs, unpack

LEAKY_SLOPE = 0.2


@dataclass(frozen=True)
class Shape:
    """All hidden layers share one width and activation; the output is linear."""

    inputs: int
    outputs: int
    units: int
    layers: int = 1
    activation: str = "relu"
    l1: float = 0.0
    l2: float = 0.0

    @property
    def arrays(self) -> list[tuple[int, ...]]:
        widths = [self.inputs, *[self.units] * self.layers, self.outputs]
        return [s for a, b in zip(widths, widths[1:]) for s in ((a, b), (b,))]

    def start(self, seed: int = 42) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return pack([glorot(rng, *s) if len(s) == 2 else np.zeros(s) for s in self.arrays])


def forward(shape: Shape, weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
    parts = unpack(weights, shape.arrays)
    trace, a = [], x
    for i in range(shape.layers):
        value, slope = activate(shape.activation, a @ parts[2 * i] + parts[2 * i + 1], LEAKY_SLOPE)
        trace.append((a, slope))
        a = value
    trace.append((a, None))
    return a @ parts[-2] + parts[-1], trace


def penalty(shape: Shape, weights: np.ndarray) -> float:
    """l1 and l2 on the hidden kernels."""
    kernels = unpack(weights, shape.arrays)[: 2 * shape.layers : 2]
    return float(sum(shape.l1 * np.abs(k).sum() + shape.l2 * (k * k).sum() for k in kernels))


class _Stack:
    """Models of one shape, a row of ``weights`` each, and room for the gradients of their steps, which are made side by side."""

    def __init__(self, shape: Shape, weights: np.ndarray):
        self.shape, self.weights = shape, weights
        self.slope, self.spare = np.empty_like(weights), np.empty_like(weights)
        self.parts, self.slopes, self.spares = (self._views(a) for a in (weights, self.slope, self.spare))

    def _views(self, rows: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.shape.arrays:
            n = math.prod(s)
            out.append(rows[:, at : at + n].reshape(len(rows), -1, s[-1]))
            at += n
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Fills ``slope`` from a batch of rows per model; the losses."""
        shape, parts = self.shape, self.parts
        trace, a = [], x
        for i in range(shape.layers):
            z = a @ parts[2 * i]
            z += parts[2 * i + 1]
            value, slope = activate(shape.activation, z, LEAKY_SLOPE)
            trace.append((a, slope))
            a = value
        trace.append((a, None))
        error = a @ parts[-2]
        error += parts[-1]
        error -= y
        size = error[0].size
        loss = np.add.reduce((error * error).reshape(len(error), -1), axis=1) / size
        back = error
        back *= 2
        back /= size
        cost = 0
        for i in range(shape.layers, -1, -1):
            inputs, _ = trace[i]
            kernel = np.matmul(inputs.swapaxes(1, 2), back, out=self.slopes[2 * i])
            if i < shape.layers:
                own, spare = parts[2 * i], self.spares[2 * i]
                np.multiply(own, own, out=spare)
                squares = np.add.reduce(spare.reshape(len(spare), -1), axis=1)
                np.abs(own, out=spare)
                cost = cost + (shape.l1 * np.add.reduce(spare.reshape(len(spare), -1), axis=1) + shape.l2 * squares)
                np.sign(own, out=spare)
                spare *= shape.l1
                kernel += spare
                np.multiply(own, 2 * shape.l2, out=spare)
                kernel += spare
            np.add.reduce(back, axis=1, keepdims=True, out=self.slopes[2 * i + 1])
            if i:
                back = back @ parts[2 * i].swapaxes(1, 2)
                back *= trace[i - 1][1]
        return loss + cost


def gradient(shape: Shape, weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean squared error over rows and outputs plus penalty, and its gradient."""
    one = _Stack(shape, weights[None])
    return float(one.gradient(x[None], y[None])[0]), one.slope[0]


def _chosen(rows: DataFrame, features: str, targets: Sequence[str], mark: Column, *more: str) -> DataFrame:
    return rows.select(*more, F.col(features).alias("x"), F.array(*targets).alias("y"), mark.alias("mark"))


def _whole_step(move, rate: float, weights, slope, slots, step):
    return move(weights, slope, slots, step, rate, 0.0)


def training_rows(
    rows: DataFrame, key: str, features: str, targets: Sequence[str], mark: Column, partitions: int
) -> DataFrame:
    """Rows placed by key and sorted, so that a run can be repeated; keys are spread evenly by hash. ``mark`` is whether a row is
    watched, or its fold."""
    return (
        _chosen(rows, features, targets, mark, key)
        .repartition(partitions, key)
        .sortWithinPartitions(key)
        .drop(key)
        .persist()
    )


def _read(batch):
    return (matrix(batch.column("x")), matrix(batch.column("y"))), batch.column("mark").to_numpy(zero_copy_only=False)


class _Learner:
    """Mini-batch steps of models that differ in their rows alone, in one task; rows that do not fill a batch wait for the next ones.
    The models step side by side, each through its own rows in their order."""

    def __init__(self, shape: Shape, rule: tuple, rate: float, batch: int, states, steps, epoch, train):
        self.shape, self.move, self.rate, self.batch, self.train = shape, rule[2], rate, batch, train
        self.start = [weights for weights, _ in states]
        self.stack = _Stack(shape, np.stack(self.start))
        self.slots = [np.stack(slots) for slots in zip(*(slots for _, slots in states))]
        self.steps, self.begun = list(steps), list(steps)
        self.rows, self.watched = [0] * len(states), [0] * len(states)
        self.loss, self.watch_loss = np.zeros(len(states)), [0.0] * len(states)
        self.held: list[tuple | None] = [None] * len(states)

    def _move(self, chosen: list[int], batches) -> None:
        """Steps of the chosen models through (x, y), each of which has a batch per model."""
        whole = len(chosen) == len(self.start)
        stack = self.stack if whole else _Stack(self.shape, self.stack.weights[chosen])
        slots = self.slots if whole else [s[chosen] for s in self.slots]
        loss, rows, made = self.loss[chosen], 0, 0
        steps = [self.steps[m] for m in chosen]
        for x, y in batches:
            part = stack.gradient(x, y)
            made += 1
            at = [s + made for s in steps]
            self.move(stack.weights, stack.slope, slots, at[0] if len(set(at)) == 1 else at, self.rate, 0.0, stack.spare)
            loss += part * x.shape[1]
            rows += x.shape[1]
        self.loss[chosen] = loss
        for m in chosen:
            self.rows[m] += rows
            self.steps[m] += made
        if not whole:
            self.stack.weights[chosen] = stack.weights
            for own, moved in zip(self.slots, slots):
                own[chosen] = moved

    def take(self, parsed, watched) -> None:
        x, y = parsed
        own = []
        for m, mark in enumerate(watched):
            mark = mark.astype(bool)
            if mark.any():
                error = forward(self.shape, self.start[m], x[mark])[0] - y[mark]
                self.watch_loss[m] += float((error * error).mean(axis=1).sum())
                self.watched[m] += int(mark.sum())
            own.append((x[~mark], y[~mark]))
        if self.train:
            self._learn(own)

    def _learn(self, own) -> None:
        own = [rows if held is None else tuple(map(np.concatenate, zip(held, rows))) for held, rows in zip(self.held, own)]
        full = [len(x) // self.batch for x, _ in own]
        done = 0
        # models with more batches than others make the rest of their steps without them
        for end in sorted(set(full)):
            chosen = [m for m, n in enumerate(full) if n >= end]
            a, z = done * self.batch, end * self.batch
            if a < z:
                x, y = (np.stack([own[m][i][a:z] for m in chosen]) for i in (0, 1))
                self._move(chosen, ((x[:, b : b + self.batch], y[:, b : b + self.batch]) for b in range(0, z - a, self.batch)))
            done = end
        self.held = [(x[n * self.batch :], y[n * self.batch :]) for n, (x, y) in zip(full, own)]

    def results(self):
        for m, held in enumerate(self.held):
            if held is not None and len(held[0]):
                self._move([m], [(held[0][None], held[1][None])])
        told = zip(self.rows, self.loss.tolist(), self.watched, self.watch_loss, self.steps, self.begun)
        return [
            (self.stack.weights[m], [s[m] for s in self.slots], n, loss, val_n, val_loss, step - begun)
            for m, (n, loss, val_n, val_loss, step, begun) in enumerate(told)
        ]


class _Summer(_Learner):
    """A task's share of one step over all rows: the mean of its rows' gradients in place of weights. No row is held."""

    def __init__(self, *args):
        super().__init__(*args)
        self.slope = [np.zeros(w.size) for w in self.start]

    def _learn(self, own) -> None:
        for m, (x, y) in enumerate(own):
            if not len(x):
                continue
            part, g = gradient(self.shape, self.start[m], x, y)
            self.slope[m] += g * len(x)
            self.loss[m] += part * len(x)
            self.rows[m] += len(x)

    def results(self):
        told = zip(self.slope, self.rows, self.loss.tolist(), self.watched, self.watch_loss)
        return [(slope / max(1, n), [s[m] for s in self.slots], n, loss, val_n, val_loss, 1) for m, (slope, n, loss, val_n, val_loss) in enumerate(told)]


@dataclass(frozen=True)
class Spec:
    """One of several models that are trained together; it watches the rows of ``fold``."""

    shape: Shape
    optimizer: str
    learning_rate: float
    fold: int | None = None


def fit_many(
    rows: DataFrame,
    key: str,
    features: str,
    targets: Sequence[str],
    specs: dict[int, Spec],
    mark: Column,
    epochs: int = 500,
    patience: int = 20,
    batch: int | None = 16,
    partitions: int | None = None,
    seed: int = 42,
    start: np.ndarray | None = None,
    checkpoints=None,
) -> dict[int, Fit]:
    """Trains every model of ``specs`` in the same jobs. ``mark`` is each row's fold, or whether it is watched where the models have none.

    Without a ``batch`` an epoch is one step over all rows: its gradient is summed in the tasks, so rows stay where they are and
    no task holds them. ``partitions`` is how many models are averaged (see ``training.models_for``).
    """
    models: dict[int, Model] = {}
    learners: dict[tuple, partial] = {}
    for k, spec in specs.items():
        rule = optimizers.DENSE[spec.optimizer]
        weights = spec.shape.start(seed) if start is None else start
        kind = (spec.shape, spec.optimizer, spec.learning_rate)
        models[k] = Model(
            learners.setdefault(kind, partial(_Learner if batch else _Summer, spec.shape, rule, spec.learning_rate, batch)), weights, optimizers.start_slots(rule, weights.size),
            EarlyStopping(patience), partial(penalty, spec.shape), spec.fold, None if batch else partial(_whole_step, rule[1], spec.learning_rate),
        )
    if batch is None:
        placed = _chosen(rows, features, targets, mark).persist()
    else:
        if partitions is None:
            shape = next(iter(specs.values())).shape
            partitions = models_for(rows.count(), 8 * (shape.inputs + shape.outputs))
        placed = training_rows(rows, key, features, targets, mark, partitions)
    try:
        return run_epochs(placed, partitions, models, _read, epochs, checkpoints=checkpoints)
    finally:
        placed.unpersist()


def fit(
    rows: DataFrame,
    key: str,
    features: str,
    targets: Sequence[str],
    shape: Shape,
    watch: Column,
    optimizer: str = "RMSprop",
    learning_rate: float = 1e-4,
    epochs: int = 500,
    **options,
) -> Fit:
    """Trains on the rows where ``watch`` is false and watches the loss on the others; ``options`` are those of ``fit_many``."""
    return fit_many(rows, key, features, targets, {0: Spec(shape, optimizer, learning_rate)}, watch, epochs, **options)[0]


def predict(features: Column, shape: Shape, weights: np.ndarray) -> Column:
    """Array of outputs from an array of inputs."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(x):
        import numpy as np
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(forward(shape, weights, np.stack(x.to_numpy()))[0]))

    return apply(features)


def named_weights(shape, weights: np.ndarray, slots: Sequence[np.ndarray] = ()) -> list[tuple[str, np.ndarray]]:
    """Kernels and biases in layer order, then the optimizer's slots, as ``save_network`` stores them."""
    parts = [("kernel" if len(s) == 2 else "bias", w) for s, w in zip(shape.arrays, unpack(weights, shape.arrays))]
    return [*parts, *[("slot", s) for s in slots]]
