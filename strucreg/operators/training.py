"""What the two network trainers share: weights as one vector, epochs, early stopping, any number of models at once.

An epoch is one Spark job: every partition starts from the same weights, makes its own
mini-batch steps over its rows, and the results are averaged by row count. With one
partition this is plain mini-batch descent. The job also scores the watch rows with the
weights it starts from, so the loss of an epoch arrives with the following one and no
second job is needed.

The models of a search train in the same jobs: each is a key of the epoch's vectors, learns from the rows that are not in its
fold and leaves the keys when it stops. The table is placed and read once for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from strucreg.operators.partial_sums import FEW_TASKS, sum_vectors, vector_rows


# Models that are trained beside each other and averaged after every epoch. Fixed, so that weights do not depend on
# the size of the cluster. A model's rows are one task's, so a table of more than that many times MODEL_BYTES has more of them.
MODELS = 8
MODEL_BYTES = 512 << 20


def models_for(rows: int, row_bytes: int) -> int:
    """How many models are averaged on a table; decided by the table alone."""
    return max(MODELS, -(-rows * row_bytes // MODEL_BYTES))


def unpack(flat: np.ndarray, shapes: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes:
        n = math.prod(s)
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


def pack(arrays: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(a) for a in arrays])


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function in array operations: the series of positive terms near 0, a continued fraction beyond 2.5."""
    square = x * x
    series = np.ones_like(x)
    size = np.maximum(np.abs(x), 2.5)
    fraction = size
    for n in range(60, 0, -1):
        series = 1 + 2 * np.minimum(square, 7) / (2 * n + 1) * series
        fraction = size + n / 2 / fraction
    near = x * np.exp(-square) * series * (2 / math.sqrt(math.pi))
    far = np.sign(x) * (1 - np.exp(-size * size) / fraction / math.sqrt(math.pi))
    return np.where(square < 6.25, near, far)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def activate(name: str, x: np.ndarray, slope: float) -> tuple[np.ndarray, np.ndarray]:
    """Value and derivative."""
    if name == "relu":
        return np.maximum(x, 0), (x > 0).astype(np.float64)
    if name == "sigmoid":
        s = _sigmoid(x)
        return s, s * (1 - s)
    if name == "tanh":
        t = np.tanh(x)
        return t, 1 - t * t
    if name == "leaky_relu":
        return np.where(x >= 0, x, slope * x), np.where(x >= 0, 1.0, slope)
    if name == "elu":
        e = np.expm1(np.minimum(x, 0))
        return np.where(x >= 0, x, e), np.where(x >= 0, 1.0, e + 1)
    if name == "silu":
        s = _sigmoid(x)
        return x * s, s * (1 + x * (1 - s))
    if name == "mish":
        t, s = np.tanh(np.logaddexp(0, x)), _sigmoid(x)
        return x * t, t + x * (1 - t * t) * s
    if name == "gelu":
        cdf = 0.5 * (1 + _erf(x / math.sqrt(2)))
        return x * cdf, cdf + x * np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
    raise ValueError(f"unknown activation: {name}")


def glorot(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    limit = math.sqrt(6 / (rows + columns))
    return rng.uniform(-limit, limit, (rows, columns))


@dataclass
class EarlyStopping:
    """Stops after ``patience`` epochs without a gain above ``min_delta``; keeps a copy of the best weights."""

    patience: int = 20
    min_delta: float = 0.0
    best_loss: float = math.inf
    best_epoch: int = 0
    best_weights: np.ndarray | None = None
    waited: int = 0

    def update(self, epoch: int, loss: float, weights: np.ndarray) -> bool:
        if loss < self.best_loss - self.min_delta:
            self.best_loss, self.best_epoch, self.waited = loss, epoch, 0
            self.best_weights = weights.copy()
        else:
            self.waited += 1
        return self.waited >= self.patience


@dataclass
class Fit:
    weights: np.ndarray
    best_epoch: int
    best_loss: float
    history: list[tuple[int, float, float]] = field(default_factory=list)
    slots: list[np.ndarray] = field(default_factory=list)  # optimizer state at the end

    def history_table(self, spark: SparkSession) -> DataFrame:
        """``(epoch, train_loss, val_loss)``."""
        return spark.createDataFrame(self.history, "epoch int, train_loss double, val_loss double")


@dataclass
class Model:
    """A model in training: how it learns and where it stands.

    ``learner(states, steps, epoch, train)`` makes an object for one task, for all models that have this very learner: their weights
    and slots, and steps made. It has ``take(rows, watched)``, the watched rows of each model, and ``results()``, per model: new
    weights and slots, rows seen, summed loss, watch rows, summed watch loss and steps made. ``fold`` is the number of the rows
    that are watched; without it they are marked in the table.
    """

    learner: Callable
    weights: np.ndarray
    slots: list[np.ndarray]
    stopping: EarlyStopping
    penalty: Callable[[np.ndarray], float] = lambda weights: 0.0
    fold: int | None = None
    whole_step: Callable | None = None
    step: int = 0
    train_loss: float = math.nan
    history: list[tuple[int, float, float]] = field(default_factory=list)
    ended: bool = False

    def fit(self) -> Fit:
        best = self.stopping.best_weights if self.stopping.best_weights is not None else self.weights
        return Fit(best, self.stopping.best_epoch, float(self.stopping.best_loss), self.history, self.slots)

    def state(self) -> dict[str, np.ndarray]:
        """Everything that changes, as named vectors; ``resumed`` takes them back."""
        s = self.stopping
        facts = [self.step, self.train_loss, s.best_loss, s.best_epoch, s.waited, self.ended]
        vectors = {"weights": self.weights, "facts": np.array(facts, float), "history": np.array(self.history, float).ravel()}
        vectors |= {f"slot{i}": v for i, v in enumerate(self.slots)}
        return vectors if s.best_weights is None else vectors | {"best": s.best_weights}

    def resumed(self, state: dict[str, np.ndarray]) -> Model:
        step, train_loss, best_loss, best_epoch, waited, ended = state["facts"].tolist()
        stopping = replace(self.stopping, best_loss=best_loss, best_epoch=int(best_epoch), waited=int(waited), best_weights=state.get("best"))
        history = [(int(e), a, b) for e, a, b in state["history"].reshape(-1, 3).tolist()]
        slots = [state[f"slot{i}"] for i in range(len(self.slots))]
        return replace(self, weights=state["weights"], slots=slots, stopping=stopping, step=int(step), train_loss=train_loss, history=history, ended=bool(ended))


# Positions at the end of a task's vector.
_TAIL = ("rows", "loss", "val_rows", "val_loss", "steps")
# Weights and slots that are sent to the tasks at once; more models than this holds take turns within an epoch.
MAX_SENT_BYTES = 256 << 20


def _turns(models: dict[int, Model]) -> list[list[int]]:
    turns: list[list[int]] = []
    size = 0
    for key, m in models.items():
        own = m.weights.nbytes * (1 + len(m.slots))
        if not turns or size + own > MAX_SENT_BYTES:
            turns.append([])
            size = 0
        turns[-1].append(key)
        size += own
    return turns


def _epoch(rows: DataFrame, read: Callable, models: dict[int, Model], epoch: int, train: bool, few_tasks: bool) -> dict[int, np.ndarray]:
    """One job: every task moves every model over its rows."""
    sent = rows.sparkSession.sparkContext.broadcast({k: (m.weights, m.slots) for k, m in models.items()})
    alike: dict[Callable, list[int]] = {}
    for k, m in models.items():
        alike.setdefault(m.learner, []).append(k)
    how = [(learner, keys, [models[k].fold for k in keys], [models[k].step for k in keys]) for learner, keys in alike.items()]

    def task(batches):
        learners = [(learner([sent.value[k] for k in keys], steps, epoch, train), keys, folds) for learner, keys, folds, steps in how]
        for batch in batches:
            if not batch.num_rows:
                continue
            parsed, mark = read(batch)
            for learner, _, folds in learners:
                learner.take(parsed, [mark if fold is None else mark == fold for fold in folds])
        vectors = {}
        for learner, keys, _ in learners:
            for k, (w, s, n, loss, val_n, val_loss, steps) in zip(keys, learner.results()):
                # steps are weighted like the weights, so that their mean fits the averaged state
                vectors[k] = np.concatenate([np.concatenate([w, *s]) * n, [n, loss, val_n, val_loss, steps * n]])
        yield vector_rows(vectors)

    try:
        return sum_vectors(rows, task, few_tasks=few_tasks)
    finally:
        sent.destroy()


def run_epochs(
    rows: DataFrame,
    partitions: int | None,
    models: dict[int, Model],
    read: Callable,
    epochs: int,
    between: Callable | None = None,
    watch_more: Callable | None = None,
    checkpoints=None,
) -> dict[int, Fit]:
    """Trains all ``models`` on the placed ``rows``; the jobs of an epoch do not become more with the models. ``partitions`` is
    None where their number is not known.

    ``read(batch)`` gives the rows in the learners' form and each row's mark: watched or not, or its fold. ``between(key, weights,
    slots, step, epoch)`` may change a model after each averaging, and ``watch_more(key, weights)`` adds watch rows that are not
    among ``rows``. With ``checkpoints`` (see ``artifacts.Checkpoints``) the state after an epoch is written, and a run that
    finds one goes on from it.
    """
    first = 1
    if checkpoints is not None and (found := checkpoints.latest()) is not None:
        first, states = found[0] + 1, found[1]
        models = {k: m.resumed(states[k]) for k, m in models.items()}
    for epoch in range(first, epochs + 2):
        train = epoch <= epochs
        live = {k: m for k, m in models.items() if not m.ended}
        for turn in _turns(live):
            totals = _epoch(rows, read, {k: live[k] for k in turn}, epoch, train, partitions is not None and partitions <= FEW_TASKS)
            for k in turn:
                _advance(k, live[k], totals[k], epoch, train, between, watch_more)
        if all(m.ended for m in models.values()):
            break
        if checkpoints is not None and train:
            checkpoints.save(epoch, {k: m.state() for k, m in models.items()})
    return {k: m.fit() for k, m in models.items()}


def _advance(key: int, model: Model, total: np.ndarray, epoch: int, train: bool, between, watch_more) -> None:
    """Takes in what the tasks made of a model in one epoch."""
    tail = dict(zip(_TAIL, total[-len(_TAIL) :]))
    if epoch > 1:
        if watch_more is not None:
            more_loss, more_rows = watch_more(key, model.weights)
            tail["val_loss"] += more_loss
            tail["val_rows"] += more_rows
        val_loss = tail["val_loss"] / tail["val_rows"] if tail["val_rows"] else model.train_loss
        val_loss += model.penalty(model.weights)
        model.history.append((epoch - 1, float(model.train_loss), float(val_loss)))
        if model.stopping.update(epoch - 1, val_loss, model.weights):
            model.ended = True
            return
    if not train:
        model.ended = True
        return
    if not tail["rows"] and between is None:
        raise ValueError("no training rows")
    seen, loss, size = tail["rows"], tail["loss"], model.weights.size
    if seen:
        state = total[: -len(_TAIL)] / seen
        slots = [state[size * (i + 1) : size * (i + 2)] for i in range(len(model.slots))]
        model.step += max(1, int(round(tail["steps"] / seen)))
        if model.whole_step is not None:
            model.weights, model.slots = model.whole_step(model.weights, state[:size], model.slots, model.step)
        else:
            model.weights, model.slots = state[:size], slots
    if between is not None:
        model.weights, model.slots, more_loss, more_rows = between(key, model.weights, model.slots, model.step, epoch)
        model.step += more_rows
        loss, seen = loss + more_loss, seen + more_rows
    model.train_loss = loss / seen
