"""Hyper-parameter search: seeded random trials, cross-validated objective, best trial."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strucreg.functions.columns import uniform
from strucreg.operators import linear

# Kinds of a parameter: ("int", low, high), ("log_int", low, high), ("float", low, high),
# ("log_float", low, high) with both ends included, ("choice", values...).
# The search space of every model.
_TREE = {
    "max_depth": ("int", 3, 15),
    "min_samples_split": ("int", 2, 10),
    "min_samples_leaf": ("int", 1, 10),
    "max_features": ("choice", "sqrt", "log2", "0.5", "0.8", "1.0"),
}
_DENSE = {
    "optimizer": ("choice", "Adam", "SGD", "RMSprop", "AdamW"),
    "activation": ("choice", "relu", "sigmoid", "tanh", "leaky_relu", "elu", "gelu", "silu", "mish"),
    "learning_rate": ("log_float", 1e-5, 1e-2),
    "units": ("log_int", 5, 200),
    "l1": ("log_float", 1e-8, 100.0),
    "l2": ("log_float", 1e-8, 100.0),
}
SPACES: dict[str, dict[str, tuple]] = {
    "ridge": {"alpha": ("log_float", 1e-3, 1000.0)},
    "lasso": {"alpha": ("log_float", 1e-3, 1000.0)},
    "elastic_net": {"alpha": ("log_float", 1e-3, 1000.0), "l1_ratio": ("float", 0.0, 1.0)},
    "decision_tree": _TREE,
    "random_forest": {"n_estimators": ("int", 50, 1000), **_TREE},
    "boosted_trees": {
        "n_estimators": ("int", 50, 1000),
        "max_depth": ("int", 3, 15),
        "learning_rate": ("log_float", 1e-5, 1e-2),
        "subsample": ("float", 0.5, 1.0),
        "colsample_bytree": ("float", 0.5, 1.0),
        "min_child_weight": ("int", 1, 10),
    },
    "slp": _DENSE,
    "mlp": {**_DENSE, "layers": ("int", 2, 20)},
    "gcn": {
        "units": ("log_int", 5, 200),
        "layers": ("int", 2, 20),
        "learning_rate": ("log_float", 1e-5, 1e-2),
        "weight_decay": ("log_float", 1e-8, 1e-2),
        "dropout": ("float", 0.1, 0.5),
        "optimizer": ("choice", "Adam", "SGD", "RMSprop", "AdamW"),
        "activation": ("choice", "relu", "sigmoid", "tanh", "leaky_relu"),
    },
}


def draw(trial: Column, name: str, spec: tuple, seed: int = 42) -> Column:
    """Value of one parameter for a trial number, fixed by trial, name and seed."""
    u = uniform(trial, f"{name}{seed}")
    kind, *bounds = spec
    if kind == "choice":
        return F.element_at(F.array(*[F.lit(v) for v in bounds]), (F.floor(u * len(bounds)) + 1).cast("int"))
    low, high = bounds
    if kind == "int":
        return (F.floor(u * (high - low + 1)) + low).cast("int")
    if kind == "log_int":
        # rounded draw from the log range widened by a half at both ends
        a, b = np.log(low - 0.5), np.log(high + 0.5)
        return F.least(F.greatest(F.round(F.exp(F.lit(a) + u * (b - a))), F.lit(low)), F.lit(high)).cast("int")
    if kind == "float":
        return u * (high - low) + low
    if kind == "log_float":
        return F.exp(F.lit(np.log(low)) + u * (np.log(high) - np.log(low)))
    raise ValueError(kind)


def trial_table(numbers: DataFrame, space: Mapping[str, tuple], seed: int = 42) -> DataFrame:
    """Adds one column per parameter to a table of trial numbers ``trial``."""
    return numbers.select("trial", *[draw(F.col("trial"), n, s, seed).alias(n) for n, s in space.items()])


def random_trials(spark: SparkSession, model: str, n_trials: int, seed: int = 42, space: Mapping[str, tuple] | None = None) -> list[dict]:
    """Trials of the model's space; ``space`` replaces some of its parameters."""
    table = trial_table(spark.range(n_trials).withColumnRenamed("id", "trial"), {**SPACES[model], **(space or {})}, seed)
    return [r.asDict() for r in table.orderBy("trial").collect()]


SCHEMA = "trial long, value double, params map<string,string>, state string"


def trial_log(spark: SparkSession, results: list[tuple[int, float, Mapping]]) -> DataFrame:
    """``(trial, value, params, state)``: one row per trial made; a trial without a finite value has failed."""
    rows = [(int(t), float(v), {k: str(p) for k, p in params.items()}, _state(v)) for t, v, params in results]
    return spark.createDataFrame(rows, SCHEMA)


def _state(value: float) -> str:
    return "complete" if np.isfinite(value) else "failed"


def best_trial(trials: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Lowest value, the earlier trial where values are equal. Missing, infinite and NaN values come after all others."""
    value = F.col("value").cast("double")
    finite = F.coalesce(F.abs(value) < float("inf"), F.lit(False))
    order = F.struct((~finite).alias("unusable"), "value", "trial")
    return trials.groupBy(*(keys or [])).agg(
        F.min_by("trial", order).alias("trial"), F.min_by("value", order).alias("value"), F.min_by("params", order).alias("params")
    )


def winner(log: DataFrame):
    """The best trial's row; there must be one with a finite value."""
    row = best_trial(log).first()
    if row is None or row["value"] is None or not np.isfinite(row["value"]):
        raise ValueError("no trial has a finite value")
    return row


# What is sent to every task: the cross products of the folds, features squared each.
MAX_SENT_BYTES = 256 << 20


# Trials that are solved one after the other by descending strength; each such run is a task.
PATH_TRIALS = 64


def search_linear(
    spark: SparkSession, products: dict[int, linear.CrossProducts], family: str, n_trials: int, seed: int = 42, gap: float = linear.GAP
) -> tuple[DataFrame, dict, linear.LinearModel]:
    """Log, best parameters and the refit, from the fold cross products alone.

    The trials are ordered by strength and cut into paths; a task solves one path of one fold, all its trials and targets
    together. A fit ends at ``gap`` (see ``linear.elastic_net``); 0 fits to the last digit.
    """
    sent = sum(p.total.nbytes for p in products.values())
    if sent > MAX_SENT_BYTES:
        raise ValueError(f"the cross products of this many features take {sent} bytes")
    trials = random_trials(spark, family, n_trials, seed)
    ordered = sorted(trials, key=lambda t: (-t.get("alpha", 0.0), t["trial"]))
    pieces = [ordered[i : i + PATH_TRIALS] for i in range(0, n_trials, PATH_TRIALS)]
    tasks = [(at, fold, len(piece), [t["trial"] for t in piece]) for at, piece in enumerate(pieces) for fold in products]

    def solve(frames):
        import pandas as pd

        for frame in frames:
            for at, fold in zip(frame["path"], frame["fold"]):
                values = linear.fold_error(products, int(fold), family, pieces[int(at)], gap)
                yield pd.DataFrame({"trial": [t["trial"] for t in pieces[int(at)]], "fold": int(fold), "value": values})

    # one row per path and fold; the row number spreads them evenly over the tasks
    spread = spark.createDataFrame(tasks, "path int, fold int, n int, trials array<bigint>").repartitionByRange(len(tasks), "path", "fold")
    solved = spread.select("path", "fold").mapInPandas(solve, "trial long, fold int, value double")
    # n_trials rows, folds added in their order
    means = {r["trial"]: r["values"] for r in solved.groupBy("trial").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda v: v["value"]).alias("values")).collect()}
    results = [(t["trial"], float(np.mean(means[t["trial"]])), {k: v for k, v in t.items() if k != "trial"}) for t in trials]
    log = trial_log(spark, results)
    best = {k: float(v) for k, v in winner(log)["params"].items()}
    return log, best, linear.FAMILIES[family](linear.added(products), best, gap)


def search(
    spark: SparkSession,
    model: str,
    objective: Callable[[dict, int], float],
    n_trials: int,
    folds: int = 3,
    parallel: int = 2,
    seed: int = 42,
    space: Mapping[str, tuple] | None = None,
) -> tuple[DataFrame, dict]:
    """``objective(params, fold)`` is a Spark fit and score; trials run a few at a time.

    Each (trial, fold) is one set of Spark jobs over the whole training table, so a large
    cluster is filled by each of them; the pool only overlaps their driver-side gaps. Diverging trials
    are logged as failed.
    """
    trials = random_trials(spark, model, n_trials, seed, space)
    numbers = [t.pop("trial") for t in trials]
    with ThreadPoolExecutor(parallel) as pool:
        jobs = [[pool.submit(objective, t, k) for k in range(folds)] for t in trials]
        results = [(n, float(np.mean([j.result() for j in per])), t) for n, t, per in zip(numbers, trials, jobs)]
    log = trial_log(spark, results)
    return log, dict(zip(numbers, trials))[winner(log)["trial"]]
