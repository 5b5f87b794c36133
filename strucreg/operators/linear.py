"""Least squares, ridge, lasso and elastic net for several targets at once.

One pass over the data builds the cross-product matrix of (1, features, targets) per fold.
It has the size of the feature list squared, and every penalised fit, trial and validation error
follows from it: the data is not read again, however many trials are made.

Plain least squares has no penalty to hide that products square the condition number, so it comes from a triangular factor of
the rows instead (``triangular_factor``), of the same size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strucreg.operators import paths
from strucreg.operators.partial_sums import matrix, sum_vectors, vector_rows


@dataclass
class CrossProducts:
    """Sums of products of (1, features, targets) over some rows; they add and subtract."""

    total: np.ndarray
    n_targets: int

    def __add__(self, other):
        return CrossProducts(self.total + other.total, self.n_targets)

    def __sub__(self, other):
        return CrossProducts(self.total - other.total, self.n_targets)

    @property
    def n(self) -> float:
        return float(self.total[0, 0])

    def centered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature means, target means, centred X'X and X'y."""
        d = len(self.total) - 1 - self.n_targets
        means = self.total[0, 1:] / self.n
        spread = self.total[1:, 1:] - self.n * np.outer(means, means)
        return means[:d], means[d:], spread[:d, :d], spread[:d, d:]

    def squared_errors(self, model: LinearModel) -> np.ndarray:
        """Mean squared error per target of ``model`` on the summed rows."""
        d = len(model.coef)
        beta = np.vstack([model.intercept, model.coef])
        a, b = self.total[: d + 1, : d + 1], self.total[: d + 1, d + 1 :]
        yy = np.diag(self.total[d + 1 :, d + 1 :])
        sse = yy - 2 * np.sum(beta * b, axis=0) + np.sum(beta * (a @ beta), axis=0)
        return np.maximum(sse, 0) / self.n


@dataclass
class LinearModel:
    coef: np.ndarray  # features x targets
    intercept: np.ndarray
    converged: bool = True

    def predict(self, features: Column) -> Column:
        """Array of predictions from an array of features."""
        coef, intercept = self.coef, self.intercept

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def apply(x):
            import numpy as np
            import pandas as pd

            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.stack(x.to_numpy()) @ coef + intercept))

        return apply(features)

    def predict_columns(self, features: Sequence[str], names: Sequence[str]) -> dict[str, Column]:
        """The same as plain column arithmetic, for a short feature list."""
        out = {}
        for j, name in enumerate(names):
            total = F.lit(float(self.intercept[j]))
            for i, f in enumerate(features):
                total = total + F.col(f) * float(self.coef[i, j])
            out[name] = total
        return out

    def table(self, spark: SparkSession, targets: Sequence[str], features: Sequence[str]) -> DataFrame:
        rows = [
            (t, float(self.intercept[j]), f, float(self.coef[i, j]))
            for j, t in enumerate(targets)
            for i, f in enumerate(features)
        ]
        return spark.createDataFrame(rows, "target string, intercept double, feature string, coefficient double")


def cross_products(
    df: DataFrame, features: Sequence[str] | str, targets: Sequence[str], fold: Column | None = None
) -> dict[int, CrossProducts]:
    """Cross products per fold (fold 0 without ``fold``). ``features`` is an array column or a column list."""
    x = F.col(features) if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])
    one = F.array(F.lit(1.0))
    rows = df.select(
        F.concat(one, x, F.array(*targets)).alias("v"),
        (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
    )

    def task(batches):
        import numpy as np

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v, folds = matrix(batch.column("v")), batch.column("fold").to_numpy()
            for k in np.unique(folds):
                part = v[folds == k]
                product = part.T @ part
                sums[int(k)] = sums[int(k)] + product if int(k) in sums else product
        yield vector_rows(sums)

    totals = sum_vectors(rows, task)
    width = int(round(len(next(iter(totals.values()))) ** 0.5))
    return {k: CrossProducts(v.reshape(width, width), len(targets)) for k, v in sorted(totals.items())}


def _model(products: CrossProducts, coef: np.ndarray, converged: bool = True) -> LinearModel:
    mean_x, mean_y, _, _ = products.centered()
    return LinearModel(coef, mean_y - mean_x @ coef, converged)


def ols(products: CrossProducts) -> LinearModel:
    """Least squares; the shortest solution where the features are dependent."""
    _, _, xx, xy = products.centered()
    return _model(products, np.linalg.pinv(xx, rcond=1e-12, hermitian=True) @ xy)


def ridge(products: CrossProducts, alpha: float) -> LinearModel:
    """Minimises the squared error plus ``alpha`` times the squared weights."""
    _, _, xx, xy = products.centered()
    return _model(products, np.linalg.solve(xx + alpha * np.eye(len(xx)), xy))


def moments(products: CrossProducts) -> paths.Moments:
    _, mean_y, xx, xy = products.centered()
    yy = np.diag(products.total)[1 + len(xx) :] / products.n - mean_y**2
    return paths.Moments(xx / products.n, xy / products.n, yy)


def elastic_net(products: CrossProducts, alpha: float, l1_ratio: float, max_iter: int = 100_000, tol: float = 1e-12, gap: float = 0.0) -> LinearModel:
    """Minimises half the mean squared error plus ``alpha`` times the mixed penalty.

    The model says whether every target ended: its duality gap is at most ``gap`` times its mean square, or the last sweep changed
    no weight by more than ``tol``.
    """
    weights, ended = paths.elastic_path(moments(products), [alpha], [l1_ratio], gap=gap, settled=tol, max_iter=max_iter)
    return _model(products, weights[0], bool(ended[0]))


def lasso(products: CrossProducts, alpha: float, **options) -> LinearModel:
    return elastic_net(products, alpha, 1.0, **options)


# Fixed value: the share of a target's mean square at which the gap of a trial is small enough.
GAP = 1e-4

# Name of each family and how it is fitted from its parameters and the gap at which it may end.
FAMILIES = {
    "ols": lambda products, params, gap=GAP: ols(products),
    "ridge": lambda products, params, gap=GAP: ridge(products, params["alpha"]),
    "lasso": lambda products, params, gap=GAP: lasso(products, params["alpha"], gap=gap),
    "elastic_net": lambda products, params, gap=GAP: elastic_net(products, params["alpha"], params["l1_ratio"], gap=gap),
}


def trial_models(products: CrossProducts, family: str, trials: Sequence[dict], gap: float = GAP) -> list[LinearModel]:
    """The models of many trials, solved together where the family has a way."""
    if family == "ridge":
        _, _, xx, xy = products.centered()
        return [_model(products, w) for w in paths.ridge_path(xx, xy, [t["alpha"] for t in trials])]
    if family in ("lasso", "elastic_net"):
        ratios = [1.0 if family == "lasso" else t["l1_ratio"] for t in trials]
        weights, ended = paths.elastic_path(moments(products), [t["alpha"] for t in trials], ratios, gap=gap)
        return [_model(products, w, bool(e)) for w, e in zip(weights, ended)]
    return [FAMILIES[family](products, t) for t in trials]


def added(products: dict[int, CrossProducts]) -> CrossProducts:
    return sum(list(products.values())[1:], next(iter(products.values())))


def fold_error(products: dict[int, CrossProducts], fold: int, family: str, trials: Sequence[dict], gap: float = GAP) -> list[float]:
    """Per trial: fit on the other folds, mean squared error over all targets on this one."""
    held_out = products[fold]
    return [float(np.mean(held_out.squared_errors(m))) for m in trial_models(added(products) - held_out, family, trials, gap)]


def fold_errors(products: dict[int, CrossProducts], family: str, params: dict) -> list[float]:
    """The errors of one trial, fold by fold."""
    return [fold_error(products, fold, family, [params])[0] for fold in products]


# --- least squares from a triangular factor ------------------------------------

# Rows taken into a factor at a time, and the meeting places of the first round.
_BLOCK, _MEETING = 4096, 256


def _folded(factor: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows added to those of ``factor``."""
    stacked = rows if factor is None else np.vstack([factor, rows])
    return np.linalg.qr(stacked, mode="r") if len(stacked) > 1 else stacked


def triangular_factor(df: DataFrame, features: Sequence[str] | str, targets: Sequence[str]) -> np.ndarray:
    """R of the QR factorisation of the rows (1, features, targets).

    Every task folds its rows into one factor, factors meet in at most ``_MEETING`` tasks that fold them as they come, then in
    a sixteenth of that, then on the driver: its share is sixteen factors whatever the data.
    """
    x = F.col(features) if isinstance(features, str) else F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(F.concat(F.array(F.lit(1.0)), x, F.array(*targets)).alias("v"))
    schema = "part int, factor array<double>"

    def table(factor, part: int):
        import pyarrow as pa

        flat = pa.array([np.ravel(f) for f in ([] if factor is None else [factor])], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([part] * len(flat), pa.int32()), flat], names=["part", "factor"])

    def fold_rows(batches):
        from pyspark import TaskContext

        factor = None
        for batch in batches:
            v = matrix(batch.column("v"))
            for at in range(0, len(v), _BLOCK):
                factor = _folded(factor, v[at : at + _BLOCK])
        yield table(factor, TaskContext.get().partitionId() % _MEETING)

    def fold_factors(batches):
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, flat in zip(batch.column("part").to_pylist(), batch.column("factor")):
                values = flat.values.to_numpy(zero_copy_only=False)
                merged[part] = _folded(merged.get(part), values.reshape(-1, width))
        for part, factor in merged.items():
            yield table(factor, part // 16)

    first = rows.first()
    if first is None:
        raise ValueError("no rows")
    width = len(first["v"])
    factors = rows.mapInArrow(fold_rows, schema)
    for _ in range(2):
        factors = factors.repartition("part").mapInArrow(fold_factors, schema)
    whole = None
    for row in factors.toLocalIterator():
        whole = _folded(whole, np.array(row["factor"]).reshape(-1, width))
    return whole


def least_squares(df: DataFrame, features: Sequence[str] | str, targets: Sequence[str], rcond: float = 1e-13) -> LinearModel:
    """Least squares from the triangular factor; the shortest solution where the features are dependent.

    The first row of the factor holds the means, the rest is the factor of the centred rows. Singular values below ``rcond`` times
    the largest count as none.
    """
    factor = triangular_factor(df, features, targets)
    d = factor.shape[1] - 1 - len(targets)
    means = factor[0, 1:] / factor[0, 0]
    coef = np.linalg.lstsq(factor[1 : 1 + d, 1 : 1 + d], factor[1 : 1 + d, 1 + d :], rcond=rcond)[0] if len(factor) > 1 else np.zeros((d, len(targets)))
    return LinearModel(coef, means[d:] - means[:d] @ coef)
