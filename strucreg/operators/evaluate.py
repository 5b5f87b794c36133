"""Result tables and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strucreg.functions.columns import PROPERTY_LABELS, RESULT_NAMES, four_decimals, point_color

# Fixed value: smallest denominator of the percentage error (machine epsilon).
EPSILON = 2.220446049250313e-16


def result_table(
    df: DataFrame,
    index: str,
    actual: Sequence[str],
    predicted: Sequence[str],
    names: Sequence[str] = RESULT_NAMES,
    color_below: int | None = 48,
) -> DataFrame:
    """``Index``, then ``Actual_*`` and ``Predicted_*`` side by side, then ``Color`` (left out for None)."""
    columns: list[Column] = [F.col(index).alias("Index")]
    for name, a, p in zip(names, actual, predicted):
        columns += [F.col(a).alias(f"Actual_{name}"), F.col(p).alias(f"Predicted_{name}")]
    if color_below is not None:
        columns.append(point_color(F.col(index), color_below).alias("Color"))
    return df.select(*columns)


def join_predictions(actual: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Actual and predicted rows meet on the row key, not on their position."""
    return actual.join(predicted, key)


def long_pairs(df: DataFrame, keys: Sequence[str], targets: Sequence[str], actual: Sequence[str], predicted: Sequence[str]) -> DataFrame:
    """``(keys, target, y, y_hat)``: one row per observation and target."""
    rows = [
        F.struct(F.lit(t).alias("target"), F.col(a).alias("y"), F.col(p).alias("y_hat"))
        for t, a, p in zip(targets, actual, predicted)
    ]
    return df.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")


def regression_metrics(pairs: DataFrame) -> DataFrame:
    """Five metrics per target in one aggregation; ``mape`` is a fraction."""
    error = F.col("y") - F.col("y_hat")
    sums = pairs.groupBy("target").agg(
        F.avg(error * error).alias("mse"),
        F.var_pop("y").alias("_var"),
        F.min("y").alias("_lo"),
        F.max("y").alias("_hi"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(F.abs(error) / F.greatest(F.abs(F.col("y")), F.lit(EPSILON))).alias("mape"),
    )
    constant = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("_lo") == F.col("_hi"), constant).otherwise(1 - F.col("mse") / F.col("_var"))
    return sums.select("target", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "mae", "mape")


def pooled_mae(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(F.abs(F.col("y") - F.col("y_hat"))).alias("mae"))


def mean_row_loss(pairs: DataFrame, key: str) -> DataFrame:
    """Mean over rows of the mean squared error over that row's targets."""
    squared = (F.col("y") - F.col("y_hat")) ** 2
    per_row = pairs.groupBy(key).agg(F.avg(squared).alias("loss"))
    return per_row.agg(F.avg("loss").alias("loss"))


def identity_line(df: DataFrame, actual: Sequence[str], names: Sequence[str] = RESULT_NAMES) -> DataFrame:
    """Both ends of the diagonal reference line per target."""
    stats = df.agg(*[F.min(a).alias(f"lo_{a}") for a in actual], *[F.max(a).alias(f"hi_{a}") for a in actual])
    rows = [
        F.struct(F.lit(n).alias("target"), F.col(f"lo_{a}").alias("low"), F.col(f"hi_{a}").alias("high"))
        for n, a in zip(names, actual)
    ]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def score_long(df: DataFrame, keys: Sequence[str], predicted: Sequence[str], labels: Sequence[str] = PROPERTY_LABELS) -> DataFrame:
    """Number, property and prediction as text with four decimals, one row per property."""
    rows = [
        F.struct(F.lit(i).alias("no"), F.lit(label).alias("property"), four_decimals(F.col(p)).alias("prediction"))
        for i, (label, p) in enumerate(zip(labels, predicted))
    ]
    return df.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.*")
