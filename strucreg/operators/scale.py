"""Standard and min-max scaling with parameters kept as a small table.

The library scalers of MLlib are not used: their deviation is the sample one and
they treat constant columns differently from what is needed here (scale 1).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Params = Mapping[str, tuple[float, float]]


def fit_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mean, scale)``: mean and population deviation, one aggregation for all columns."""
    stats = df.agg(
        *[F.avg(c).alias(f"avg_{c}") for c in columns],
        *[_scale_or_one(F.stddev_pop(c), F.min(c), F.max(c)).alias(f"scale_{c}") for c in columns],
    )
    return _stack(stats, columns, ("mean", "avg_"), ("scale", "scale_"))


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, min, range)`` with range 1 for a constant column."""
    stats = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns],
        *[_scale_or_one(F.max(c) - F.min(c), F.min(c), F.max(c)).alias(f"range_{c}") for c in columns],
    )
    return _stack(stats, columns, ("min", "lo_"), ("range", "range_"))


def _scale_or_one(spread: Column, low: Column, high: Column) -> Column:
    return F.when(low == high, F.lit(1.0)).otherwise(spread)


def _stack(stats: DataFrame, columns: Sequence[str], *values: tuple[str, str]) -> DataFrame:
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(prefix + c).alias(name) for name, prefix in values])
        for c in columns
    ]
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def as_params(table: DataFrame) -> dict[str, tuple[float, float]]:
    """The fitted table as a driver-side dict: one entry per column, never per row."""
    return {r[0]: (float(r[1]), float(r[2])) for r in table.collect()}


def transform(df: DataFrame, params: Params) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in params.items() if c in df.columns})


def inverse(df: DataFrame, params: Params, prefix: str = "") -> DataFrame:
    return df.withColumns(
        {prefix + c: F.col(prefix + c) * s + m for c, (m, s) in params.items() if prefix + c in df.columns}
    )


def fit_standard_array(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """``(pos, mean, scale)`` per array slot: one pass, one vector buffer per task.

    ``weight`` counts a row as that many equal rows (a graph's values once per node).
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(array_to_vector(F.col(column)).alias("v"), w.alias("w"))
    metrics = Summarizer.metrics("mean", "variance", "min", "max").summary(F.col("v"), F.col("w"))
    summary = rows.agg(metrics.alias("s"), F.sum("w").alias("sum_w"), F.sum(F.col("w") * F.col("w")).alias("sum_w2"))
    parts = summary.select(
        # the summary's variance is the unbiased one
        (1 - F.col("sum_w2") / (F.col("sum_w") * F.col("sum_w"))).alias("to_population"),
        *[vector_to_array(F.col(f"s.{k}")).alias(k) for k in ("mean", "variance", "min", "max")],
    )
    scale = _scale_or_one(F.sqrt(F.col("a.variance") * F.col("to_population")), F.col("a.min"), F.col("a.max"))
    slots = parts.select("to_population", F.posexplode(F.arrays_zip("mean", "variance", "min", "max")).alias("pos", "a"))
    return slots.select("pos", F.col("a.mean").alias("mean"), scale.alias("scale"))


def as_vectors(table: DataFrame) -> tuple[list[float], list[float]]:
    """Shift and scale lists in slot order (width of the feature vector, not of the data)."""
    rows = sorted(table.collect(), key=lambda r: r[0])
    return [float(r[1]) for r in rows], [float(r[2]) for r in rows]


def _literal_array(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def transform_array(column: Column, mean: Sequence[float], scale: Sequence[float]) -> Column:
    shift, width = _literal_array(mean), _literal_array(scale)
    return F.transform(column, lambda v, i: (v - F.get(shift, i)) / F.get(width, i))


def inverse_array(column: Column, mean: Sequence[float], scale: Sequence[float]) -> Column:
    shift, width = _literal_array(mean), _literal_array(scale)
    return F.transform(column, lambda v, i: v * F.get(width, i) + F.get(shift, i))


def select_scaled(df: DataFrame, keys: Sequence[str], *tables: Params) -> DataFrame:
    """Keys and every fitted column, scaled; other columns are pruned."""
    columns = reduce(lambda a, b: a + b, [list(t) for t in tables], [])
    out = df.select(*keys, *columns)
    for t in tables:
        out = transform(out, t)
    return out
