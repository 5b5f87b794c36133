"""Exploratory statistics: each is one aggregation over all its columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strucreg.operators.quantiles import exact_quantiles

Z_95 = NormalDist().inv_cdf(0.975)


def _rows(stats: DataFrame, structs: Sequence[Column]) -> DataFrame:
    return stats.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def confidence_interval(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """95% interval of each mean; the row count includes rows where the value is missing."""
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in columns],
    )

    def one(c: str) -> Column:
        margin = F.lit(Z_95) * F.col(f"s_{c}") / F.sqrt("n")
        lower, upper = F.col(f"m_{c}") - margin, F.col(f"m_{c}") + margin
        return F.struct(
            F.lit(c).alias("target"), lower.alias("lower"), upper.alias("upper"), (upper - lower).alias("width")
        )

    return _rows(stats, [one(c) for c in columns])


def correlations(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Pearson ``r`` and pair count ``n`` for every feature and target, pairwise complete."""
    rows = [F.struct(F.lit(a).alias("feature"), F.col(a).alias("x")) for a in features]
    # one narrow group per feature keeps the aggregate inside generated code
    long = df.select(F.explode(F.array(*rows)).alias("f"), *targets).select("f.*", *targets)
    both = {b: F.col("x").isNotNull() & F.col(b).isNotNull() for b in targets}
    stats = long.groupBy("feature").agg(
        *[F.corr("x", b).alias(f"r_{b}") for b in targets], *[F.count_if(both[b]).alias(f"n_{b}") for b in targets]
    )
    pairs = [
        F.struct(F.lit(b).alias("target"), F.col(f"r_{b}").alias("r"), F.col(f"n_{b}").alias("n")) for b in targets
    ]
    return stats.select("feature", F.explode(F.array(*pairs)).alias("p")).select("feature", "p.*")


def rank_features(corr: DataFrame, how: str) -> DataFrame:
    """Features by mean or max absolute correlation, strongest first."""
    strength = {"mean": F.avg, "max": F.max}[how](F.abs("r")).alias("strength")
    return corr.groupBy("feature").agg(strength).orderBy(F.desc("strength"), "feature")


@F.pandas_udf(T.DoubleType())
def _two_sided_p(t, dof):
    import numpy as np
    import pandas as pd

    return pd.Series([t_test_p(a, b) for a, b in zip(t.to_numpy(np.float64), dof.to_numpy(np.float64))])


def t_test_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t: the density's tail by double-exponential quadrature, the same for any number of degrees of freedom."""
    import math

    import numpy as np

    if math.isnan(t) or math.isnan(dof) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    # the tail from |t| on as an integral over all distances, which exp(pi/2 sinh k) spreads over a short range of k
    k = np.arange(-416, 417) / 64
    distance = np.exp(math.pi / 2 * np.sinh(k))
    with np.errstate(over="ignore"):
        u = abs(t) + distance
        density = np.exp(-(dof + 1) / 2 * np.log1p(u * u / dof))
        area = float(np.sum(np.where(density > 0, density * distance * np.cosh(k), 0.0))) * math.pi / 2 / 64
    return min(1.0, 2 * area * math.exp(_log_gamma_step(dof / 2)) / math.sqrt(dof * math.pi))


def _log_gamma_step(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)); the difference of two logarithms would lose its digits for large a."""
    import math

    if a < 50:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5) + 17 / (14336 * a**7)


def correlation_p_values(corr: DataFrame) -> DataFrame:
    """t statistic and two-sided p-value of each correlation (a handful of rows)."""
    dof = F.col("n") - 2
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))
    t = F.when(F.abs(r) < 1, r * F.sqrt(dof / (1 - r * r))).otherwise(r * float("inf"))
    with_t = corr.withColumn("t", t)
    return with_t.withColumn("p", _two_sided_p(F.col("t"), dof.cast("double")))


def value_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest value per column; a constant column is widened by a half each way."""
    row = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]).first()
    ranges = {}
    for c in columns:
        low, high = row[f"lo_{c}"], row[f"hi_{c}"]
        if low is not None:
            ranges[c] = (low, high) if low < high else (low - 0.5, high + 0.5)
    return ranges


def _bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin, the last one closed; NULL stays NULL."""
    width = (high - low) / bins
    guess = F.least(F.floor((value - low) / (high - low) * bins).cast("int"), F.lit(bins - 1))
    # keep a value on the right side of the edges as they are printed
    shifted = (
        F.when(value < F.lit(low) + guess * width, guess - 1)
        .when((guess < bins - 1) & (value >= F.lit(low) + (guess + 1) * width), guess + 1)
        .otherwise(guess)
    )
    # least() passes over NULL, so missing values are kept out here
    return F.when(value.isNotNull(), shifted)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """``(feature, bin, lower, upper, n)`` with empty bins kept."""
    ranges = value_ranges(df, columns)
    # column and bin share one integer, so the map-side combine groups by a number
    cells = [F.lit(i * bins) + _bin(F.col(c), *ranges[c], bins) for i, c in enumerate(ranges)]
    counts = df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = df.sparkSession.createDataFrame(
        [
            (i * bins + k, c, k, lo + k * ((hi - lo) / bins), hi if k == bins - 1 else lo + (k + 1) * ((hi - lo) / bins))
            for i, (c, (lo, hi)) in enumerate(ranges.items())
            for k in range(bins)
        ],
        "cell int, feature string, bin int, lower double, upper double",
    )
    return grid.join(counts, "cell", "left").select(
        "feature", "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n")
    )


def pair_grid(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Binned counts of every column against every other, and of each with itself.

    Each row meets each pair of columns once, and rows are combined before the shuffle
    into at most ``bins ** 2`` cells per pair.
    """
    ranges = value_ranges(df, columns)
    binned = df.select(*[_bin(F.col(c), *ranges[c], bins).alias(c) for c in ranges])
    pairs = list(combinations_with_replacement(ranges, 2))
    cells = [F.lit(i * bins * bins) + F.col(a) * bins + F.col(b) for i, (a, b) in enumerate(pairs)]
    counts = binned.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("n")
    )
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return (
        counts.withColumn("pair", F.floor(F.col("cell") / (bins * bins)).cast("int"))
        .join(names, "pair")
        .select(
            "a",
            "b",
            F.floor(F.col("cell") % (bins * bins) / bins).cast("int").alias("bin_a"),
            (F.col("cell") % bins).alias("bin_b"),
            "n",
        )
    )


def boxplot_stats(df: DataFrame, columns: Sequence[str], **quantile_options) -> DataFrame:
    """Quartiles, whiskers within 1.5 times the quartile distance, and flier count."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], **quantile_options)
    found = [c for c in columns if quartiles[c][0] is not None]
    aggregates = []
    for c in found:
        q1, _, q3 = quartiles[c]
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        aggregates += [
            F.least(F.min(F.when(F.col(c) >= low, F.col(c))), F.lit(q1)).alias(f"lo_{c}"),
            F.greatest(F.max(F.when(F.col(c) <= high, F.col(c))), F.lit(q3)).alias(f"hi_{c}"),
            F.count(F.when((F.col(c) < low) | (F.col(c) > high), 1)).alias(f"out_{c}"),
        ]
    stats = df.agg(*aggregates)
    return _rows(
        stats,
        [
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(quartiles[c][0]).alias("q1"),
                F.lit(quartiles[c][1]).alias("median"),
                F.lit(quartiles[c][2]).alias("q3"),
                F.col(f"lo_{c}").alias("whisker_low"),
                F.col(f"hi_{c}").alias("whisker_high"),
                F.col(f"out_{c}").alias("n_fliers"),
            )
            for c in found
        ],
    )


def iqr_flags(df: DataFrame, keys: Sequence[str], columns: Sequence[str], **quantile_options) -> DataFrame:
    """True where a value lies strictly outside 1.5 quartile distances; missing gives False."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.75], **quantile_options)

    def flag(c: str) -> Column:
        q1, q3 = quartiles[c]
        if q1 is None:
            return F.lit(False)
        reach = 1.5 * (q3 - q1)
        return F.coalesce((F.col(c) < q1 - reach) | (F.col(c) > q3 + reach), F.lit(False))

    return df.select(*keys, *[flag(c).alias(c) for c in columns])


def flag_counts(flags: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = flags.agg(*[F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(c) for c in columns])
    return _rows(stats, [F.struct(F.lit(c).alias("feature"), F.col(c).alias("n_outliers")) for c in columns])
