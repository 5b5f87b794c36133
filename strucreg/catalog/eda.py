"""Exploratory queries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from strucreg.catalog.common import rounded
from strucreg.catalog.sql import GAPS, OBS, X, Y, long_rows, rnd, three_way, union_all
from strucreg.functions.columns import to_long
from strucreg.operators import eda, evaluate, split
from strucreg.plans import bindings as b

XY = [*X, *Y]


def _kept(spark, sf_dir):
    """For statistics that read their rows more than once."""
    return b.observations_with_gaps(spark, sf_dir).persist()


def confidence_interval(spark, sf_dir):
    out = eda.confidence_interval(b.observations_with_gaps(spark, sf_dir), Y)
    return rounded(out, ["lower", "upper", "width"], 4)


def _corr(spark, sf_dir):
    return eda.correlations(b.observations_with_gaps(spark, sf_dir), X, Y)


def corr_block(spark, sf_dir):
    return rounded(_corr(spark, sf_dir).select("feature", "target", "r"), ["r"])


def rank_mean_abs_corr(spark, sf_dir):
    return rounded(eda.rank_features(_corr(spark, sf_dir), "mean"), ["strength"])


def rank_max_abs_corr(spark, sf_dir):
    return rounded(eda.rank_features(_corr(spark, sf_dir), "max"), ["strength"])


def corr_pvalues(spark, sf_dir):
    out = eda.correlation_p_values(_corr(spark, sf_dir))
    return rounded(rounded(out, ["r", "p"], 6), ["t"], 4)


def histogram(spark, sf_dir):
    return rounded(eda.histogram(_kept(spark, sf_dir), XY), ["lower", "upper"], 4)


def pair_grid(spark, sf_dir):
    return eda.pair_grid(_kept(spark, sf_dir), XY)


def boxplot_stats(spark, sf_dir):
    out = eda.boxplot_stats(_kept(spark, sf_dir), XY)
    return rounded(out, ["q1", "median", "q3", "whisker_low", "whisker_high"], 4)


def iqr_flags(spark, sf_dir):
    return eda.iqr_flags(_kept(spark, sf_dir), ["idx"], XY)


def iqr_counts(spark, sf_dir):
    return eda.flag_counts(iqr_flags(spark, sf_dir), XY)


def scatter_long(spark, sf_dir):
    return rounded(to_long(b.observations_with_gaps(spark, sf_dir), ["idx"], XY, "feature", "value"), ["value"])


def identity_line(spark, sf_dir):
    return rounded(evaluate.identity_line(b.observations(spark, sf_dir), Y, names=Y), ["low", "high"], 4)


def split_sizes(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").select(split.three_way(F.col("o_orderkey")).alias("split"))
    sizes = split.split_sizes(orders)
    return sizes.unionByName(sizes.agg(F.lit("all").alias("split"), F.sum("n").alias("n")))


QUERIES = {
    f.__name__: f
    for f in (
        confidence_interval, corr_block, rank_mean_abs_corr, rank_max_abs_corr, corr_pvalues, histogram,
        pair_grid, boxplot_stats, iqr_flags, iqr_counts, scatter_long, identity_line, split_sizes,
    )
}

_Z = "1.959963984540054"
_CORR = GAPS + ",\ncorr AS (" + union_all(
    f"SELECT '{x}' AS feature, '{y}' AS target, corr({x}, {y}) AS r, "
    f"count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL) AS n FROM gaps"
    for x, y in product(X, Y)
) + ")"
# all 36 pairs in one aggregation; the tail of the density by Simpson's rule on 800 steps
_PVALUES = "WITH " + GAPS.replace("gaps AS (", "gaps AS MATERIALIZED (") + f""",
sums AS MATERIALIZED (SELECT [{', '.join(f"{{'feature': '{x}', 'target': '{y}', 'r': corr({x}, {y}), 'n': count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)}}" for x, y in product(X, Y))}] AS pairs FROM gaps),
corr AS (SELECT unnest(pairs, recursive := true) FROM sums),
tested AS (SELECT feature, target, r, n, r * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS dof FROM corr),
area AS (SELECT *, list_sum(list_transform(range(0, 801), lambda k: (CASE WHEN k IN (0, 800) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
  * pow(1 + pow(least(abs(t), 40) * k / 800, 2) / dof, -(dof + 1) / 2))) * least(abs(t), 40) / 800 / 3 AS s FROM tested)
SELECT feature, target, n, {rnd('r')} AS r, {rnd('t', 4)} AS t,
  {rnd('greatest(0, 1 - 2 * s * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()))')} AS p FROM area"""
_LONG = GAPS + ",\nlong AS (" + long_rows("gaps", XY) + ")"


def _bins(n: int) -> str:
    """Bin of each value, corrected against the printed edges as numpy does."""
    return f"""
ranges AS (
  SELECT feature, CASE WHEN min(value) < max(value) THEN min(value) ELSE min(value) - 0.5 END lo,
         CASE WHEN min(value) < max(value) THEN max(value) ELSE max(value) + 0.5 END hi
  FROM long GROUP BY feature),
guessed AS (
  SELECT idx, feature, value, lo, (hi - lo) / {n} AS w,
         least(floor((value - lo) / (hi - lo) * {n})::INT, {n - 1}) AS g
  FROM long JOIN ranges USING (feature) WHERE value IS NOT NULL),
binned AS (
  SELECT idx, feature, CASE WHEN value < lo + g * w THEN g - 1
                            WHEN g < {n - 1} AND value >= lo + (g + 1) * w THEN g + 1 ELSE g END AS bin
  FROM guessed)"""


_QUARTILES = """
quartiles AS (
  SELECT feature, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) median, quantile_cont(value, 0.75) q3
  FROM long GROUP BY feature)"""
_FLAGS = "\nflags AS (SELECT idx, " + ", ".join(
    f"coalesce({c} < (SELECT q1 - 1.5 * (q3 - q1) FROM quartiles WHERE feature = '{c}') "
    f"OR {c} > (SELECT q3 + 1.5 * (q3 - q1) FROM quartiles WHERE feature = '{c}'), false) AS {c}"
    for c in XY
) + " FROM gaps)"

SQL = {
    "confidence_interval": f"WITH {GAPS} " + union_all(
        f"SELECT '{y}' AS target, {rnd(f'avg({y}) - {_Z} * stddev_samp({y}) / sqrt(count(*))', 4)} AS lower, "
        f"{rnd(f'avg({y}) + {_Z} * stddev_samp({y}) / sqrt(count(*))', 4)} AS upper, "
        f"{rnd(f'2 * {_Z} * stddev_samp({y}) / sqrt(count(*))', 4)} AS width FROM gaps"
        for y in Y
    ),
    "corr_block": f"WITH {_CORR} SELECT feature, target, {rnd('r')} AS r FROM corr",
    "rank_mean_abs_corr": f"WITH {_CORR} SELECT feature, {rnd('avg(abs(r))')} AS strength FROM corr GROUP BY feature",
    "rank_max_abs_corr": f"WITH {_CORR} SELECT feature, {rnd('max(abs(r))')} AS strength FROM corr GROUP BY feature",
    # the tail area of Student's t by Simpson's rule on [0, |t|]
    "corr_pvalues": _PVALUES,
    "histogram": f"""WITH {_LONG}, {_bins(30)},
counts AS (SELECT feature, bin, count(*) AS n FROM binned GROUP BY feature, bin),
grid AS (SELECT feature, lo, hi, unnest(range(0, 30))::INT AS bin FROM ranges)
SELECT feature, bin, {rnd('lo + bin * ((hi - lo) / 30)', 4)} AS lower,
  {rnd('CASE WHEN bin = 29 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 30) END', 4)} AS upper, coalesce(n, 0) AS n
FROM grid LEFT JOIN counts USING (feature, bin)""",
    "pair_grid": f"""WITH {_LONG}, {_bins(10)},
placed AS (SELECT *, list_position([{', '.join(repr(c) for c in XY)}], feature) AS pos FROM binned)
SELECT l.feature AS a, r.feature AS b, l.bin AS bin_a, r.bin AS bin_b, count(*) AS n
FROM placed l JOIN placed r ON l.idx = r.idx AND l.pos <= r.pos GROUP BY ALL""",
    "boxplot_stats": f"""WITH {_LONG}, {_QUARTILES}
SELECT feature, {rnd('q1', 4)} AS q1, {rnd('median', 4)} AS median, {rnd('q3', 4)} AS q3,
  {rnd('least(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), q1)', 4)} AS whisker_low,
  {rnd('greatest(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), q3)', 4)} AS whisker_high,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_fliers
FROM long JOIN quartiles USING (feature) GROUP BY feature, q1, median, q3""",
    "iqr_flags": f"WITH {_LONG}, {_QUARTILES}, {_FLAGS} SELECT * FROM flags",
    "iqr_counts": f"WITH {_LONG}, {_QUARTILES}, {_FLAGS} " + union_all(
        f"SELECT '{c}' AS feature, coalesce(sum({c}::INT), 0)::BIGINT AS n_outliers FROM flags" for c in XY
    ),
    "scatter_long": f"WITH {_LONG} SELECT idx, feature, {rnd('value')} AS value FROM long",
    "identity_line": f"WITH {OBS} " + union_all(
        f"SELECT '{y}' AS target, {rnd(f'min({y})', 4)} AS low, {rnd(f'max({y})', 4)} AS high FROM obs" for y in Y
    ),
    "split_sizes": f"""WITH s AS (SELECT {three_way('o_orderkey')} AS split FROM orders)
SELECT split, count(*) AS n FROM s GROUP BY split UNION ALL SELECT 'all', count(*) FROM s""",
}
