"""Exact linear-interpolated quantiles of many columns at any row count.

The built-in exact aggregate keeps every distinct value of a column in one buffer.
It is used only where the counted rows are few. Above that the rows are read twice: the first
reading makes a mergeable sketch per column, whose quantiles a little below and above a wanted one
bracket it; the second counts the values below each bracket and the different values within, a few
thousandths of all. What is left, a written table of values and counts, is narrowed down by counting: each pass cuts
the range around a rank into equal buckets and goes on inside the bucket that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strucreg.scratch import delete, scratch_path

BUFFERED_ROWS = 2_000_000
BUCKETS = 2048
# The sketch's rank error is one in this number of rows; brackets reach twice as far.
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    buffered_rows: int = BUFFERED_ROWS,
    buckets: int = BUCKETS,
) -> dict[str, list[float | None]]:
    """Quantiles per column, missing values skipped; an all-missing column gives None."""
    columns = list(columns)
    # NaN is a missing value here, as everywhere after loading
    df = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    beside = [min(1.0, max(0.0, p + s * 2 / ACCURACY)) for p in probabilities for s in (-1, 1)]
    row = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(c, beside, ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)],
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    if max(counts.values()) <= buffered_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        got = df.agg(*[F.percentile(c, wanted).alias(f"q{i}") for i, c in enumerate(columns)]).first()
        return {c: list(got[f"q{i}"] or [None] * len(probabilities)) for i, c in enumerate(columns)}

    ends = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}
    brackets: dict[tuple[str, int], tuple[float, float]] = {}
    for i, c in enumerate(columns):
        for j, p in enumerate(probabilities if counts[c] else ()):
            h = (counts[c] - 1) * p
            low, high = row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1]
            # at the ends the bracket goes to the end
            low = ends[c][0] if p - 2 / ACCURACY <= 0 else low
            high = ends[c][1] if p + 2 / ACCURACY >= 1 else high
            for rank in (math.floor(h), math.ceil(h)):
                old = brackets.get((c, rank), (low, high))
                brackets[c, rank] = (min(old[0], low), max(old[1], high))
    values: dict[tuple[str, int], float] = {}
    while brackets:
        found = _within(df, brackets, buckets)
        values.update(found)
        # a sketch that missed (it does not, within its error) costs another reading with the whole range
        brackets = {k: ends[k[0]] for k in brackets if k not in found}

    result: dict[str, list[float | None]] = {}
    for c in columns:
        if not counts[c]:
            result[c] = [None] * len(probabilities)
            continue
        out = []
        for p in probabilities:
            h = (counts[c] - 1) * p
            low, high = math.floor(h), math.ceil(h)
            a, b = values[c, low], values[c, high]
            # written like the built-in aggregate, so that both ways agree to the last bit
            out.append(a if low == high or a == b else (high - h) * a + (h - low) * b)
        result[c] = out
    return result


def _spread(v: Column) -> Column:
    """Non-decreasing in v, with equal room for every power of e on both sides of 0."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746.0))


def _place(v: float) -> float:
    return 0.0 if v == 0 else math.copysign(math.log(abs(v)) + 746.0, v)


def _interval(number: int, column: int, low: float, high: float) -> tuple:
    """How the values of an interval are laid out on buckets. Wide ones by logarithm; narrow ones linearly, both ends scaled to about 1
    by two powers of two, so that nothing overflows or vanishes. Each pass makes the range at least hundreds of times narrower: two passes by
    logarithm and six linear ones are enough for any two doubles."""
    a, b = _place(low), _place(high)
    if b - a > 1:
        return number, column, low, high, True, 1.0, 1.0, a, b - a
    exponent = -math.frexp(max(abs(low), abs(high)))[1]
    first, second = 2.0 ** (exponent // 2), 2.0 ** (exponent - exponent // 2)
    a, b = low * first * second, high * first * second
    return number, column, low, high, False, first, second, a, b - a


def _within(df: DataFrame, brackets: dict[tuple[str, int], tuple[float, float]], buckets: int) -> dict[tuple[str, int], float]:
    """One reading of ``df``: the values at the ranks (column, rank) that lie within their brackets."""
    spark = df.sparkSession
    pairs = sorted({(c, *b) for (c, _), b in brackets.items()})
    entries = []
    for k, (c, low, high) in enumerate(pairs):
        v, none = F.col(c), F.lit(None).cast("double")
        entries.append(F.when(v < low, F.struct(F.lit(k).alias("k"), none.alias("value"))).when(v <= high, F.struct(F.lit(k).alias("k"), v.alias("value"))))
    kept = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*").groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "quantiles")
    try:
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        inner = F.when(F.abs("value") < float("inf"), F.col("value"))
        facts = kept.groupBy("k").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("below"),
            F.coalesce(F.sum(F.when(F.col("value") == float("-inf"), F.col("n"))), F.lit(0)).alias("least"),
            F.coalesce(F.sum(F.when(inner.isNotNull(), F.col("n"))), F.lit(0)).alias("inside"),
            F.coalesce(F.sum(F.when(F.col("value") == float("inf"), F.col("n"))), F.lit(0)).alias("most"),
            F.min(inner).alias("lo"),
            F.max(inner).alias("hi"),
        )
        told = {r["k"]: r for r in facts.collect()}  # one row per bracket
        out: dict[tuple[str, int], float] = {}
        ranks: set[tuple[int, int]] = set()
        for (c, rank), b in brackets.items():
            k = pairs.index((c, *b))
            r = told.get(k)
            if r is None or rank < r["below"]:
                continue
            at = rank - r["below"]
            # infinities stand at both ends; only the finite values between are searched
            if at < r["least"]:
                out[c, rank] = float("-inf")
            elif at < r["least"] + r["inside"]:
                ranks.add((k, at - r["least"]))
            elif at < r["least"] + r["inside"] + r["most"]:
                out[c, rank] = float("inf")
        ranges = {k: (r["lo"], r["hi"]) for k, r in told.items() if r["inside"]}
        solved = _values_at_ranks(kept.filter(inner.isNotNull()).select(F.col("k").alias("column"), "value", "n"), ranks, ranges, buckets)
        for (c, rank), b in brackets.items():
            k = pairs.index((c, *b))
            if k in told and (k, rank - told[k]["below"] - told[k]["least"]) in solved:
                out[c, rank] = solved[k, rank - told[k]["below"] - told[k]["least"]]
        return out
    finally:
        delete(spark, path)


def _values_at_ranks(long: DataFrame, ranks, ranges, buckets) -> dict[tuple[int, int], float]:
    """Value at each (column, 0-based rank) in sort order of ``long`` (column, value, n); all values are finite."""
    solved: dict[tuple[int, int], float] = {}
    # rank -> (smallest value, largest value, rows below) of the interval that holds it
    open_ranks = {(c, r): (*ranges[c], 0) for c, r in ranks}
    if not open_ranks:
        return solved
    while True:
        for key, (low, high, _) in list(open_ranks.items()):
            if low == high:
                solved[key] = low
                del open_ranks[key]
        if not open_ranks:
            return solved
        intervals = sorted({(c, *interval) for (c, _), interval in open_ranks.items()})
        # a few intervals per column: bounded by the number of requested quantiles
        table = F.broadcast(
            long.sparkSession.createDataFrame(
                [_interval(i, c, float(lo), float(hi)) for i, (c, lo, hi, _) in enumerate(intervals)],
                "interval int, column int, lo double, hi double, by_log boolean, first double, second double, base double, width double",
            )
        )
        value = F.when(F.col("by_log"), _spread(F.col("value"))).otherwise(F.col("value") * F.col("first") * F.col("second"))
        position = (value - F.col("base")) / F.col("width") * buckets
        counted = (
            long.join(table, "column")
            .filter(F.col("value").between(F.col("lo"), F.col("hi")))
            .groupBy("interval", F.greatest(F.lit(0), F.least(F.floor(position), F.lit(buckets - 1))).alias("bucket"))
            .agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            .collect()
        )
        by_interval: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: (r["interval"], r["bucket"])):
            by_interval.setdefault(r["interval"], []).append(r)
        number = {interval: i for i, interval in enumerate(intervals)}
        for (c, rank), interval in list(open_ranks.items()):
            below = interval[2]
            for r in by_interval[number[(c, *interval)]]:
                if rank < below + r["n"]:
                    open_ranks[c, rank] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]
