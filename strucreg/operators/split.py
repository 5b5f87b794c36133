"""Deterministic hold-out splits and folds from hashed keys, and the last rows of an order.

A hash bucket needs no sort, no count and no shuffle, and gives each row the same
side whatever the order or partitioning of the input. Sizes are close to, not
exactly, the requested share.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from strucreg.functions.columns import bucket

SEED = 42


def holdout(key: Column, seed: int = SEED) -> Column:
    """'test' for a tenth of the keys, else 'train'."""
    return F.when(bucket(key, f"test{seed}", 10) == 0, "test").otherwise("train")


def three_way(key: Column, seed: int = SEED) -> Column:
    """A tenth for test, a tenth of the remainder for val."""
    return (
        F.when(bucket(key, f"test{seed}", 10) == 0, "test")
        .when(bucket(key, f"val{seed}", 10) == 0, "val")
        .otherwise("train")
    )


def validation_part(key: Column, seed: int = SEED) -> Column:
    """True for the tenth of the training rows that watches the epochs."""
    return bucket(key, f"watch{seed}", 10) == 0


# Pivots of a pass; each pass makes the part that holds the rank about that many times smaller.
PIVOTS = 64


def tail_start(df: DataFrame, keys: Sequence[str], share: float = 0.1, pivots: int = PIVOTS) -> Row | None:
    """The first key of the last ``share`` of the rows in the order of ``keys``, None for no rows.

    Any orderable columns will do. A pass counts the rows between (and at) some pivots drawn from the part that holds the wanted rank
    and goes on inside the interval where it lies: nothing is sorted, and what reaches the driver are the pivots and their counts.
    """
    keys = list(keys)
    rows = df.select(F.struct(*keys).alias("k"))
    n = rows.count()
    if not n:
        return None
    rank = math.floor(n * (1.0 - share))
    if rank >= n:
        return None
    low = high = None

    def value(row: Row) -> Column:
        return F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, row)])

    while True:
        part = rows
        if low is not None:
            part = part.filter(F.col("k") > value(low))
        if high is not None:
            part = part.filter(F.col("k") < value(high))
        drawn = [r["k"] for r in part.withColumn("u", F.rand(n + rank)).orderBy("u").limit(pivots).select("k").collect()]
        # put in order by the engine, whose order of keys is the one that counts
        table = df.sparkSession.createDataFrame([tuple(r) for r in set(drawn)], df.select(*keys).schema)
        ordered = [tuple(r) for r in table.orderBy(*keys).collect()]
        marks = F.array(*[value(p) for p in ordered])
        place = 2 * F.size(F.filter(marks, lambda p: p < F.col("k"))) + F.array_contains(marks, F.col("k")).cast("int")
        counts = {r["place"]: r["n"] for r in part.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for at in range(2 * len(ordered) + 1):
            here = counts.get(at, 0)
            if rank < here:
                break
            rank -= here
        if at % 2:  # a pivot itself
            return Row(*keys)(*ordered[at // 2])
        low, high = ordered[at // 2 - 1] if at else low, ordered[at // 2] if at // 2 < len(ordered) else high


def tail_part(df: DataFrame, keys: Sequence[str], share: float = 0.1) -> Column:
    """True for the last ``share`` of the rows in the order of ``keys``. Rows that share the first key of the tail are all in it."""
    start = tail_start(df, keys, share)
    if start is None:
        return F.lit(False)
    return F.struct(*keys) >= F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, start)])


def kfold(key: Column, k: int = 3, seed: int = SEED) -> Column:
    return bucket(key, f"fold{seed}", k)


def split_sizes(df: DataFrame, column: str = "split") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
