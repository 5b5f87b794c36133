"""Consecutive numbers within a key, also when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

# A key above this many rows is numbered in blocks; a list of more heavy keys than
# the second bound is joined by shuffle instead of being broadcast.
HEAVY_ROWS = 1_000_000
MAX_BROADCAST_KEYS = 10_000


def number_in_blocks(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[Column | str], out: str) -> DataFrame:
    """Numbers 0.. within ``keys``, ordered by ``block`` and then ``order``.

    Rows are sorted per (key, block); the size of the earlier blocks is added.
    """
    part = [*keys, block]
    local = df.withColumn("_in_block", F.row_number().over(W.partitionBy(*part).orderBy(*order)) - 1)
    earlier = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        local.join(offsets, part)
        .withColumn(out, (F.col("_before") + F.col("_in_block")).cast("bigint"))
        .drop("_in_block", "_before")
    )


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column | str],
    out: str,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """``row_number() - 1`` within ``keys`` over (``block``, ``order``).

    One pass over the key columns finds heavy keys. Without any, this is a plain
    window; heavy keys take ``number_in_blocks`` and keep the same numbers.
    """
    keys = list(keys)
    rows = df.withColumn("_block", block)
    plain = F.row_number().over(W.partitionBy(*keys).orderBy("_block", *order)) - 1
    heavy = df.groupBy(*keys).count().filter(F.col("count") > heavy_rows).select(*keys)
    found = heavy.limit(MAX_BROADCAST_KEYS + 1).collect()
    if not found:
        return rows.withColumn(out, plain.cast("bigint")).drop("_block")
    if len(found) <= MAX_BROADCAST_KEYS:
        schema = T.StructType([df.schema[k] for k in keys])
        heavy = F.broadcast(df.sparkSession.createDataFrame(found, schema))
    light = rows.join(heavy, keys, "left_anti").withColumn(out, plain.cast("bigint"))
    split = number_in_blocks(rows.join(heavy, keys, "left_semi"), keys, "_block", order, out)
    return light.unionByName(split).drop("_block")


# Ranges whose sizes are sent to every task; more of them are joined by shuffle.
MAX_BROADCAST_RANGES = 100_000


def number_in_ranges(df: DataFrame, keys: Sequence[str], block: str, out: str) -> DataFrame:
    """Numbers 0.. within ``keys`` in the order in which rows come from files read in ranges of bytes.

    ``block`` is where a row's range begins. A range is read by one task from its start on, so a task numbers its rows as they come;
    the rows of the ranges before are counted apart. Only for rows that have not been moved since they were read.
    """
    part = [*keys, block]
    schema = T.StructType([*df.schema.fields, T.StructField("_nth", T.LongType())])

    def count(batches):
        import numpy as np
        import pyarrow as pa

        seen: dict[tuple, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # rows of a range stand together
            ids = [batch.column(k).dictionary_encode() for k in part]
            codes = [i.indices.to_numpy(zero_copy_only=False) for i in ids]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for c in codes:
                new[1:] |= c[1:] != c[:-1]
            first = np.flatnonzero(new)
            nth = np.empty(batch.num_rows, np.int64)
            for a, z in zip(first, np.append(first[1:], batch.num_rows)):
                key = tuple(i.dictionary[int(c[a])].as_py() for i, c in zip(ids, codes))
                nth[a:z] = seen.get(key, 0) + np.arange(z - a)
                seen[key] = int(nth[z - 1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], names=[*batch.schema.names, "_nth"])

    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).persist()
    if offsets.count() <= MAX_BROADCAST_RANGES:
        offsets = F.broadcast(offsets)
    numbered = df.mapInArrow(count, schema).join(offsets, part)
    return numbered.withColumn(out, (F.col("_before") + F.col("_nth")).cast("bigint")).drop("_nth", "_before")
