"""Shared by the operators: the two character classes, written tables, parts of a table's columns."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strucreg.scratch import scratch_path

# White space is space and tab to carriage return, in every operator; words are what lies between.
SPACE = r"[ \t-\r]"
WORD = r"[^ \t-\r]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


# Folders of tables made in this process, in order.
_MADE: list[str] = []


class Tables:
    """Tables written below the shared checkpoint folder, so that later jobs neither recompute them nor
    depend on the executors that made them. ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_path(spark, label)
        _MADE.append(self.root)
        self.count = 0
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> str:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return path

    def read(self, path: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(path)

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.write(df)
        kept = self.read(path, df.schema)
        self.paths[id(kept)] = path
        return kept

    def settle(self, make: Callable[[], DataFrame]) -> DataFrame:
        """Keeps what ``make`` gives, and removes all tables that were made on the way to it."""
        before = len(_MADE)
        kept = self.keep(make())
        for root in _MADE[before:]:
            self.drop(root)
        del _MADE[before:]
        return kept

    def forget(self, kept: DataFrame) -> None:
        """Removes a kept table that nothing reads any more."""
        self.drop(self.paths.pop(id(kept)))

    def release(self) -> None:
        """Shuffle files of tables already written go when the driver collects its garbage; this asks for it."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def packed(docs: DataFrame, **columns: str) -> DataFrame:
    """The whole row as one column ``row`` beside the named ones, so that no other column's name can clash."""
    return docs.select(F.struct("*").alias("row"), *[F.col(c).alias(n) for n, c in columns.items()])


def in_batches(df: DataFrame, make: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | pa.Table], schema) -> DataFrame:
    """``mapInArrow`` with a function per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = make(batch)
                if isinstance(made, pa.RecordBatch):
                    yield made
                elif isinstance(made, pa.Table):
                    yield from made.to_batches()
                else:
                    yield from made

    return df.mapInArrow(run, schema)


def remainder(id_col: str, by: int) -> Column:
    """``crc32`` of the id as text modulo ``by``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by).cast("int")
