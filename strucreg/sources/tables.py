"""Observation tables, result files, trial logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strucreg.functions.columns import FEATURES, TARGETS, is_missing, nan_to_null, to_numeric


def _read(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Quotes within a quoted value are doubled. ``multi_line`` allows line ends in values; such a file is read by one task."""
    return spark.read.option("header", True).option("encoding", "utf-8").option("escape", '"').option("multiLine", multi_line).csv(path)


def read_observations(
    spark: SparkSession,
    path: str,
    numeric: Sequence[str] = ("mass_au", *FEATURES, *TARGETS),
    keep: Sequence[str] = ("name",),
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text with a header; columns are found by name, numbers cast, NaN made missing.

    No schema inference: the file is read once, by the query that uses it.
    """
    raw = _read(spark, path, multi_line)
    return nan_to_null(raw.select(*keep, *[to_numeric(c).alias(c) for c in numeric]), numeric)


def unreadable_numbers(spark: SparkSession, path: str, numeric: Sequence[str], keep: Sequence[str] = ("name",), multi_line: bool = False) -> DataFrame:
    """Rows with text in a numeric column that is no number, and which columns they are."""
    return bad_numbers(_read(spark, path, multi_line), numeric, keep)


def bad_numbers(raw: DataFrame, numeric: Sequence[str], keep: Sequence[str]) -> DataFrame:
    flags = [F.when(~is_missing(c) & to_numeric(c).isNull(), F.lit(c)) for c in numeric]
    return raw.withColumn("bad_columns", F.array_compact(F.array(*flags))).filter(F.size("bad_columns") > 0).select(*keep, "bad_columns")


def write_csv(df: DataFrame, path: str) -> None:
    """Header and rows, no index column; a folder of part files."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def split_valid(df: DataFrame, valid: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows; a NULL verdict is a bad row."""
    verdict = F.coalesce(F.col(valid), F.lit(False))
    return df.filter(verdict).drop(valid), df.filter(~verdict).drop(valid)
