"""Ragged coordinate arrays to fixed-width feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten_long(atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row-major positions without building any group: ``(keys, pos, value)``.

    A narrow map, so a structure of any size stays spread over its input partitions.
    """
    return atoms.select(
        *keys,
        F.col("atom_idx"),
        F.posexplode(F.array("x", "y", "z")).alias("axis", "value"),
    ).select(*keys, (F.col("atom_idx") * 3 + F.col("axis")).cast("bigint").alias("pos"), "value")


def structure_sizes(atoms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flattened length per structure (map-side combined)."""
    return atoms.groupBy(*keys).agg((F.count(F.lit(1)) * 3).alias("n_values"))


def max_length(atoms: DataFrame, keys: Sequence[str]) -> int:
    row = structure_sizes(atoms, keys).agg(F.max("n_values").alias("m")).first()
    return int(row["m"] or 0)


def flatten(atoms: DataFrame, keys: Sequence[str], max_values: int | None, out: str = "coords") -> DataFrame:
    """Row-major ``[3n]`` array per structure of at most ``max_values`` numbers.

    Longer structures are kept out before anything is collected; take them from
    ``over_length`` and work on them through ``flatten_long``. None skips the check, for
    structures whose size is bounded by their source.
    """
    if max_values is not None:
        fitting = structure_sizes(atoms, keys).filter(F.col("n_values") <= max_values).select(*keys)
        atoms = atoms.join(fitting, list(keys), "left_semi")
    lists = atoms.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("atom_idx", F.array("x", "y", "z").alias("xyz")))).alias("_a")
    )
    return lists.select(*keys, F.flatten(F.col("_a.xyz")).alias(out))


def over_length(atoms: DataFrame, keys: Sequence[str], max_values: int) -> DataFrame:
    return structure_sizes(atoms, keys).filter(F.col("n_values") > max_values)


def pad(array: Column, length: int) -> Column:
    """Zeros appended up to ``length``; a longer array gives NULL rather than a cut one."""
    return F.when(
        F.size(array) <= length,
        F.concat(array, F.array_repeat(F.lit(0.0), F.lit(length) - F.size(array))),
    )


def expand(df: DataFrame, array: str, length: int, prefix: str = "coord_") -> DataFrame:
    """One column per slot beside the other columns (an export form, models take the array)."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, *[F.col(array)[i].alias(f"{prefix}{i}") for i in range(length)])
