"""Rows meet their structures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MissingStructures(ValueError):
    pass


def missing_structures(rows: DataFrame, structures: DataFrame, key: str) -> DataFrame:
    return rows.join(structures.select(key), key, "left_anti")


def attach_structure(rows: DataFrame, atoms: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Each atom beside the values of its row. ``strict`` raises if a row has no structure;
    otherwise such rows are left to ``missing_structures``."""
    if strict:
        sample = missing_structures(rows, atoms, key).select(key).limit(5).collect()
        if sample:
            raise MissingStructures(f"no structure for {[r[0] for r in sample]} and possibly others")
    return rows.join(atoms, key)


def attach_molecule(rows: DataFrame, molecules: DataFrame, key: str = "name") -> DataFrame:
    """Rows that have a molecule, with it (one molecule per key, see ``first_record``)."""
    return rows.join(molecules, key)


def rows_with_graph(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    return rows.join(nodes.select(key), key, "left_semi")


def empty_graphs(graphs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Graphs without a node."""
    counts = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n_nodes"))
    return (
        graphs.join(counts, key, "left")
        .withColumn("n_nodes", F.coalesce("n_nodes", F.lit(0)))
        .filter(F.col("n_nodes") == 0)
    )


def head(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)


def sample(df: DataFrame, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """``n`` rows picked by a seeded digest of the key; no full sort, only a top-n."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(digest, key).limit(n)


def valid_requests(requests: DataFrame, sizes: DataFrame, key: str, required: Sequence[str], max_values: int) -> DataFrame:
    """Adds ``accepted``: all numbers filled in, a structure present and not too long."""
    from strucreg.functions.columns import all_filled

    return requests.join(sizes, key, "left").withColumn(
        "accepted", all_filled(required) & F.coalesce(F.col("n_values").between(1, max_values), F.lit(False))
    )
