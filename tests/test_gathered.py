"""Fingerprints of gathered graphs against those of the tables."""

import random

import pytest
from pyspark.sql import functions as F

from strucreg.operators import graph


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _odd_graphs(spark):
    draw = random.Random(3)
    atoms, bonds = [], []
    for g in range(120):
        n, name = draw.randint(1, 9), None if g == 7 else f"m{g}"
        atoms += [(name, None if draw.random() < 0.02 else i * 3, draw.choice(["C", "N", "O", "Zz", "Cl", None]), draw.choice([0, 1, -1, None])) for i in range(n)]
        if g % 9 == 0:
            atoms += [(name, 0, "C", 0), (name, 3, "O", 1)]
        # also loops, repeated bonds and bonds to missing atoms
        bonds += [(name, draw.randint(0, n) * 3, draw.randint(0, n) * 3, draw.choice([1, 2, 3, 4])) for _ in range(draw.randint(0, 12))]
        if g % 11 == 0:
            bonds.append((name, 0, None, 1))
        if g % 13 == 0:
            bonds.append((name, 0, 3, None))
    bonds.append(("only", 1, 2, 1))
    return (
        spark.createDataFrame(atoms, "name string, atom_idx long, symbol string, charge int"),
        spark.createDataFrame(bonds, "name string, begin long, end long, order int"),
    )


@pytest.mark.parametrize("radius, limit", [(1, 1000), (2, 1000), (2, 8), (3, 1000)])
def test_gathered_fingerprints_are_those_of_the_tables(spark, monkeypatch, radius, limit):
    atoms, bonds = _odd_graphs(spark)
    monkeypatch.setattr(graph, "GATHERED_ROWS", limit)
    got = {r["name"]: r["on_bits"] for r in graph.circular_fingerprint(atoms, bonds, radius=radius).collect()}
    expected = {r["name"]: r["on_bits"] for r in graph._table_fingerprint(atoms, bonds, ["name"], radius, 256).collect()}
    assert got == expected and len(got) == 119


def test_a_fingerprint_takes_one_exchange(spark):
    atoms = spark.range(50).select(F.concat(F.lit("m"), F.col("id") % 9).alias("name"), F.col("id").alias("atom_idx"), F.lit("C").alias("symbol"), F.lit(0).alias("charge"))
    bonds = atoms.select("name", F.col("atom_idx").alias("begin"), F.col("atom_idx").alias("end"), F.lit(1).alias("order"))
    assert _plan(graph.circular_fingerprint(atoms, bonds)).count("Exchange hashpartitioning") == 1
