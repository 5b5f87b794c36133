"""Ranks found without a sort: quantiles in two readings, the tail of an order; surroundings counted once; numbers within ranges of files."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strucreg.operators import graph, numbering, quantiles, split


def _counted(spark, df):
    """``df`` with a counter of the rows that are read of it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), seen


SHAPES = {
    "normal": lambda rng, n: rng.normal(size=n),
    "wide": lambda rng, n: np.exp(rng.normal(size=n) * 80),
    "few": lambda rng, n: rng.integers(0, 4, n).astype(float),
    "infinite": lambda rng, n: np.where(rng.random(n) < 0.3, np.inf, np.where(rng.random(n) < 0.4, -np.inf, rng.normal(size=n))),
    "same": lambda rng, n: np.full(n, 2.5),
}


def test_quantiles_take_two_readings(spark):
    rng = np.random.default_rng(7)
    n = 20_000
    columns = {k: f(rng, n) for k, f in SHAPES.items()}
    rows = [tuple(None if rng.random() < 0.02 else float(v) for v in r) for r in zip(*columns.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in columns)).repartition(7).persist()
    wanted = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    counted, seen = _counted(spark, df)
    ours = quantiles.exact_quantiles(counted, list(columns), wanted, buffered_rows=100)
    assert seen.value == 2 * n
    theirs = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in wanted])).alias(c) for c in columns]).first()
    for c in columns:
        assert all(a == b or (math.isnan(a) and math.isnan(b)) or np.isclose(a, b, rtol=1e-15) for a, b in zip(ours[c], theirs[c])), c


def test_a_sketch_that_misses_is_made_good(spark, monkeypatch):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).cast("double").alias("v"))
    monkeypatch.setattr(F, "percentile_approx", lambda c, ps, accuracy: F.array(*[F.lit(4990.0) for _ in ps]))
    assert quantiles.exact_quantiles(df, ["v"], [0.25, 0.5], buffered_rows=10)["v"] == [1249.75, 2499.5]


@pytest.mark.parametrize("share", [0.1, 0.25, 0.0, 1.0])
def test_the_tail_of_any_order(spark, share):
    day = datetime.date(2024, 1, 1)
    rows = [(i * 37 % 1009, f"k{i * 37 % 1009 % 13}", day + datetime.timedelta(days=i % 50)) for i in range(1009)]
    df = spark.createDataFrame(rows, "a bigint, b string, c date").repartition(5)
    for keys in (["a"], ["b", "a"], ["c", "b", "a"]):
        at = [("a", "b", "c").index(k) for k in keys]
        order = sorted(rows, key=lambda r: [r[i] for i in at])
        expected = {r[0] for r in order[math.floor(1009 * (1.0 - share)) :]}
        assert {r["a"] for r in df.filter(split.tail_part(df, keys, share)).select("a").collect()} == expected


def test_the_tail_begins_with_all_rows_of_its_key(spark):
    df = spark.createDataFrame([(min(i, 50),) for i in range(1000)], "a int")
    assert split.tail_start(df, ["a"])["a"] == 50 and df.filter(split.tail_part(df, ["a"])).count() == 950
    assert split.tail_start(df.limit(0), ["a"]) is None and df.limit(0).filter(split.tail_part(df.limit(0), ["a"])).count() == 0


def _molecule(spark, edges, symbols):
    atoms = spark.createDataFrame([("m", i, s, 0) for i, s in enumerate(symbols)], "name string, atom_idx bigint, symbol string, charge int")
    bonds = spark.createDataFrame([("m", a, b, 1) for a, b in edges], "name string, begin bigint, end bigint, order int") if edges else spark.createDataFrame([], "name string, begin bigint, end bigint, order int")
    return atoms, bonds


@pytest.mark.parametrize(
    "edges, symbols", [([], "C"), ([(0, 1)], "CO"), ([(0, 1), (1, 2)], "CCO"), ([(0, 1), (1, 2), (2, 0)], "CCC"), ([(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5)], "CCNCOC")]
)
def test_surroundings_of_equal_bonds_count_once(spark, edges, symbols):
    atoms, bonds = _molecule(spark, edges, symbols)
    rows = {r["atom_idx"]: r for r in graph.circular_identifiers(atoms, bonds).collect()}
    near = {i: [b if a == i else a for a, b in edges if i in (a, b)] for i in range(len(symbols))}
    code = lambda a, b: min(a, b) * (1 << 32) + max(a, b)
    least = {}
    for i in near:
        reach = {i}
        for r in (1, 2):
            bonds_within = tuple(sorted({code(a, b) for a in reach for b in near[a]}))
            assert tuple(rows[i][f"set{r}"]) == bonds_within
            if bonds_within:
                found = (r, rows[i][f"id{r}"])
                least[bonds_within] = min(least.get(bonds_within, found), found)
            reach |= {b for a in reach for b in near[a]}
    ids = {rows[i]["id0"] for i in near} | {v for _, v in least.values()}
    assert graph.circular_fingerprint(atoms, bonds).first()["on_bits"] == sorted({v % 256 for v in ids})


def test_numbers_within_ranges(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        lines = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"), "value")
        assert lines.select("name", "block").distinct().count() > 10
        got = numbering.number_in_ranges(lines, ["name"], "block", "no")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert {(r["value"], r["no"]) for r in got.collect()} == {(f"{n}{i}", i) for n in "ab" for i in range(500)}
        assert "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
