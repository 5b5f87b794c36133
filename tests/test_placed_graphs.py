"""Graph operators on tables that are placed by graph already, and their rows against plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from strucreg.operators import graph

KEYS = ["idx", "part"]


def _tables(spark):
    draw = random.Random(2)
    atoms, bonds = [], []
    for g in range(60):
        idx, part, n = (None if g == 5 else g // 2), g % 2, draw.randint(1, 6)
        atoms += [(idx, part, None if draw.random() < 0.05 else i, draw.choice(["C", "N", "Zz", None]), draw.choice([0, 1, None])) for i in range(n)]
        if g % 7 == 0:
            atoms += [(idx, part, 0, "O", 0), (idx, part, 0, "C", 1)]
        ends = lambda: None if draw.random() < 0.05 else draw.randint(0, n)  # noqa: B023, E731
        bonds += [(idx, part, ends(), ends(), draw.choice([1, 2, 4, None])) for _ in range(draw.randint(0, 8))]
    return (
        spark.createDataFrame(atoms, "idx long, part long, atom_idx long, symbol string, charge int"),
        spark.createDataFrame(bonds, "idx long, part long, begin int, end int, order int"),
    )


def _same(a, b):
    assert a.columns == b.columns
    told = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    assert told(a) == told(b)


def _features(atoms, bonds):
    bonded = graph.bonded_order(graph.symmetric_edges(bonds, KEYS), KEYS)
    joined = graph._with_elements(atoms).join(bonded, [*KEYS, "atom_idx"], "left")
    valence = F.coalesce(F.floor("bonded"), F.lit(0)).cast("int").alias("valence")
    charge = F.coalesce("charge", F.lit(0)).cast("int").alias("charge")
    return joined.select(*KEYS, "atom_idx", "atomic_num", valence, charge, F.coalesce("aromatic", F.lit(0)).alias("aromatic"), "mass")


def _weighted(nodes, edges):
    degree = edges.groupBy(*KEYS, F.col("dst").alias("atom_idx")).agg(F.count(F.lit(1)).alias("n"))
    d = nodes.select(*KEYS, "atom_idx").join(degree, [*KEYS, "atom_idx"], "left").select(*KEYS, "atom_idx", (1 / F.sqrt(F.coalesce("n", F.lit(0)) + 1)).alias("d"))
    source, target = d.select(*KEYS, F.col("atom_idx").alias("src"), F.col("d").alias("s")), d.select(*KEYS, F.col("atom_idx").alias("dst"), F.col("d").alias("t"))
    ends = edges.select(*KEYS, "src", "dst").join(source, [*KEYS, "src"]).join(target, [*KEYS, "dst"]).select(*KEYS, "src", "dst", (F.col("s") * F.col("t")).alias("weight"))
    return ends.unionByName(d.select(*KEYS, F.col("atom_idx").alias("src"), F.col("atom_idx").alias("dst"), (F.col("d") * F.col("d")).alias("weight")))


def test_rows_are_those_of_plain_joins(spark):
    """With repeated and missing atoms, bonds to missing atoms, loops, and keys that are NULL."""
    atoms, bonds = _tables(spark)
    nodes, edges = graph.atom_features(atoms, bonds, KEYS), graph.symmetric_edges(bonds, KEYS)
    _same(nodes, _features(atoms, bonds))
    weighted = graph.normalized_edges(atoms, edges, KEYS)
    _same(weighted, _weighted(atoms, edges))
    columns = ["valence", "mass"]
    sent = nodes.withColumnRenamed("atom_idx", "src").select(*KEYS, "src", *columns).join(_weighted(atoms, edges), [*KEYS, "src"])
    plain = sent.groupBy(*KEYS, F.col("dst").alias("atom_idx")).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in columns])
    _same(graph.propagate(nodes, weighted, columns, KEYS), plain)


@pytest.mark.parametrize("steps", [1, 2])
def test_rows_placed_by_graph_are_not_moved_again(spark, steps):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = spark.range(200).select((F.col("id") % 9).alias("idx"), F.lit(0).alias("part"), F.col("id").alias("atom_idx"), F.lit("C").alias("symbol"), F.lit(0).alias("charge"))
        atoms = placed.repartition(8, "idx").persist()
        atoms.count()
        bonds = atoms.select(*KEYS, F.col("atom_idx").alias("begin"), (F.col("atom_idx") + 9).alias("end"), F.lit(1).alias("order"))
        nodes = graph.atom_features(atoms, bonds, KEYS)
        edges = graph.normalized_edges(atoms, graph.symmetric_edges(bonds, KEYS), KEYS)
        for _ in range(steps):
            nodes = graph.propagate(nodes, edges, ["mass"], KEYS)
        assert len(nodes.collect()) == 200
        final = nodes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ENSURE_REQUIREMENTS" not in final
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        atoms.unpersist()


def test_hydrogens_are_those_of_plain_joins(spark):
    atoms, bonds = _tables(spark)
    charge = F.coalesce("charge", F.lit(0))
    bonded = graph.bonded_order(graph.symmetric_edges(bonds, KEYS), KEYS).select(*KEYS, "atom_idx", "bonded")
    room = F.col("default_valence") + graph._charge_shift(charge) - F.coalesce("bonded", F.lit(0.0))
    sizes = atoms.groupBy(*KEYS).agg((F.max("atom_idx") + 1).alias("n"))
    parents = graph._with_elements(atoms).join(bonded, [*KEYS, "atom_idx"], "left").withColumn("missing", F.greatest(F.lit(0), F.coalesce(F.ceil(room), F.lit(0))).cast("int"))
    parents = parents.filter("missing > 0").join(sizes, KEYS).select(*KEYS, F.col("atom_idx").alias("parent"), "n", F.explode(F.expr("sequence(0, missing - 1)")).alias("k"))
    told = parents.select(*KEYS, "parent", (F.col("n") + F.col("parent") * graph.HYDROGEN_STRIDE + F.col("k")).alias("atom_idx"))
    full_atoms, full_bonds = graph.add_hydrogens(atoms, bonds, KEYS)
    _same(full_atoms.filter("symbol = 'H'").select(*KEYS, "atom_idx"), told.select(*KEYS, "atom_idx"))
    _same(full_bonds.select(*KEYS, "begin", "end"), bonds.select(*KEYS, "begin", "end").unionAll(told.select(*KEYS, "parent", "atom_idx")))


def test_hydrogens_move_no_atom_of_a_placed_graph(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        atoms = spark.range(200).select((F.col("id") % 9).alias("idx"), F.lit(0).alias("part"), F.col("id").alias("atom_idx"), F.lit("C").alias("symbol"), F.lit(0).alias("charge")).repartition(8, "idx").persist()
        atoms.count()
        bonds = atoms.select(*KEYS, F.col("atom_idx").alias("begin"), (F.col("atom_idx") + 9).alias("end"), F.lit(1).alias("order"))
        full, _ = graph.add_hydrogens(atoms, bonds, KEYS)
        assert full.filter("symbol = 'H'").count() == 400 + 9
        full.collect()
        assert "ENSURE_REQUIREMENTS" not in full._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        atoms.unpersist()


def test_what_nodes_share_is_made_once_per_graph(spark):
    """The 0/1 array of a fingerprint comes before its graph's nodes meet it."""
    atoms = spark.range(200).select((F.col("id") % 9).alias("idx"), F.lit(0).alias("part"), F.col("id").alias("atom_idx"), F.lit("C").alias("symbol"), F.lit(0).alias("charge"))
    bonds = atoms.filter("atom_idx < 190").select(*KEYS, F.col("atom_idx").alias("begin"), (F.col("atom_idx") + 9).alias("end"), F.lit(1).alias("order"))
    rows = atoms.select(*KEYS).distinct().withColumn("a", F.col("idx").cast("double"))
    out = graph.node_features(rows, ["a"], atoms, bonds, KEYS, graph.circular_fingerprint(atoms, bonds, KEYS))
    assert out.count() == 200 and {len(r["features"]) for r in out.collect()} == {262}
    optimized = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = {kind: min(i for i, line in enumerate(optimized) if kind in line) for kind in ("array_contains", "Join")}
    assert at["array_contains"] > at["Join"]


def test_graphs_that_came_in_a_row_are_not_counted(spark):
    from strucreg.operators import gcn

    nodes = spark.range(20).select((F.col("id") % 4).alias("g"), F.col("id").alias("atom_idx"), F.array(F.lit(1.0)).alias("features"))
    edges = nodes.select("g", F.col("atom_idx").alias("src"), F.col("atom_idx").alias("dst"))
    targets = spark.range(4).select(F.col("id").alias("g"), F.array(F.lit(0.5)).alias("y"))
    whole, counted = gcn.graph_rows(nodes, edges, targets, ["g"], None), gcn.graph_rows(nodes, edges, targets, ["g"], 100)
    told = lambda df: sorted(str(r) for r in df.collect())
    assert told(whole) == told(counted) and whole.count() == 4
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi")
    assert joins(whole) == 0 and joins(counted) == 2
