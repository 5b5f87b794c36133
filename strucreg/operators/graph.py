"""Molecular graphs as node and edge tables.

``keys`` names the columns that identify a graph. Nodes are ``(keys, atom_idx, ...)`` and
bonds ``(keys, begin, end, order)``. Everything is joins and sums on (graph, node), so no
graph is gathered in one place here, but for the fingerprints of small ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strucreg.functions.elements import LOSES_BOND_WHEN_CHARGED, element_table
from strucreg.operators import surroundings

Keys = Sequence[str]
# Fixed value: bond type 4 is aromatic and counts one and a half.
AROMATIC = 4
# Ids of added hydrogens are spaced by this many per heavy atom, more than any atom can take.
HYDROGEN_STRIDE = 8
# Graphs of more atoms and bonds than this are not gathered into a row.
GATHERED_ROWS = 1_000


def symmetric_edges(bonds: DataFrame, keys: Keys = ("name",)) -> DataFrame:
    """Both directions of every bond: ``(keys, src, dst, order)``."""
    there = F.struct(F.col("begin").alias("src"), F.col("end").alias("dst"))
    back = F.struct(F.col("end").alias("src"), F.col("begin").alias("dst"))
    return bonds.select(*keys, "order", F.explode(F.array(there, back)).alias("e")).select(*keys, "e.src", "e.dst", "order")


def _beside(rows: DataFrame, node: str, others: DataFrame, at: str, columns: Sequence[str], keys: Keys, outer: bool = False) -> DataFrame:
    """``rows`` with ``columns`` of those ``others`` whose (keys, ``at``) equals their (keys, ``node``): an inner or left join.

    Both tables are put under each other and meet in a window over (keys, node). A join wants its sides placed by all its columns; a
    window also takes rows placed by the graph alone, so tables of whole graphs are not moved again from one step to the next. What
    is gathered per row are the ``others`` of one node, one unless atoms repeat.
    """
    ends = [*keys, "_at"]
    known = lambda names: reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    here = rows.select(*keys, F.col(node).alias("_at"), F.struct("*").alias("_row"))
    there = others.filter(known([*keys, at])).select(*keys, F.col(at).alias("_at"), F.struct(*columns).alias("_other"))
    if not outer:
        here = here.filter(known(ends))
    both = here.withColumn("_other", F.lit(None).cast(there.schema["_other"].dataType)).unionByName(
        there.select(*ends, F.lit(None).cast(here.schema["_row"].dataType).alias("_row"), "_other")
    )
    met = both.withColumn("_met", F.collect_list("_other").over(W.partitionBy(*ends))).filter(F.col("_row").isNotNull())
    # what is NULL meets nothing
    found = F.explode_outer(F.when(known(ends), F.col("_met"))) if outer else F.explode("_met")
    return met.select(*keys, "_row", found.alias("_other")).select(*keys, *[F.col("_row")[c].alias(c) for c in rows.columns if c not in keys], "_other.*")


def _with_elements(atoms: DataFrame) -> DataFrame:
    # the element table has a fixed size of a few dozen rows
    return atoms.join(F.broadcast(element_table(atoms.sparkSession)), "symbol", "left")


def bonded_order(edges: DataFrame, keys: Keys) -> DataFrame:
    """Sum of bond orders, bond count and aromatic flag per atom that has bonds."""
    order = F.when(F.col("order") == AROMATIC, 1.5).otherwise(F.col("order").cast("double"))
    return edges.groupBy(*keys, F.col("dst").alias("atom_idx")).agg(
        F.sum(order).alias("bonded"),
        F.count(F.lit(1)).alias("degree"),
        F.max((F.col("order") == AROMATIC).cast("int")).alias("aromatic"),
    )


def atom_features(atoms: DataFrame, bonds: DataFrame, keys: Keys = ("name",)) -> DataFrame:
    """Atomic number, valence from bonds, formal charge, aromatic flag and mass per atom."""
    bonded = bonded_order(symmetric_edges(bonds, keys), keys)
    bonded = bonded.withColumnRenamed("atom_idx", "_atom")
    joined = _beside(_with_elements(atoms), "atom_idx", bonded, "_atom", ["bonded", "aromatic"], keys, outer=True)
    return joined.select(
        *keys,
        "atom_idx",
        "atomic_num",
        # the fraction of an aromatic sum is dropped
        F.coalesce(F.floor("bonded"), F.lit(0)).cast("int").alias("valence"),
        F.coalesce("charge", F.lit(0)).cast("int").alias("charge"),
        F.coalesce("aromatic", F.lit(0)).alias("aromatic"),
        "mass",
    )


def _charge_shift(charge: Column) -> Column:
    return F.when(F.col("symbol").isin(*LOSES_BOND_WHEN_CHARGED), -F.abs(charge)).when(F.col("symbol") == "B", -charge).otherwise(charge)


def add_hydrogens(atoms: DataFrame, bonds: DataFrame, keys: Keys = ("name",)) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds with the missing hydrogens.

    A hydrogen's number follows from its parent's (graph size plus a stride), so numbers are
    unique but not consecutive and need no ordered pass over the graph.
    """
    bonded = bonded_order(symmetric_edges(bonds, keys), keys).select(*keys, "atom_idx", "bonded")
    charge = F.coalesce("charge", F.lit(0))
    room = F.col("default_valence") + _charge_shift(charge) - F.coalesce("bonded", F.lit(0.0))
    missing = F.greatest(F.lit(0), F.coalesce(F.ceil(room), F.lit(0))).cast("int")
    n_atoms = F.max("atom_idx").over(W.partitionBy(*keys)) + 1
    bonded = bonded.withColumnRenamed("atom_idx", "_atom")
    parents = (
        _beside(_with_elements(atoms).select(*keys, "atom_idx", "symbol", "charge", "default_valence"), "atom_idx", bonded, "_atom", ["bonded"], keys, outer=True)
        .withColumns({"missing": missing, "n_atoms": n_atoms})
        # a graph whose key is NULL is none
        .filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & (F.col("missing") > 0))
    )
    hydrogens = parents.select(
        *keys,
        F.col("atom_idx").alias("parent"),
        F.explode(F.sequence(F.lit(0), F.col("missing") - 1)).alias("k"),
        "n_atoms",
    ).select(*keys, "parent", (F.col("n_atoms") + F.col("parent") * HYDROGEN_STRIDE + F.col("k")).alias("atom_idx"))
    all_atoms = atoms.select(*keys, "atom_idx", "symbol", "charge").unionByName(
        hydrogens.select(*keys, "atom_idx", F.lit("H").alias("symbol"), F.lit(0).alias("charge"))
    )
    all_bonds = bonds.select(*keys, "begin", "end", "order").unionByName(
        hydrogens.select(*keys, F.col("parent").alias("begin"), F.col("atom_idx").alias("end"), F.lit(1).alias("order"))
    )
    return all_atoms, all_bonds


def invalid_structures(atoms: DataFrame, bonds: DataFrame, keys: Keys = ("name",), declared: DataFrame | None = None) -> DataFrame:
    """``(keys, reason)`` of structures with an unknown element, an atom with too many bonds, a bond
    to a missing atom, or other counts than ``declared`` (``keys, n_atoms, n_bonds``)."""
    edges = symmetric_edges(bonds, keys)
    bonded = bonded_order(edges, keys)
    charge = F.coalesce("charge", F.lit(0))
    checked = _with_elements(atoms).join(bonded, [*keys, "atom_idx"], "full")
    problem = (
        F.when(F.col("symbol").isNull(), "bond to a missing atom")
        .when(F.col("atomic_num").isNull(), "unknown element")
        .when(F.floor(F.col("bonded")) > F.col("max_valence") + _charge_shift(charge), "too many bonds")
    )
    reasons = checked.select(*keys, problem.alias("reason")).filter(F.col("reason").isNotNull())
    if declared is not None:
        n_atoms = atoms.groupBy(*keys).agg(F.count(F.lit(1)).alias("found_atoms"))
        n_bonds = bonds.groupBy(*keys).agg(F.count(F.lit(1)).alias("found_bonds"))
        counted = declared.join(n_atoms, list(keys), "left").join(n_bonds, list(keys), "left")
        differs = (F.coalesce("found_atoms", F.lit(0)) != F.col("n_atoms")) | (
            F.coalesce("found_bonds", F.lit(0)) != F.col("n_bonds")
        )
        reasons = reasons.unionByName(counted.filter(differs).select(*keys, F.lit("count mismatch").alias("reason")))
    return reasons.groupBy(*keys).agg(F.min("reason").alias("reason"))


def valid_structures(atoms: DataFrame, bonds: DataFrame, keys: Keys = ("name",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Atoms and bonds of the good structures, and the reasons of the others."""
    # read by all that is returned, and again by what follows
    bad = invalid_structures(atoms, bonds, keys).persist()
    names = bad.select(*keys)
    return atoms.join(names, list(keys), "left_anti"), bonds.join(names, list(keys), "left_anti"), bad


def _digest(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def circular_identifiers(atoms: DataFrame, bonds: DataFrame, keys: Keys = ("name",), radius: int = 2) -> DataFrame:
    """Identifiers ``id0 .. id<radius>`` of every atom's surroundings, and ``set1 .. set<radius>``, the bonds within them in order.

    Neighbours are combined by adding digests, which needs neither an order nor a list, so the
    number does not depend on atom numbering and a much-bonded atom is combined map-side.
    A loop at every atom brings its own identifiers along, so that a round is one join and
    one sum over the round before. The bonds of an atom with at most v bonds are at most v^radius.
    """
    edges = symmetric_edges(bonds, keys)
    loops = atoms.select(*keys, F.col("atom_idx").alias("src"), F.col("atom_idx").alias("dst"), F.lit(None).cast("int").alias("order"))
    links = edges.select(*keys, "src", "dst", F.col("order").cast("int")).unionByName(loops)
    parts = [F.lit(0), F.col("atomic_num")]
    parts += [F.coalesce(c, F.lit(0)) for c in (F.col("degree"), F.floor("bonded"), F.col("charge"), F.col("aromatic"))]
    bonded = bonded_order(edges, keys)
    current = _with_elements(atoms).join(bonded, [*keys, "atom_idx"], "left").select(*keys, "atom_idx", _digest(*parts).alias("id0"))
    own = F.col("order").isNull()
    bond = F.when(~own, F.least("src", "dst").cast("bigint") * F.lit(1 << 32) + F.greatest("src", "dst"))
    for r in range(1, radius + 1):
        sent = current.withColumnRenamed("atom_idx", "src").join(links, [*keys, "src"])
        known = [F.max(F.when(own, F.col(f"id{k}"))).alias(f"id{k}") for k in range(r)]
        known += [F.flatten(F.collect_list(F.when(own, F.col(f"set{k}")))).alias(f"set{k}") for k in range(1, r)]
        around = F.sum(F.when(~own, _digest(F.col("order"), F.col(f"id{r - 1}")))).alias("around")
        # the bond that leads here and what the other end has around it
        inner = F.collect_set(bond) if r == 1 else F.array_union(F.collect_set(bond), F.flatten(F.collect_set(f"set{r - 1}")))
        current = sent.groupBy(*keys, F.col("dst").alias("atom_idx")).agg(*known, around, F.array_sort(inner).alias(f"set{r}"))
        identifier = _digest(F.lit(r), F.col(f"id{r - 1}"), F.coalesce("around", F.lit(0)))
        current = current.withColumn(f"id{r}", identifier).drop("around")
    return current


def circular_fingerprint(
    atoms: DataFrame, bonds: DataFrame, keys: Keys = ("name",), radius: int = 2, n_bits: int = 256
) -> DataFrame:
    """``(keys, on_bits)``: sorted set bits of the folded identifiers up to ``radius``.

    Surroundings of equal bonds within a graph count once: the smallest of the smallest radius stays. A graph of at most
    ``GATHERED_ROWS`` atoms and bonds becomes a row and is worked on in arrays (see ``surroundings``), one exchange in all; larger
    graphs, and those with a bond that lacks an end or its order, stay tables.
    """
    keys = list(keys)
    if radius < 1:
        return _table_fingerprint(atoms, bonds, keys, radius, n_bits)
    no_atom = F.lit(None).cast("struct<atom_idx:bigint,atomic_num:int,charge:string>")
    no_bond = F.lit(None).cast("struct<begin:bigint,end:bigint,order:int>")
    atom = F.struct(F.col("atom_idx").cast("bigint"), F.col("atomic_num").cast("int"), F.coalesce("charge", F.lit(0)).cast("string").alias("charge"))
    bond = F.struct(F.col("begin").cast("bigint"), F.col("end").cast("bigint"), F.col("order").cast("int"))
    odd = F.col("begin").isNull() | F.col("end").isNull() | F.col("order").isNull()
    # one pass over the keys finds the graphs that are left as tables
    counted = atoms.select(*keys, F.lit(1).alias("n")).unionAll(bonds.select(*keys, F.when(odd, GATHERED_ROWS + 1).otherwise(1).alias("n")))
    large = counted.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") > GATHERED_ROWS).select(*keys).persist()
    tables = not large.isEmpty()
    if not tables:
        large.unpersist()
    # keys and places that are NULL meet no link
    own = atoms.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in (*keys, "atom_idx")]))
    links, rest = bonds, None
    if tables:
        rest = _table_fingerprint(own.join(large, keys, "left_semi"), bonds.join(large, keys, "left_semi"), keys, radius, n_bits)
        own, links = own.join(large, keys, "left_anti"), bonds.join(large, keys, "left_anti")
    rows = _with_elements(own).select(*keys, atom.alias("a"), no_bond.alias("b")).unionAll(links.select(*keys, no_atom.alias("a"), bond.alias("b")))
    gathered = rows.groupBy(*keys).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b")).filter(F.size("a") > 0)
    fields = [f for k in keys for f in own.schema.fields if f.name == k]
    schema = T.StructType([*fields, T.StructField("on_bits", T.ArrayType(T.IntegerType()))])
    found = gathered.mapInArrow(surroundings.on_bits(radius, n_bits, len(keys)), schema)
    return found if rest is None else found.unionByName(rest)


def _table_fingerprint(atoms: DataFrame, bonds: DataFrame, keys: Keys, radius: int, n_bits: int) -> DataFrame:
    """The same by joins and sums. At most ``n_bits`` numbers per graph, combined map-side."""
    found = circular_identifiers(atoms, bonds, keys, radius)
    none = F.array().cast("array<bigint>")
    around = [F.struct(F.lit(r).alias("r"), F.col(f"id{r}").alias("id"), (F.col(f"set{r}") if r else none).alias("bonds")) for r in range(radius + 1)]
    each = found.select(*keys, F.explode(F.array(*around)).alias("e")).select(*keys, "e.*")
    # atoms alone are all kept; without a bond there is nothing around an atom
    single = each.filter("r = 0").select(*keys, "id")
    wider = each.filter(F.size("bonds") > 0).groupBy(*keys, "bonds").agg(F.min(F.struct("r", "id")).alias("least")).select(*keys, F.col("least.id").alias("id"))
    return (
        single.unionByName(wider)
        .select(*keys, (F.col("id") % n_bits).cast("int").alias("bit"))
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("bit")).alias("on_bits"))
    )


def bit_array(on_bits: Column, n_bits: int = 256) -> Column:
    """0/1 array from the set bits."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: F.array_contains(on_bits, i).cast("double")
    )


def scaled_bits(mean: Sequence[float], scale: Sequence[float]) -> tuple[list[float], list[float]]:
    """What 0 and 1 become in every place of a scaled ``bit_array``."""
    return [(0.0 - m) / s for m, s in zip(mean, scale)], [(1.0 - m) / s for m, s in zip(mean, scale)]


def node_features(
    rows: DataFrame, row_features: Sequence[str], atoms: DataFrame, bonds: DataFrame, keys: Keys = ("name",),
    fingerprint: DataFrame | None = None,
) -> DataFrame:
    """Node rows with ``features``: the row's values, its fingerprint bits, the atom's own five numbers. What the nodes of a graph share
    is made once per graph."""
    shared = F.array(*[F.col(c).cast("double") for c in row_features])
    per_graph = rows.select(*keys, shared.alias("_shared"))
    if fingerprint is not None:
        per_graph = per_graph.join(fingerprint, list(keys)).select(*keys, F.concat("_shared", bit_array(F.col("on_bits"))).alias("_shared"))
    own = F.array(*[F.col(c).cast("double") for c in ("atomic_num", "valence", "charge", "aromatic", "mass")])
    return atom_features(atoms, bonds, keys).join(per_graph, list(keys)).select(*keys, "atom_idx", F.concat("_shared", own).alias("features"))


def normalized_edges(nodes: DataFrame, edges: DataFrame, keys: Keys = ("name",)) -> DataFrame:
    """``(keys, src, dst, weight)`` of ``D^-1/2 (A + I) D^-1/2``: the edges and a loop at every node.

    Computed once per graph set; every convolution uses it.
    """
    degree = edges.groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("_deg"))
    d = _beside(nodes.select(*keys, "atom_idx"), "atom_idx", degree, "dst", ["_deg"], keys, outer=True).select(
        *keys, "atom_idx", (1 / F.sqrt(F.coalesce("_deg", F.lit(0)) + 1)).alias("_d")
    )
    ends = _beside(edges.select(*keys, "src", "dst"), "dst", d.withColumnRenamed("_d", "_to"), "atom_idx", ["_to"], keys)
    ends = _beside(ends, "src", d.withColumnRenamed("_d", "_from"), "atom_idx", ["_from"], keys)
    loops = d.select(*keys, F.col("atom_idx").alias("src"), F.col("atom_idx").alias("dst"), (F.col("_d") * F.col("_d")).alias("weight"))
    return ends.select(*keys, "src", "dst", (F.col("_from") * F.col("_to")).alias("weight")).unionByName(loops)


def propagate(nodes: DataFrame, weighted: DataFrame, columns: Sequence[str], keys: Keys = ("name",)) -> DataFrame:
    """The weighted neighbour sum of ``columns``, by the edges of ``normalized_edges``.

    Edges meet their source's values in a window, then a sum by target, partly added up before a shuffle. Neither moves rows that
    are placed by graph already.
    """
    sent = _beside(weighted.select(*keys, "src", "dst", "weight"), "src", nodes, "atom_idx", columns, keys)
    return sent.groupBy(*keys, F.col("dst").alias("atom_idx")).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in columns])


def readout(nodes: DataFrame, columns: Sequence[str], keys: Keys = ("name",)) -> DataFrame:
    """Mean over the nodes of each graph."""
    return nodes.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def dense_columns(
    df: DataFrame, keep: Sequence[str], columns: Sequence[str], weights, bias, prefix: str
) -> DataFrame:
    """``columns @ weights + bias`` as column arithmetic, for small fixed shapes."""
    out = []
    for j in range(len(bias)):
        total = F.lit(float(bias[j]))
        for i, c in enumerate(columns):
            total = total + F.col(c) * float(weights[i][j])
        out.append(total.alias(f"{prefix}{j}"))
    return df.select(*keep, *out)
