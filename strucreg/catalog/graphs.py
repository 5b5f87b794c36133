"""Molecular graph queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strucreg.catalog.common import rounded
from strucreg.catalog.sql import ATOMS, OBS, X, rnd, three_way, union_all
from strucreg.operators import graph, scale, split
from strucreg.plans import bindings as b

KEYS = ("idx", "part")
OWN = ["atomic_num", "valence", "charge", "aromatic", "mass"]
HIDDEN, OUTPUTS = 4, 6


def _graph(spark, sf_dir):
    """Atoms with a charge on some nitrogens, and bonds; both are used several times over."""
    charge = F.when((F.col("symbol") == "N") & (F.col("x") > b.CHARGED_ABOVE), 1).otherwise(0)
    atoms = b.atoms(spark, sf_dir).select(*KEYS, "atom_idx", "symbol", "left_order", charge.alias("charge")).persist()
    return atoms, b.bonds(atoms).persist()


def _named(df):
    """The system's name in place of its two numbers."""
    return df.withColumn("name", b.system_name(F.col("idx"), F.col("part"))).drop(*KEYS)


def symmetric_edges(spark, sf_dir):
    _, bonds = _graph(spark, sf_dir)
    return _named(graph.symmetric_edges(bonds, KEYS))


def atom_features(spark, sf_dir):
    return _named(graph.atom_features(*_graph(spark, sf_dir), KEYS))


def add_hydrogens(spark, sf_dir):
    atoms, _ = graph.add_hydrogens(*_graph(spark, sf_dir), KEYS)
    return _named(atoms)


def hydrogen_bonds(spark, sf_dir):
    _, bonds = graph.add_hydrogens(*_graph(spark, sf_dir), KEYS)
    return _named(bonds)


def validate_structure(spark, sf_dir):
    return _named(graph.invalid_structures(*_graph(spark, sf_dir), KEYS))


def circular_fingerprint(spark, sf_dir):
    return _named(graph.circular_fingerprint(*_graph(spark, sf_dir), KEYS))


def _node_table(spark, sf_dir):
    atoms, bonds = _graph(spark, sf_dir)
    systems = atoms.select(*KEYS).distinct()
    rows = b.observations(spark, sf_dir).drop("name").join(systems, "idx")
    return graph.node_features(rows, X, atoms, bonds, KEYS)


def node_features(spark, sf_dir):
    nodes = _named(_node_table(spark, sf_dir))
    names = [*X, *OWN]
    return nodes.select("name", "atom_idx", *[F.col("features")[i].alias(n) for i, n in enumerate(names)])


def node_standardize(spark, sf_dir):
    """Fitted over all nodes of the training graphs."""
    train = _node_table(spark, sf_dir).filter(split.three_way(F.col("idx")) == "train")
    return rounded(scale.fit_standard_array(train, "features"), ["mean", "scale"], 4)


BITS = 256


def _node_rows(spark, sf_dir):
    """All 267 values of every node: the order's numbers, the fingerprint, the atom's own."""
    atoms, bonds = _graph(spark, sf_dir)
    systems = atoms.select(*KEYS).distinct()
    rows = b.observations(spark, sf_dir).drop("name").join(systems, "idx")
    return graph.node_features(rows, X, atoms, bonds, KEYS, graph.circular_fingerprint(atoms, bonds, KEYS, n_bits=BITS))


def node_table(spark, sf_dir):
    return _named(_node_rows(spark, sf_dir))


def node_table_standardize(spark, sf_dir):
    train = _node_rows(spark, sf_dir).filter(split.three_way(F.col("idx")) == "train")
    return rounded(scale.fit_standard_array(train, "features"), ["mean", "scale"], 4)


def _weights(rows: int, columns: int, shift: int) -> list[list[float]]:
    return [[((i * 5 + j * 3 + shift) % 7 - 3) / 10 for j in range(columns)] for i in range(rows)]


W1, B1 = _weights(len(OWN), HIDDEN, 0), [0.1, -0.1, 0.2, 0.0]
W2, B2 = _weights(HIDDEN, HIDDEN, 2), [0.0, 0.1, -0.2, 0.1]
# the tail of each bias keeps results off rounding ties
W3, B3 = _weights(HIDDEN, OUTPUTS, 4), [0.50000013, 0.40000013, 0.30000013, 0.20000013, 0.10000013, 0.00000013]
SIZES = {"atomic_num": 10.0, "valence": 2.0, "charge": 1.0, "aromatic": 1.0, "mass": 20.0}
H = [f"h{j}" for j in range(HIDDEN)]


def _ready(spark, sf_dir):
    atoms, bonds = _graph(spark, sf_dir)
    nodes = graph.atom_features(atoms, bonds, KEYS)
    nodes = nodes.select(*KEYS, "atom_idx", *[(F.col(c) / s).alias(c) for c, s in SIZES.items()])
    return nodes, graph.normalized_edges(atoms, graph.symmetric_edges(bonds, KEYS), KEYS).persist()


def gcn_propagate(spark, sf_dir):
    nodes, edges = _ready(spark, sf_dir)
    out = graph.propagate(nodes, edges, OWN, KEYS)
    return rounded(_named(out).select("name", "atom_idx", *OWN), OWN)


def graph_readout(spark, sf_dir):
    nodes = graph.atom_features(*_graph(spark, sf_dir), KEYS)
    nodes = nodes.select(*KEYS, "atom_idx", *[(F.col(c) / s).alias(c) for c, s in SIZES.items()])
    return rounded(_named(graph.readout(nodes, OWN, KEYS)), OWN)


def _relu(df):
    return df.withColumns({h: F.greatest(F.col(h), F.lit(0.0)) for h in H})


def gcn_predict(spark, sf_dir):
    """Two convolutions, mean readout, linear head; weights by rule.

    Weights are applied before the neighbours are summed, so only hidden columns are shuffled.
    """
    nodes, edges = _ready(spark, sf_dir)
    for columns, w, bias in ((OWN, W1, B1), (H, W2, B2)):
        nodes = graph.dense_columns(nodes, [*KEYS, "atom_idx"], columns, w, [0.0] * HIDDEN, "h")
        nodes = graph.propagate(nodes, edges, H, KEYS)
        nodes = _relu(nodes.withColumns({h: F.col(h) + bias[j] for j, h in enumerate(H)}))
    out = graph.dense_columns(graph.readout(nodes, H, KEYS), KEYS, H, W3, B3, "p")
    return rounded(_named(out), [f"p{j}" for j in range(OUTPUTS)])


QUERIES = {
    f.__name__: f
    for f in (
        symmetric_edges, atom_features, add_hydrogens, hydrogen_bonds, validate_structure, circular_fingerprint,
        node_features, node_standardize, node_table, node_table_standardize, gcn_propagate, graph_readout, gcn_predict,
    )
}

GRAPH = ATOMS + """,
charged AS (SELECT *, CASE WHEN symbol = 'N' AND x > 25 THEN 1 ELSE 0 END AS charge FROM atoms),
edges AS (
  SELECT name, "begin" AS src, "end" AS dst, "order" FROM bonds
  UNION ALL SELECT name, "end", "begin", "order" FROM bonds),
bonded AS (SELECT name, dst AS atom_idx, sum("order")::INT AS bonded, count(*) AS degree FROM edges GROUP BY name, dst),
feats AS (
  SELECT c.idx, c.name, c.atom_idx, c.symbol, CASE symbol WHEN 'C' THEN 6 WHEN 'N' THEN 7 ELSE 8 END AS atomic_num,
         coalesce(bonded, 0) AS valence, charge, 0 AS aromatic,
         CASE symbol WHEN 'C' THEN 12.011::DOUBLE WHEN 'N' THEN 14.007::DOUBLE ELSE 15.999::DOUBLE END AS mass,
         CASE symbol WHEN 'C' THEN 4 WHEN 'N' THEN 3 ELSE 2 END AS usual, coalesce(degree, 0) AS degree,
         CASE WHEN symbol = 'C' THEN -abs(charge) ELSE charge END AS shift
  FROM charged c LEFT JOIN bonded b ON c.name = b.name AND c.atom_idx = b.atom_idx),
hyd AS (
  SELECT name, atom_idx AS parent, max(atom_idx) OVER (PARTITION BY name) + 1 AS n_atoms,
         greatest(0, usual + shift - valence) AS missing FROM feats),
hydrogens AS (
  SELECT name, parent, n_atoms + parent * 8 + k AS atom_idx
  FROM (SELECT *, unnest(range(0, missing)) AS k FROM hyd))"""


def _id(*parts: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::BIGINT"


_FINGERPRINT = GRAPH + f""",
r0 AS (SELECT name, atom_idx, {_id('0', 'atomic_num', 'degree', 'valence', 'charge', 'aromatic')} AS id FROM feats)"""
for _r in (1, 2):
    _FINGERPRINT += f""",
a{_r} AS (SELECT e.name, e.dst AS atom_idx, sum({_id('"order"', 'id')})::BIGINT AS around
  FROM edges e JOIN r{_r - 1} r ON e.name = r.name AND e.src = r.atom_idx GROUP BY e.name, e.dst),
r{_r} AS (SELECT r.name, r.atom_idx, {_id(str(_r), 'id', 'coalesce(around, 0)')} AS id
  FROM r{_r - 1} r LEFT JOIN a{_r} a ON r.name = a.name AND r.atom_idx = a.atom_idx)"""

# bonds around each atom; of equal ones within a structure the smallest identifier of the smallest radius stays
_FINGERPRINT += f""",
b1 AS MATERIALIZED (SELECT name, dst AS atom_idx, list_sort(list(DISTINCT least(src, dst) * 4294967296 + greatest(src, dst))) AS bonds FROM edges GROUP BY name, dst),
b2 AS (SELECT name, atom_idx, list_sort(list(DISTINCT bond)) AS bonds FROM (
    SELECT name, atom_idx, unnest(bonds) AS bond FROM b1
    UNION ALL SELECT e.name, e.dst, unnest(b1.bonds) FROM edges e JOIN b1 ON e.name = b1.name AND e.src = b1.atom_idx) GROUP BY name, atom_idx),
wider AS (SELECT name, bonds, arg_min(id, (r, id)) AS id FROM (
    SELECT name, bonds, 1 AS r, id FROM r1 JOIN b1 USING (name, atom_idx) UNION ALL SELECT name, bonds, 2, id FROM r2 JOIN b2 USING (name, atom_idx)) GROUP BY name, bonds),
ids AS (SELECT name, id FROM r0 UNION ALL SELECT name, id FROM wider)"""

_READY = GRAPH + ",\nready AS (SELECT name, atom_idx, 1 / sqrt(degree + 1) AS d, " + ", ".join(
    f"{c} / {s}::DOUBLE AS {c}" for c, s in SIZES.items()
) + " FROM feats)"


def _step(source: str, out: str, columns) -> str:
    sums = ", ".join(f"sum({c}) AS {c}" for c in columns)
    return f""",
{out} AS (
  SELECT name, atom_idx, d, {', '.join(f'm.{c} * d AS {c}' for c in columns)}
  FROM (SELECT name, atom_idx, {sums} FROM (
          SELECT e.name, e.dst AS atom_idx, {', '.join(f's.{c} * s.d AS {c}' for c in columns)}
          FROM edges e JOIN {source} s ON e.name = s.name AND e.src = s.atom_idx
          UNION ALL SELECT name, atom_idx, {', '.join(f'{c} * d AS {c}' for c in columns)} FROM {source})
        GROUP BY name, atom_idx) m
  JOIN (SELECT name, atom_idx, d FROM ready) USING (name, atom_idx))"""


def _dense(columns, weights, bias) -> list[str]:
    return [
        " + ".join([f"{bias[j]!r}::DOUBLE"] + [f"{c} * {weights[i][j]}::DOUBLE" for i, c in enumerate(columns)])
        for j in range(len(bias))
    ]


_GCN = _READY
for _i, (_columns, _w, _bias, _from) in enumerate(((OWN, W1, B1, "ready"), (H, W2, B2, "l0"))):
    _zero = [0.0] * HIDDEN
    _GCN += f",\nz{_i} AS (SELECT name, atom_idx, d, " + ", ".join(
        f"{e} AS h{j}" for j, e in enumerate(_dense(_columns, _w, _zero))
    ) + f" FROM {_from})" + _step(f"z{_i}", f"s{_i}", H) + f",\nl{_i} AS (SELECT name, atom_idx, d, " + ", ".join(
        f"greatest({h} + {_bias[j]}::DOUBLE, 0) AS {h}" for j, h in enumerate(H)
    ) + f" FROM s{_i})"
_GCN += ",\nmeans AS (SELECT name, " + ", ".join(f"avg({h}) AS {h}" for h in H) + " FROM l1 GROUP BY name)"

_NODE_TABLE = f"""{_FINGERPRINT},
prints AS (SELECT name, list(DISTINCT (id % {BITS})::INT) AS bits FROM ids GROUP BY name),
wide AS MATERIALIZED (
  SELECT feats.idx, feats.name, atom_idx, list_concat([{', '.join(X)}], list_concat(
    list_transform(range(0, {BITS}), lambda v: list_contains(bits, v)::INT::DOUBLE),
    [atomic_num::DOUBLE, valence::DOUBLE, charge::DOUBLE, aromatic::DOUBLE, mass])) AS features
  FROM feats JOIN obs ON feats.idx = obs.idx JOIN prints ON feats.name = prints.name)"""

SQL = {
    "node_table": f"WITH {OBS}, {_NODE_TABLE} SELECT name, atom_idx, features FROM wide",
    "node_table_standardize": f"""WITH {OBS}, {_NODE_TABLE},
slots AS (SELECT unnest(range(0, {len(X) + BITS + len(OWN)}))::INT AS pos, unnest(features) AS v FROM wide WHERE {three_way('idx')} = 'train')
SELECT pos, {rnd('avg(v)', 4)} AS mean, {rnd('CASE WHEN min(v) = max(v) THEN 1 ELSE stddev_pop(v) END', 4)} AS scale FROM slots GROUP BY pos""",
    "symmetric_edges": f'WITH {GRAPH} SELECT name, src, dst, "order" FROM edges',
    "atom_features": f"WITH {GRAPH} SELECT name, atom_idx, atomic_num, valence, charge, aromatic, mass FROM feats",
    "add_hydrogens": f"""WITH {GRAPH} SELECT name, atom_idx, symbol, charge FROM charged
UNION ALL SELECT name, atom_idx, 'H', 0 FROM hydrogens""",
    "hydrogen_bonds": f"""WITH {GRAPH} SELECT name, "begin", "end", "order" FROM bonds
UNION ALL SELECT name, parent, atom_idx, 1 FROM hydrogens""",
    "validate_structure": f"WITH {GRAPH} SELECT DISTINCT name, 'too many bonds' AS reason FROM feats WHERE valence > usual + shift",
    "circular_fingerprint": f"""WITH {_FINGERPRINT}
SELECT name, list_sort(list(DISTINCT (id % 256)::INT)) AS on_bits FROM ids GROUP BY name""",
    "node_features": f"""WITH {OBS}, {GRAPH} SELECT feats.name, atom_idx, {', '.join(X)}, atomic_num::DOUBLE AS atomic_num,
  valence::DOUBLE AS valence, charge::DOUBLE AS charge, aromatic::DOUBLE AS aromatic, mass
FROM feats JOIN obs ON feats.idx = obs.idx""",
    "node_standardize": f"""WITH {OBS}, {GRAPH},
train AS (SELECT feats.*, {', '.join(X)} FROM feats JOIN obs ON feats.idx = obs.idx WHERE {three_way('feats.idx')} = 'train')
""" + union_all(
        f"SELECT {i} AS pos, {rnd(f'avg({c})', 4)} AS mean, "
        f"{rnd(f'CASE WHEN min({c}) = max({c}) THEN 1 ELSE stddev_pop({c}) END', 4)} AS scale FROM train"
        for i, c in enumerate([*X, *OWN])
    ),
    "gcn_propagate": f"WITH {_READY}{_step('ready', 'sent', OWN)} SELECT name, atom_idx, "
    + ", ".join(f"{rnd(c)} AS {c}" for c in OWN) + " FROM sent",
    "graph_readout": f"WITH {_READY} SELECT name, " + ", ".join(f"{rnd(f'avg({c})')} AS {c}" for c in OWN)
    + " FROM ready GROUP BY name",
    "gcn_predict": f"WITH {_GCN} SELECT name, "
    + ", ".join(f"{rnd(e)} AS p{j}" for j, e in enumerate(_dense(H, W3, B3))) + " FROM means",
}
