"""Sources, projections, joins, arrays, scaling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strucreg.catalog.common import rounded
from strucreg.catalog.sql import ATOMS, GAPS, OBS, X, Y, bucket, holdout, rnd, three_way, union_all
from strucreg.functions import arrays
from strucreg.functions.columns import activation, point_color, to_numeric
from strucreg.operators import attach, scale, split
from strucreg.plans import bindings as b
from strucreg.plans import tabular
from strucreg.scratch import scratch_path
from strucreg.sources import artifacts, structures, tables

XY = [*X, *Y]
SYSTEM = ("idx", "name")
FROZEN_LENGTH = 3 * b.SYSTEM_ATOMS
ACTIVATIONS = ["relu", "sigmoid", "tanh", "leaky_relu", "elu", "gelu", "silu", "mish"]


def csv_roundtrip(spark, sf_dir):
    """With a text that needs quoting: quotes, a comma and, in some rows, a line end."""
    path = scratch_path(spark, "observations")
    end = F.when(F.col("idx") % 7 == 0, F.lit("\n")).otherwise(F.lit(" "))
    note = F.concat(F.lit('say "'), F.col("name"), F.lit('",'), end, F.lit("then more"))
    tables.write_csv(b.observations_with_gaps(spark, sf_dir).withColumn("note", note), path)
    back = tables.read_observations(spark, path, numeric=["mass_au", *XY], keep=["idx", "name", "note"], multi_line=True)
    return back.withColumn("idx", F.col("idx").cast("bigint"))


def xyz_parse(spark, sf_dir):
    parsed = structures.parse_xyz_text(b.xyz_text(b.atoms(spark, sf_dir)))
    return parsed.filter("valid").drop("valid")


def _molecules(spark, sf_dir, *columns):
    """The first usable record of each system; with ``columns`` only those of it go on to where records are compared."""
    parsed = structures.parse_sdf(structures.split_sdf_text(b.sdf_text(b.atoms(spark, sf_dir))))
    return structures.first_record(parsed.select("name", "reason", *columns) if columns else parsed)


def sdf_parse(spark, sf_dir):
    return structures.molecule_atoms(_molecules(spark, sf_dir))


def sdf_bonds(spark, sf_dir):
    return structures.molecule_bonds(_molecules(spark, sf_dir))


def _orders_as_text(spark, sf_dir):
    """Orders as they come from text: every thirteenth total is no number."""
    total = F.when(F.col("o_orderkey") % 13 == 0, F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string"))
    return b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("idx"),
        F.concat(F.lit("sys_"), F.col("o_orderkey").cast("string")).alias("name"),
        F.lit("1.5").alias("mass_au"),
        total.alias("total"),
        F.col("o_custkey").cast("string").alias("customer"),
    )


def quarantine(spark, sf_dir):
    bad = tables.bad_numbers(_orders_as_text(spark, sf_dir), ["total", "customer"], ["name"])
    return bad.select("name", F.array_join("bad_columns", ",").alias("bad_columns"))


def coerce_numeric(spark, sf_dir):
    rest = _orders_as_text(spark, sf_dir).drop("mass_au", "name")
    return rest.select("idx", *[to_numeric(c).alias(c) for c in ("total", "customer")])


def head_rows(spark, sf_dir):
    return attach.head(b.observations(spark, sf_dir).select("idx", *X), "idx")


def sample_rows(spark, sf_dir):
    return attach.sample(b.observations(spark, sf_dir).select("idx", *X), "idx")


def label_rows(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), point_color(F.col("o_orderkey")).alias("color"))


def validate_inputs(spark, sf_dir):
    sizes = arrays.structure_sizes(b.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "idx"), ["idx"])
    requests = b.observations(spark, sf_dir).select("idx", *X)
    return attach.valid_requests(requests, sizes, "idx", X, 18).select("idx", "n_values", "accepted")


def empty_graphs(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    items = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"))
    return attach.empty_graphs(orders, items, "idx")


def activations(spark, sf_dir):
    values = b.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    values = values.select("vec_id", "pos", (F.col("v").cast("double") * 4).alias("v"))
    out = values.select("vec_id", "pos", *[activation(a, F.col("v")).alias(a) for a in ACTIVATIONS])
    return rounded(out, ACTIVATIONS)


def attach_structure(spark, sf_dir):
    rows = b.observations(spark, sf_dir).select("idx", *X)
    return attach.attach_structure(rows, b.atoms(spark, sf_dir).drop("left_order", "part"), "idx")


def attach_molecule(spark, sf_dir):
    """Orders without items have no molecule and drop out."""
    systems = b.atoms(spark, sf_dir).select("idx", "name").distinct()
    rows = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx")).join(systems, "idx", "left")
    molecules = _molecules(spark, sf_dir, "record_no", "n_atoms", "n_bonds")
    return attach.attach_molecule(rows, molecules)


def _flat(spark, sf_dir):
    return arrays.flatten(b.atoms(spark, sf_dir), SYSTEM, FROZEN_LENGTH)


def flatten_coordinates(spark, sf_dir):
    return _flat(spark, sf_dir)


def flatten_long(spark, sf_dir):
    return arrays.flatten_long(b.atoms(spark, sf_dir), SYSTEM)


def pad_coordinates(spark, sf_dir):
    length = arrays.max_length(b.atoms(spark, sf_dir), SYSTEM)
    return _flat(spark, sf_dir).select(*SYSTEM, arrays.pad(F.col("coords"), length).alias("coords"))


def expand_coordinates(spark, sf_dir):
    padded = _flat(spark, sf_dir).select(*SYSTEM, arrays.pad(F.col("coords"), FROZEN_LENGTH).alias("coords"))
    return arrays.expand(padded, "coords", FROZEN_LENGTH)


def _split_obs(spark, sf_dir):
    return b.observations(spark, sf_dir).withColumn("split", split.holdout(F.col("idx")))


def standardize_fit(spark, sf_dir):
    train = _split_obs(spark, sf_dir).filter(F.col("split") == "train")
    return rounded(scale.fit_standard(train, XY), ["mean", "scale"], 5)


def scaler_roundtrip(spark, sf_dir):
    train = _split_obs(spark, sf_dir).filter(F.col("split") == "train")
    path = scratch_path(spark, "scaler")
    artifacts.save_scaler(scale.fit_standard(train, X), path)
    return rounded(artifacts.load_scaler(spark, path), ["mean", "scale"], 5)


def standardize(spark, sf_dir):
    rows = _split_obs(spark, sf_dir)
    params = scale.as_params(scale.fit_standard(rows.filter(F.col("split") == "train"), X))
    return rounded(scale.select_scaled(rows, ["idx", "split"], params), X)


def standardize_inverse(spark, sf_dir):
    rows = _split_obs(spark, sf_dir)
    params = scale.as_params(scale.fit_standard(rows.filter(F.col("split") == "train"), Y))
    return rounded(scale.inverse(scale.select_scaled(rows, ["idx"], params), params), Y, 6)


def minmax(spark, sf_dir):
    rows = _split_obs(spark, sf_dir)
    params = scale.as_params(scale.fit_minmax(rows.filter(F.col("split") == "train"), Y))
    return rounded(scale.select_scaled(rows, ["idx"], params), Y)


REJECT_LENGTH = 15


def training_verdicts(spark, sf_dir):
    """Every row with its verdict: structures of some orders are left out, some are too long, some numbers are missing."""
    coords = arrays.flatten(b.atoms(spark, sf_dir), ["idx", "name"], None).filter(F.col("idx") % 31 != 0)
    rows, _ = tabular.structure_features(b.observations_with_gaps(spark, sf_dir).drop("name"), coords, "idx", X, REJECT_LENGTH)
    verdict = F.coalesce("reason", F.lit("accepted")).alias("verdict")
    return tabular.judged(rows, Y).select("idx", "name", verdict)


def _order_keys(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))


def holdout_split(spark, sf_dir):
    return _order_keys(spark, sf_dir).withColumn("split", split.holdout(F.col("idx")))


def three_way_split(spark, sf_dir):
    return _order_keys(spark, sf_dir).withColumn("split", split.three_way(F.col("idx")))


def validation_split(spark, sf_dir):
    train = holdout_split(spark, sf_dir).filter(F.col("split") == "train").select("idx")
    return train.withColumn("is_validation", split.validation_part(F.col("idx")))


def validation_tail(spark, sf_dir):
    """The other form: the last tenth of the training rows as ordered by priority and key."""
    train = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderpriority").alias("priority"))
    train = train.filter(split.holdout(F.col("idx")) == "train")
    return train.select("idx", split.tail_part(train, ["priority", "idx"]).alias("is_validation"))


FILES = 48


def _written(spark, rows, suffix):
    """A folder with a file ``<name>.<suffix>`` for each row of ``name, text``."""
    from strucreg.scratch import scratch_path

    parts, folder = scratch_path(spark, "parts"), scratch_path(spark, suffix)
    rows.select("name", "text").repartition("name").write.partitionBy("name").option("lineSep", "\n").text(parts)
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for at in files.listStatus(path(parts)):  # FILES folders
        name = at.getPath().getName()
        if name.startswith("name="):
            for part in files.listStatus(at.getPath()):
                files.rename(part.getPath(), path(f"{folder}/{name.removeprefix('name=')}.{suffix}"))
    return folder


def xyz_files(spark, sf_dir):
    """All atoms written into XYZ files, a structure of many orders each, and read back: files up to 16 KB whole, larger ones in ranges of bytes."""
    atoms = b.atoms(spark, sf_dir).withColumn("name", F.concat(F.lit("f"), (F.col("idx") % FILES).cast("string")))
    line = F.format_string("%s %.2f %.2f %.2f", "symbol", "x", "y", "z")
    # a text of one task per file, as a file is one in the end
    grouped = atoms.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("idx", "part", "atom_idx", line.alias("line")))).alias("a"))
    end = F.when(F.substring("name", 2, 9).cast("int") % 3 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    text = F.concat(F.size("a").cast("string"), end, F.col("name"), end, F.array_join(F.transform("a.line", lambda v: F.concat(v, end)), ""))
    folder = _written(spark, grouped.select("name", text.alias("text")), "xyz")
    parsed = structures.read_xyz(spark, folder, whole_file_bytes=16 << 10)
    return parsed.filter("valid").drop("valid")


def sdf_files(spark, sf_dir):
    """All molecules written into SDF files of many records, of both formats, and read back, small files whole, larger ones in ranges of bytes:
    each record's number in its file, its atoms and bonds and the charges in it."""
    texts = b.sdf_text(b.atoms(spark, sf_dir)).withColumn("idx", F.split("name", "_")[1].cast("bigint"))
    names = F.concat(F.lit("f"), (F.col("idx") % FILES).cast("string"))
    grouped = texts.groupBy(names.alias("file")).agg(F.array_sort(F.collect_list(F.struct("idx", "name", "text"))).alias("t"))
    folder = _written(spark, grouped.select(F.col("file").alias("name"), F.array_join("t.text", "").alias("text")), "sdf")
    parsed = structures.parse_sdf(structures.read_sdf_records(spark, folder, whole_file_bytes=64 << 10))
    charge = F.aggregate("charges", F.lit(0), lambda a, c: a + c["charge"])
    coded = F.aggregate("atoms", F.lit(0), lambda a, x: a + F.when(x["charge_code"] == 3, 1).otherwise(0))
    return parsed.filter("reason is null").select("name", "record_no", "n_atoms", "n_bonds", F.when(F.size("charges") > 0, charge).otherwise(coded).alias("charge"))


def kfold_assign(spark, sf_dir):
    train = holdout_split(spark, sf_dir).filter(F.col("split") == "train").select("idx")
    return train.withColumn("fold", split.kfold(F.col("idx")))


QUERIES = {
    f.__name__: f
    for f in (
        csv_roundtrip, xyz_parse, xyz_files, sdf_parse, sdf_bonds, sdf_files, validation_tail, quarantine, coerce_numeric, head_rows, sample_rows, label_rows,
        validate_inputs, empty_graphs, activations, attach_structure, attach_molecule, flatten_coordinates,
        flatten_long, pad_coordinates, expand_coordinates, standardize_fit, scaler_roundtrip, standardize,
        standardize_inverse, minmax, training_verdicts, holdout_split, three_way_split, validation_split, kfold_assign,
    )
}

_TEXT = """text AS (
  SELECT o_orderkey AS idx, 'sys_' || o_orderkey AS name, o_custkey AS customer,
         CASE WHEN o_orderkey % 13 = 0 THEN o_orderpriority ELSE o_totalprice::VARCHAR END AS total FROM orders)"""
_FLAT = ATOMS + """,
flat AS (
  SELECT idx, name, flatten(list([x, y, z] ORDER BY atom_idx)) AS coords FROM atoms GROUP BY idx, name)"""
_SPLIT = OBS + f",\nsplit AS (SELECT *, {holdout('idx')} AS split FROM obs)"


def _fit(columns) -> str:
    return union_all(
        f"SELECT '{c}' AS \"column\", {rnd(f'avg({c})', 5)} AS mean, "
        f"{rnd(f'CASE WHEN min({c}) = max({c}) THEN 1 ELSE stddev_pop({c}) END', 5)} AS scale "
        "FROM split WHERE split = 'train'"
        for c in columns
    )


_STATS = ",\nstats AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) - min({c}) AS w_{c}" for c in XY
) + " FROM split WHERE split = 'train')"
_SOFTPLUS = "(greatest(v, 0) + ln(1 + exp(-abs(v))))"
_ERF = (
    "list_sum(list_transform(range(0, 60), lambda n: pow(-1, n) * pow(v / sqrt(2), 2 * n + 1) "
    "/ (exp(lgamma(n + 1)) * (2 * n + 1)))) * 2 / sqrt(pi())"
)

SQL = {
    "csv_roundtrip": f"""WITH {GAPS} SELECT *, 'say "' || name || '",' || CASE WHEN idx % 7 = 0 THEN chr(10) ELSE ' ' END || 'then more' AS note FROM gaps""",
    "xyz_parse": f"WITH {ATOMS} SELECT name, atom_idx, symbol, x, y, z FROM atoms",
    "sdf_parse": f"""WITH {ATOMS} SELECT name, atom_idx, symbol, x, y, z,
  CASE WHEN symbol = 'N' AND x > {b.CHARGED_ABOVE} THEN 1 ELSE 0 END AS charge FROM atoms""",
    "sdf_bonds": f'WITH {ATOMS} SELECT name, "begin", "end", "order" FROM bonds',
    "quarantine": f"WITH {_TEXT} SELECT name, 'total' AS bad_columns FROM text WHERE try_cast(total AS DOUBLE) IS NULL",
    "coerce_numeric": f"WITH {_TEXT} SELECT idx, try_cast(total AS DOUBLE) AS total, customer::DOUBLE AS customer FROM text",
    "head_rows": f"WITH {OBS} SELECT idx, {', '.join(X)} FROM obs ORDER BY idx LIMIT 5",
    "sample_rows": f"WITH {OBS} SELECT idx, {', '.join(X)} FROM obs ORDER BY md5(idx::VARCHAR || ':42'), idx LIMIT 5",
    "label_rows": "SELECT o_orderkey AS idx, CASE WHEN o_orderkey < 48 THEN 'red' ELSE 'blue' END AS color FROM orders",
    "validate_inputs": f"""WITH {OBS} SELECT idx, (x5 * 3)::BIGINT AS n_values,
  x1 <> 0 AND x2 <> 0 AND x3 <> 0 AND x4 <> 0 AND x5 <> 0 AND x6 <> 0 AND x5 * 3 <= 18 AS accepted FROM obs""",
    "empty_graphs": """SELECT o_orderkey AS idx, 0::BIGINT AS n_nodes FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    "activations": f"""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE * 4 AS v, unnest(range(0, len(embedding)))::INT AS pos
  FROM embeddings)
SELECT vec_id, pos, {rnd('greatest(v, 0)')} AS relu, {rnd('1 / (1 + exp(-v))')} AS sigmoid, {rnd('tanh(v)')} AS tanh,
  {rnd('CASE WHEN v >= 0 THEN v ELSE 0.2::DOUBLE * v END')} AS leaky_relu,
  {rnd('CASE WHEN v >= 0 THEN v ELSE exp(v) - 1 END')} AS elu, {rnd(f'0.5 * v * (1 + {_ERF})')} AS gelu,
  {rnd('v / (1 + exp(-v))')} AS silu, {rnd(f'v * tanh({_SOFTPLUS})')} AS mish FROM e""",
    "attach_structure": f"""WITH {OBS}, {ATOMS} SELECT obs.idx, {', '.join(X)}, atoms.name, atom_idx, symbol, x, y, z
FROM obs JOIN atoms ON obs.idx = atoms.idx""",
    "attach_molecule": f"""WITH {ATOMS} SELECT idx, name, 0::BIGINT AS record_no, count(*)::INT AS n_atoms, (count(*) - 1)::INT AS n_bonds
FROM atoms GROUP BY idx, name""",
    "flatten_coordinates": f"WITH {_FLAT} SELECT * FROM flat",
    "flatten_long": f"WITH {ATOMS} " + union_all(
        f"SELECT idx, name, atom_idx * 3 + {i} AS pos, {c} AS value FROM atoms" for i, c in enumerate("xyz")
    ),
    "pad_coordinates": f"""WITH {_FLAT} SELECT idx, name,
  list_resize(coords, (SELECT max(len(coords)) FROM flat), 0.0::DOUBLE) AS coords FROM flat""",
    "expand_coordinates": f"WITH {_FLAT} SELECT idx, name, "
    + ", ".join(f"coalesce(coords[{i + 1}], 0.0::DOUBLE) AS coord_{i}" for i in range(FROZEN_LENGTH)) + " FROM flat",
    "standardize_fit": f"WITH {_SPLIT} {_fit(XY)}",
    "scaler_roundtrip": f"WITH {_SPLIT} {_fit(X)}",
    "standardize": f"WITH {_SPLIT}{_STATS} SELECT idx, split, "
    + ", ".join(f"{rnd(f'({c} - m_{c}) / s_{c}')} AS {c}" for c in X) + " FROM split, stats",
    "standardize_inverse": f"WITH {OBS} SELECT idx, " + ", ".join(f"{rnd(c, 6)} AS {c}" for c in Y) + " FROM obs",
    "minmax": f"WITH {_SPLIT}{_STATS} SELECT idx, "
    + ", ".join(f"{rnd(f'({c} - lo_{c}) / w_{c}')} AS {c}" for c in Y) + " FROM split, stats",
    "training_verdicts": f"""WITH {GAPS}, {_FLAT}
SELECT gaps.idx, flat.name, CASE WHEN flat.name IS NULL THEN 'missing structure' WHEN len(coords) > {REJECT_LENGTH} THEN 'structure too long'
  WHEN {' OR '.join(f'{x} IS NULL' for x in X)} THEN 'missing or infinite feature'
  WHEN {' OR '.join(f'{y} IS NULL' for y in Y)} THEN 'missing or infinite target' ELSE 'accepted' END AS verdict
FROM gaps LEFT JOIN flat ON gaps.idx = flat.idx AND flat.idx % 31 <> 0""",
    "holdout_split": f"SELECT o_orderkey AS idx, {holdout('o_orderkey')} AS split FROM orders",
    "three_way_split": f"SELECT o_orderkey AS idx, {three_way('o_orderkey')} AS split FROM orders",
    "validation_split": f"""SELECT o_orderkey AS idx, {bucket('o_orderkey', 'watch42', 10)} = 0 AS is_validation
FROM orders WHERE {holdout('o_orderkey')} = 'train'""",
    "validation_tail": f"""SELECT o_orderkey AS idx, row_number() OVER (ORDER BY encode(o_orderpriority), o_orderkey) - 1 >= floor(count(*) OVER () * 0.9::DOUBLE) AS is_validation
FROM orders WHERE {holdout('o_orderkey')} = 'train'""",
    "xyz_files": f"""WITH {ATOMS}
SELECT 'f' || (idx % {FILES}) AS name, row_number() OVER (PARTITION BY idx % {FILES} ORDER BY idx, split_part(name, '_', 3)::INT, atom_idx) - 1 AS atom_idx, symbol, x, y, z FROM atoms""",
    "sdf_files": f"""WITH {ATOMS},
m AS (SELECT idx, name, count(*)::INT AS n, count(*) FILTER (symbol = 'N' AND x > 25)::INT AS charge, row_number() OVER (PARTITION BY idx % {FILES} ORDER BY idx, name) - 1 AS nth
  FROM atoms GROUP BY idx, name)
SELECT 'f' || (idx % {FILES}) AS name, 2 * nth + copy AS record_no, n AS n_atoms, CASE WHEN copy = 0 THEN n - 1 ELSE 0 END::INT AS n_bonds, charge FROM m, range(2) c(copy)""",
    "kfold_assign": f"""SELECT o_orderkey AS idx, {bucket('o_orderkey', 'fold42', 3)}::INT AS fold
FROM orders WHERE {holdout('o_orderkey')} = 'train'""",
}
