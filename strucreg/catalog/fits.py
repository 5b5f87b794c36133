"""Fits on the numbers of the observations, small enough for SQL to make the same fit on its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strucreg.catalog import graphs
from strucreg.catalog.models import _draw, _everything, _metrics, _plain, _products
from strucreg.catalog.sql import ATOMS, OBS, X, Y, bucket, holdout, union_all, uniform
from strucreg.operators import gcn, graph, linear, network, partial_sums, search, split, trees
from strucreg.plans import bindings as b
from strucreg.scratch import scratch_path
from strucreg.sources import artifacts

METRICS = ("mse", "rmse", "r2", "mae", "mape")
# Small counts, as SQL makes the same trials; the searches over structures are in models.
TRIALS = {"ridge": 30, "lasso": 8, "elastic_net": 8}


def _shown(df: DataFrame, columns) -> DataFrame:
    """Six significant digits, in a form that both engines print alike."""
    return df.withColumns({c: F.format_string("%.5e", F.col(c)).cast("double") for c in columns})


def flagship(spark, sf_dir):
    """Observations through split, scaling, least squares and inverse scaling to five metrics per target."""
    table = _plain(spark, sf_dir)
    model = linear.ols(_everything(_products(table)))
    return _shown(_metrics(table, table.test.withColumn("prediction", model.predict(F.col("features")))), METRICS)


def _search(spark, sf_dir, family):
    """A few trials by three folds on the six numbers alone, the log written and read back, the refit of the best trial on the test rows."""
    table = _plain(spark, sf_dir)
    log, _, model = search.search_linear(spark, _products(table), family, TRIALS[family], gap=0.0)
    path = scratch_path(spark, "trials")
    artifacts.save_trials(log, path)
    winner = search.winner(artifacts.load_trials(spark, path))
    predicted = table.test.withColumn("prediction", model.predict(F.col("features")))
    out = _metrics(table, predicted).withColumns({k: F.lit(winner[k]) for k in ("trial", "value")})
    return _shown(out, [*METRICS, "value"])


def search_ridge_numbers(spark, sf_dir):
    return _search(spark, sf_dir, "ridge")


def search_lasso_numbers(spark, sf_dir):
    return _search(spark, sf_dir, "lasso")


def search_elastic_net_numbers(spark, sf_dir):
    return _search(spark, sf_dir, "elastic_net")


def cv_objective(spark, sf_dir):
    """Ridge on the six numbers over drawn strengths: mean of the three fold errors per trial."""
    log, _, _ = search.search_linear(spark, _products(_plain(spark, sf_dir)), "ridge", TRIALS["ridge"])
    return _shown(log.select("trial", "value"), ["value"])


def _counts(spark, sf_dir):
    """The one feature with few values, the number of items: its splits are exact."""
    table = _plain(spark, sf_dir)
    table.rows = table.rows.withColumn("features", F.slice("features", 5, 1))
    return table


def decision_stump(spark, sf_dir):
    table = _counts(spark, sf_dir)
    model = trees.fit_forest(table.train, "features", Y, 1, single_tree=True, max_depth=1, min_samples_leaf=3)
    return _shown(_metrics(table, model.predict(table.test)), METRICS)


BOOST = {"n_estimators": 3, "max_depth": 1, "learning_rate": 0.3, "subsample": 0.8, "min_child_weight": 2, "reg_lambda": 1.0}


def boosted_stumps(spark, sf_dir):
    table = _counts(spark, sf_dir)
    model = trees.fit_boosted(table.train, "idx", "features", Y, 1, **BOOST)
    return _shown(_metrics(table, model.predict(table.test)), METRICS)


# Coarse forms of three features: so few values that every cut between them is tried.
COARSE = (1, 3, 5)
LEVELS = {"max_depth": 2}


def _coarse(spark, sf_dir):
    table = _plain(spark, sf_dir)
    table.rows = table.rows.withColumn("features", F.array(*[F.floor(F.col("features")[i - 1] * 4).cast("double") for i in COARSE]))
    return table


def tree_levels(spark, sf_dir):
    """A tree of two levels on three features per target."""
    table = _coarse(spark, sf_dir)
    model = trees.fit_forest(table.train, "features", Y, 3, single_tree=True, min_samples_leaf=3, **LEVELS)
    return _shown(_metrics(table, model.predict(table.test)), METRICS)


BOOST_LEVELS = {"n_estimators": 3, "learning_rate": 0.4, "subsample": 0.7, "min_child_weight": 2, "reg_lambda": 1.0, **LEVELS}


def boosted_levels(spark, sf_dir):
    """Three rounds of trees of two levels on three features, each on a sample of the rows."""
    table = _coarse(spark, sf_dir)
    model = trees.fit_boosted(table.train, "idx", "features", Y, 3, cut_every=2, **BOOST_LEVELS)
    return _shown(_metrics(table, model.predict(table.test)), METRICS)


def forest_walk(spark, sf_dir):
    """Largest difference between a forest's trees walked as arrays and MLlib's own predictions, per target."""
    from pyspark.ml.functions import array_to_vector

    table = _plain(spark, sf_dir)
    options = {"numTrees": 12, "maxDepth": 7, "minInstancesPerNode": 2, "featureSubsetStrategy": "3", "bootstrap": True, "seed": 5, "maxBins": 64}
    models = trees.fit_mllib(table.train, "features", Y, **options)
    flat = trees.FlatTrees.joined([trees.FlatTrees.grown(m, t) for t, m in enumerate(models)])
    rows = trees.TreeModels(flat, len(Y)).predict(table.test).withColumn(trees.VECTOR, array_to_vector("features"))
    for i, m in enumerate(models):
        rows = m.setPredictionCol(f"_p{i}").transform(rows)
    gaps = [F.struct(F.lit(y).alias("target"), F.abs(F.col("prediction")[i] - F.col(f"_p{i}")).alias("gap")) for i, y in enumerate(Y)]
    long = rows.select(F.explode(F.array(*gaps)).alias("g")).select("g.*")
    return long.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("gap"), 9).alias("gap"))


def _by_rule(n_trees=9, depth=3):
    """Trees of equal depth whose features, cuts and values follow a rule."""
    parts = []
    for t in range(n_trees):
        inner, size = (1 << depth) - 1, (1 << (depth + 1)) - 1
        node = np.arange(size)
        feature = np.where(node < inner, (5 * node + 3 * t) % 6, -1).astype(np.int32)
        cut = np.where(node < inner, ((7 * node + 5 * t) % 13 - 6) / 4, 0.0)
        value = np.where(node < inner, 0.0, ((11 * node + 7 * t) % 17 - 8) / 8)
        child = np.where(node < inner, 2 * node, -2).astype(np.int32)
        parts.append(trees.FlatTrees(feature, cut, child + 1, child + 2, value, np.zeros(1, np.int32), np.array([t % 3], np.int32)))
    return trees.FlatTrees.joined(parts)


def forest_score(spark, sf_dir):
    """Every observation walks an ensemble by rule."""
    table = _plain(spark, sf_dir)
    told = trees.BoostedModel([0.5, -0.25, 0.0], 0.3, _by_rule()).predict(table.rows)
    return told.select("idx", *[F.round(F.col("prediction")[i], 6).alias(f"p{i}") for i in range(3)])


# Layers, units, activation, penalties and rate of the two networks; their weights start by rule.
NETS = {"slp": (1, 3, "tanh", 0.002, 0.003, 0.1), "mlp": (2, 2, "leaky_relu", 0.001, 0.002, 0.05)}
EPOCHS = 2


def _rule_weights(shape: network.Shape) -> list[np.ndarray]:
    return [np.array([((5 * i + 3 * a) % 11 - 5) / 10 for i in range(int(np.prod(s)))]).reshape(s) for a, s in enumerate(shape.arrays)]


def _net(spark, sf_dir, kind):
    """Whole-batch steps of one model."""
    layers, units, activation, l1, l2, rate = NETS[kind]
    table = _plain(spark, sf_dir)
    shape = network.Shape(6, 6, units, layers, activation, l1, l2)
    fit = network.fit(
        table.train, "idx", "features", Y, shape, split.validation_part(F.col("idx")), "SGD", rate, EPOCHS, batch=None,
        start=network.pack(_rule_weights(shape)),
    )
    return table, shape, fit


def _history(spark, sf_dir, kind):
    return _shown(_net(spark, sf_dir, kind)[2].history_table(spark), ["train_loss", "val_loss"])


def slp_steps(spark, sf_dir):
    return _history(spark, sf_dir, "slp")


def mlp_steps(spark, sf_dir):
    return _history(spark, sf_dir, "mlp")


def _net_metrics(spark, sf_dir, kind):
    table, shape, fit = _net(spark, sf_dir, kind)
    return _shown(_metrics(table, table.test.withColumn("prediction", network.predict(F.col("features"), shape, fit.weights))), METRICS)


def slp_metrics(spark, sf_dir):
    return _net_metrics(spark, sf_dir, "slp")


def mlp_metrics(spark, sf_dir):
    return _net_metrics(spark, sf_dir, "mlp")


Y_SIZES = (1e5, 1e5, 1e5, 10.0, 1e5, 1e4)


def small_graphs(spark, sf_dir):
    """Graph rows with the atoms' own numbers as node features and scaled targets."""
    atoms, bonds = graphs._graph(spark, sf_dir)
    own = F.array(*[F.col(c) / s for c, s in graphs.SIZES.items()])
    nodes = graph.atom_features(atoms, bonds, graphs.KEYS).select(*graphs.KEYS, "atom_idx", own.alias("features"))
    systems = atoms.select(*graphs.KEYS).distinct()
    systems = systems if "idx" in systems.columns else systems.withColumn("idx", F.split("name", "_")[1].cast("bigint"))
    targets = systems.join(b.observations(spark, sf_dir).drop("name"), "idx")
    targets = targets.select(*graphs.KEYS, F.array(*[F.col(y) / s for y, s in zip(Y, Y_SIZES)]).alias("y"))
    return gcn.graph_rows(nodes, graph.symmetric_edges(bonds, graphs.KEYS), targets, graphs.KEYS)


def gcn_gradient(spark, sf_dir):
    """Loss and gradient of a graph network with weights by rule, summed over all graphs: what a training step is made of."""
    rows = small_graphs(spark, sf_dir)
    shape = gcn.Shape(len(graphs.OWN), len(Y), graphs.HIDDEN, 2)
    weights = network.pack([np.array(w) for w in (graphs.W1, graphs.B1, graphs.W2, graphs.B2, graphs.W3, graphs.B3)])

    def task(batches):
        total = np.zeros(2 + weights.size)
        for batch in batches:
            if batch.num_rows:
                loss, slope = gcn.gradient_sums(shape, weights, *gcn.joined_graphs(batch))
                total += np.concatenate([[batch.num_rows, loss], slope])
        yield partial_sums.vector_rows({0: total})

    total = partial_sums.sum_vectors(rows, task)[0]
    return _shown(spark.createDataFrame([(i, float(v) + 0.0) for i, v in enumerate(total)], "pos int, value double"), ["value"])


QUERIES = {
    f.__name__: f
    for f in (
        gcn_gradient, flagship, cv_objective, search_ridge_numbers, search_lasso_numbers, search_elastic_net_numbers, decision_stump, boosted_stumps, tree_levels, boosted_levels, forest_walk, forest_score, slp_steps, mlp_steps, slp_metrics, mlp_metrics,
    )
}


def _six(expr: str) -> str:
    return f"printf('%.5e', {expr})::DOUBLE"


_S = [f"s{i}" for i in range(1, 7)]
_T = [f"t{i}" for i in range(1, 7)]
# rows with scaled features and targets, the split, fold and watch mark, and the numbers that undo the scaling
_TABLE = OBS + f""",
s0 AS (SELECT *, {holdout('idx')} AS split, {bucket('idx', 'fold42', 3)} AS fold, {bucket('idx', 'watch42', 10)} = 0 AS watch FROM obs),
stats AS MATERIALIZED (SELECT {', '.join(f"avg({c}) AS m_{c}, CASE WHEN min({c}) = max({c}) THEN 1 ELSE stddev_pop({c}) END AS d_{c}" for c in [*X, *Y])}
  FROM s0 WHERE split = 'train'),
z AS MATERIALIZED (SELECT s0.*, {', '.join(f'({c} - m_{c}) / d_{c} AS {n}' for c, n in zip([*X, *Y], [*_S, *_T]))},
  {', '.join(f'm_{y}, d_{y}' for y in Y)} FROM s0, stats)"""


def _metrics_sql(predicted: str, where: str = "", more: str = "") -> str:
    """Metrics of a table with y.. in original and h.. in scaled units, m_y.. and d_y.."""
    pairs = union_all(f"SELECT '{y}' AS target, {y} AS y, h{i} * d_{y} + m_{y} AS y_hat FROM {predicted} {where}" for i, y in enumerate(Y, 1))
    return f"""SELECT target, {_six('avg(pow(y - y_hat, 2))')} AS mse, {_six('sqrt(avg(pow(y - y_hat, 2)))')} AS rmse,
  {_six('1 - avg(pow(y - y_hat, 2)) / var_pop(y)')} AS r2, {_six('avg(abs(y - y_hat))')} AS mae,
  {_six('avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16))')} AS mape{more}
FROM ({pairs}) GROUP BY target"""


# groups 0 to 2: the training rows without a fold; group 3: all of them
_COV = ",\ncov AS MATERIALIZED (SELECT g, count(*)::DOUBLE AS n, [" + ", ".join(f"avg({s})" for s in _S) + "] AS mx, [" + ", ".join(
    f"avg({t})" for t in _T
) + "] AS my, [" + ", ".join("[" + ", ".join(f"avg({a} * {c}) - avg({a}) * avg({c})" for c in _S) + "]" for a in _S) + "] AS xx, [" + ", ".join(
    "[" + ", ".join(f"avg({a} * {c}) - avg({a}) * avg({c})" for c in _T) + "]" for a in _S
) + "] AS xy FROM z, range(4) r(g) WHERE split = 'train' AND (g = 3 OR fold <> g) GROUP BY g)"

# elimination on the matrix (X'X + alpha | X'y), a column per step; it is positive definite, so no row exchange is needed
_EXACT = """,
solve AS (
  SELECT trial, g, 1 AS k, list_transform(xx, lambda row, i: list_concat(
    list_transform(row, lambda v, j: n * v + CASE WHEN i = j THEN alpha ELSE 0 END), list_transform(xy[i], lambda v: n * v))) AS a
  FROM cov, trials
  UNION ALL
  SELECT trial, g, k + 1, list_transform(a, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / row[k])
    ELSE list_transform(row, lambda v, j: v - row[k] * a[k][j] / a[k][k]) END)
  FROM solve WHERE k <= 6),
fits AS (SELECT trial, g, list_transform(range(1, 7), lambda t: list_transform(range(1, 7), lambda i: a[i][6 + t])) AS w FROM solve WHERE k = 7)"""


def _descended(sweeps: int) -> str:
    rho = "(c.xy[j][t] - list_dot_product(c.xx[j], w) + c.xx[j][j] * w[j])"
    new = f"sign({rho}) * greatest(abs({rho}) - alpha * ratio, 0) / (c.xx[j][j] + alpha * (1 - ratio))"
    replaced = ", ".join(f"CASE WHEN j = {i} THEN v ELSE w[{i}] END" for i in range(1, 7))
    return f""",
descent AS (
  SELECT trial, g, t, 0 AS step, alpha, ratio, [0, 0, 0, 0, 0, 0]::DOUBLE[] AS w FROM trials, range(4) r(g), range(1, 7) q(t)
  UNION ALL
  SELECT trial, g, t, step + 1, alpha, ratio, [{replaced}]::DOUBLE[]
  FROM (SELECT d.*, {new} AS v FROM (SELECT *, step % 6 + 1 AS j FROM descent WHERE step < {6 * sweeps}) d JOIN cov c ON d.g = c.g)),
fits AS (SELECT trial, g, list(w ORDER BY t) AS w FROM descent WHERE step = {6 * sweeps} GROUP BY trial, g)"""


def _hat(t: int) -> str:
    return f"(my[{t}] + " + " + ".join(f"(s{i} - mx[{i}]) * w[{t}][{i}]" for i in range(1, 7)) + ")"


def _search_sql(family: str, refit: bool = True) -> str:
    space = search.SPACES[family]
    ratio = {"ridge": "0.0::DOUBLE", "lasso": "1.0::DOUBLE", "elastic_net": _draw("l1_ratio", ("float", 0.0, 1.0))}[family]
    trials = f"trials AS MATERIALIZED (SELECT trial, {_draw('alpha', space['alpha'])} AS alpha, {ratio} AS ratio FROM range({TRIALS[family]}) r(trial))"
    error = " + ".join(f"pow(t{t} - {_hat(t)}, 2)" for t in range(1, 7))
    scores = f"""WITH RECURSIVE {_TABLE}{_COV},
{trials}{_EXACT if family == 'ridge' else _descended(1000)},
errors AS (SELECT trial, f.g, avg(({error}) / 6) AS mse FROM z JOIN fits f ON z.fold = f.g JOIN cov c ON f.g = c.g WHERE split = 'train' GROUP BY trial, f.g),
scores AS (SELECT trial, avg(mse) AS value FROM errors GROUP BY trial)"""
    if not refit:
        return f"{scores} SELECT trial, {_six('value')} AS value FROM scores"
    return f"""{scores},
best AS (SELECT arg_min(trial, (value, trial)) AS trial, min(value) AS value FROM scores),
test AS (SELECT z.*, best.trial, value, {', '.join(f'{_hat(t)} AS h{t}' for t in range(1, 7))}
  FROM z, best JOIN fits f ON f.trial = best.trial AND f.g = 3 JOIN cov c ON c.g = 3 WHERE split = 'test')
{_metrics_sql('test', more=f", (SELECT trial FROM best) AS trial, (SELECT {_six('value')} FROM best) AS value")}"""


_FLAGSHIP = f"""WITH RECURSIVE {_TABLE}{_COV},
trials AS (SELECT 0 AS trial, 0.0::DOUBLE AS alpha){_EXACT},
test AS (SELECT z.*, {', '.join(f'{_hat(t)} AS h{t}' for t in range(1, 7))} FROM z, fits f JOIN cov c ON c.g = 3 WHERE f.g = 3 AND split = 'test')
{_metrics_sql('test')}"""


# least squares on the numbers and all coordinates: the products of all columns, then elimination. The shortest solution is where
# ridge goes as its strength vanishes: two small strengths are solved and the line through both is followed to 0
_OLS = f"""WITH RECURSIVE {OBS}, {ATOMS},
systems AS MATERIALIZED (SELECT DISTINCT idx, name FROM atoms),
rows_ AS MATERIALIZED (SELECT s.name, {holdout('s.idx')} AS split, {', '.join([*X, *Y])} FROM systems s JOIN obs ON s.idx = obs.idx),
width AS (SELECT 6 + 3 * (max(atom_idx) + 1) AS d FROM atoms),
given AS (
  {union_all(f"SELECT name, {i} AS pos, {x} AS v FROM rows_" for i, x in enumerate(X, 1))}
  UNION ALL {union_all(f"SELECT name, 6 + 3 * atom_idx + {i} AS pos, {c} AS v FROM atoms" for i, c in enumerate("xyz", 1))}
  UNION ALL {union_all(f"SELECT name, d + {i} AS pos, {y} AS v FROM rows_, width" for i, y in enumerate(Y, 1))}),
entries AS MATERIALIZED (SELECT name, split, pos, coalesce(v, 0)::DOUBLE AS v FROM (SELECT name, split, unnest(range(1, d + 7)) AS pos FROM rows_, width) LEFT JOIN given USING (name, pos)),
scales AS MATERIALIZED (SELECT pos, avg(v) AS m, CASE WHEN min(v) = max(v) THEN 1 ELSE stddev_pop(v) END AS s FROM entries WHERE split = 'train' GROUP BY pos),
zs AS MATERIALIZED (SELECT name, split, pos, (v - m) / s AS v FROM entries JOIN scales USING (pos)),
grams AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, sum(a.v * b.v) AS p FROM zs a JOIN zs b USING (name) WHERE a.split = 'train' AND b.split = 'train' GROUP BY ALL),
rows_of AS (SELECT i, list(p ORDER BY j) AS row FROM grams, width WHERE i <= d GROUP BY i),
solve AS (
  SELECT 1 AS k, lam, list_transform(a, lambda row, i: list_transform(row, lambda v, j: v + CASE WHEN i = j THEN lam * 1e-7 * n ELSE 0 END)) AS a
  FROM (SELECT list(row ORDER BY i) AS a FROM rows_of), (SELECT count(*)::DOUBLE AS n FROM rows_ WHERE split = 'train'), range(1, 3) r(lam)
  UNION ALL
  SELECT k + 1, lam, list_transform(a, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / row[k])
    ELSE list_transform(row, lambda v, j: v - row[k] * a[k][j] / a[k][k]) END)
  FROM solve, width WHERE k <= d),
solved AS MATERIALIZED (SELECT lam, a FROM solve, width WHERE k = d + 1),
weights AS MATERIALIZED (SELECT list_transform(range(1, 7), lambda t: list_transform(range(1, d + 1), lambda i: 2 * one.a[i][d + t] - two.a[i][d + t])) AS w
  FROM solved one, solved two, width WHERE one.lam = 1 AND two.lam = 2),
vectors AS (SELECT name, list(v ORDER BY pos) AS x FROM zs, width WHERE split = 'test' AND pos <= d GROUP BY name),
test AS (SELECT {', '.join(Y)}, {', '.join(f'list_dot_product(x, w[{t}]) AS h{t}' for t in range(1, 7))},
  {', '.join(f"(SELECT m FROM scales, width WHERE pos = d + {i}) AS m_{y}, (SELECT s FROM scales, width WHERE pos = d + {i}) AS d_{y}" for i, y in enumerate(Y, 1))}
  FROM vectors JOIN rows_ USING (name), weights)
{_metrics_sql('test')}"""


def _stump(rows: str, name: str, least: int) -> str:
    """The best cut of x5 per target for rows (target, x, r): the smallest sum of squares within the sides."""
    return f"""
{name}_by AS (SELECT target, x, count(*)::DOUBLE AS n, sum(r) AS s FROM {rows} GROUP BY target, x),
{name}_cuts AS (
  SELECT a.target, a.x AS cut, sum(b.n) FILTER (b.x <= a.x) AS nl, sum(b.s) FILTER (b.x <= a.x) AS sl,
         sum(b.n) FILTER (b.x > a.x) AS nr, sum(b.s) FILTER (b.x > a.x) AS sr
  FROM {name}_by a JOIN {name}_by b ON a.target = b.target GROUP BY a.target, a.x),
{name} AS (
  SELECT target, arg_max((cut, nl, sl, nr, sr), sl * sl / nl + sr * sr / nr) AS c
  FROM {name}_cuts WHERE nl >= {least} AND nr >= {least} GROUP BY target)"""


_LONG = _TABLE + ",\nlong AS MATERIALIZED (" + union_all(
    f"SELECT idx, split, '{y}' AS target, x5 AS x, {t} AS r, {y} AS y, m_{y} AS m, d_{y} AS d FROM z" for y, t in zip(Y, _T)
) + ")"


def _long_metrics(source: str, hat: str) -> str:
    return f"""SELECT target, {_six('avg(pow(y - y_hat, 2))')} AS mse, {_six('sqrt(avg(pow(y - y_hat, 2)))')} AS rmse,
  {_six('1 - avg(pow(y - y_hat, 2)) / var_pop(y)')} AS r2, {_six('avg(abs(y - y_hat))')} AS mae,
  {_six('avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16))')} AS mape
FROM (SELECT target, y, {hat} * d + m AS y_hat FROM {source} WHERE split = 'test') GROUP BY target"""


_DECISION = f"""WITH {_LONG}, learn AS (SELECT * FROM long WHERE split = 'train'),{_stump('learn', 'best', 3)},
told AS (SELECT long.*, CASE WHEN x <= c[1] THEN c[3] / c[2] ELSE c[5] / c[4] END AS h FROM long JOIN best USING (target))
{_long_metrics('told', 'h')}"""


def _boosted_sql() -> str:
    rate, lam = BOOST["learning_rate"], BOOST["reg_lambda"]
    sql = f"WITH {_LONG},\nstart AS (SELECT target, avg(r) AS base FROM long WHERE split = 'train' GROUP BY target),"
    sql += "\nb0 AS MATERIALIZED (SELECT long.* EXCLUDE (r), r - base AS r, base AS h FROM long JOIN start USING (target))"
    for k in range(BOOST["n_estimators"]):
        chosen = f"{uniform('idx', f'row42.{k}')} < {BOOST['subsample']}::DOUBLE"
        sql += f",\nl{k} AS (SELECT * FROM b{k} WHERE split = 'train' AND {chosen}),{_stump(f'l{k}', f'cut{k}', BOOST['min_child_weight'])}"
        leaf = f"CASE WHEN x <= c[1] THEN c[3] / (c[2] + {lam}) ELSE c[5] / (c[4] + {lam}) END * {rate}::DOUBLE"
        sql += f",\nb{k + 1} AS MATERIALIZED (SELECT b.* EXCLUDE (r, h), r - {leaf} AS r, h + {leaf} AS h FROM b{k} b JOIN cut{k} USING (target))"
    return f"{sql}\n{_long_metrics('b%d' % BOOST['n_estimators'], 'h')}"


def _grown_sql(rows: str, name: str, least: int, depth: int) -> str:
    """Adds ``node`` to ``rows`` (target, learn, f1.., r): the leaf of each row in the tree grown on the rows to learn from."""
    sql = f"\n{name}_n0 AS (SELECT *, 1 AS node FROM {rows})"
    for k in range(depth):
        long = union_all(f"SELECT target, node, {i} AS feature, f{i} AS x, r FROM {name}_n{k} WHERE learn" for i in (1, 2, 3))
        sql += f""",
{name}_by{k} AS (SELECT target, node, feature, x, count(*)::DOUBLE AS n, sum(r) AS s FROM ({long}) GROUP BY ALL),
{name}_cuts{k} AS (
  SELECT a.target, a.node, a.feature, a.x AS cut, sum(b.n) FILTER (b.x <= a.x) AS nl, sum(b.s) FILTER (b.x <= a.x) AS sl, sum(b.n) FILTER (b.x > a.x) AS nr, sum(b.s) FILTER (b.x > a.x) AS sr
  FROM {name}_by{k} a JOIN {name}_by{k} b ON a.target = b.target AND a.node = b.node AND a.feature = b.feature GROUP BY ALL),
{name}_best{k} AS (SELECT target, node, arg_max((feature, cut), sl * sl / nl + sr * sr / nr) AS c FROM {name}_cuts{k} WHERE nl >= {least} AND nr >= {least} GROUP BY ALL),
{name}_n{k + 1} AS MATERIALIZED (
  SELECT t.* EXCLUDE (node), 2 * node + CASE WHEN c IS NULL THEN 0 ELSE (CASE c[1] WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END > c[2])::INT END AS node
  FROM {name}_n{k} t LEFT JOIN {name}_best{k} USING (target, node))"""
    return sql


_LONG3 = _TABLE + ",\nlong AS MATERIALIZED (" + union_all(
    f"SELECT idx, split, '{y}' AS target, {', '.join(f'floor(s{c} * 4) AS f{i}' for i, c in enumerate(COARSE, 1))}, {t} AS r, {y} AS y, m_{y} AS m, d_{y} AS d FROM z" for y, t in zip(Y, _T)
) + ")"

_TREE_LEVELS = f"""WITH {_LONG3}, marked AS (SELECT *, split = 'train' AS learn FROM long),{_grown_sql('marked', 'g', 3, LEVELS['max_depth'])},
leaf AS (SELECT target, node, avg(r) AS h FROM g_n{LEVELS['max_depth']} WHERE learn GROUP BY ALL),
told AS (SELECT * FROM g_n{LEVELS['max_depth']} JOIN leaf USING (target, node))
{_long_metrics('told', 'h')}"""


def _boosted_levels_sql() -> str:
    rate, lam, depth = BOOST_LEVELS["learning_rate"], BOOST_LEVELS["reg_lambda"], LEVELS["max_depth"]
    sql = f"WITH {_LONG3},\nstart AS (SELECT target, avg(r) AS base FROM long WHERE split = 'train' GROUP BY target),"
    sql += "\nb0 AS MATERIALIZED (SELECT long.* EXCLUDE (r), r - base AS r, base AS h FROM long JOIN start USING (target))"
    for k in range(BOOST_LEVELS["n_estimators"]):
        chosen = f"{uniform('idx', f'row42.{k}')} < {BOOST_LEVELS['subsample']}::DOUBLE"
        sql += f",\nc{k} AS (SELECT *, split = 'train' AND {chosen} AS learn FROM b{k}),{_grown_sql(f'c{k}', f'g{k}', BOOST_LEVELS['min_child_weight'], depth)}"
        sql += f",\nleaf{k} AS (SELECT target, node, sum(r) / (count(*) + {lam}) * {rate}::DOUBLE AS v FROM g{k}_n{depth} WHERE learn GROUP BY ALL)"
        sql += f",\nb{k + 1} AS MATERIALIZED (SELECT g.* EXCLUDE (r, h, node, learn, v), r - coalesce(v, 0) AS r, h + coalesce(v, 0) AS h FROM (SELECT * FROM g{k}_n{depth} LEFT JOIN leaf{k} USING (target, node)) g)"
    return f"{sql}\n{_long_metrics('b%d' % BOOST_LEVELS['n_estimators'], 'h')}"


def _forest_score_sql() -> str:
    flat = _by_rule()

    def told(node: int) -> str:
        if flat.feature[node] < 0:
            return f"{float(flat.value[node])!r}::DOUBLE"
        return f"CASE WHEN s{flat.feature[node] + 1} <= {float(flat.cut[node])!r}::DOUBLE THEN {told(flat.left[node])} ELSE {told(flat.right[node])} END"

    sums = [" + ".join(told(r) for r, t in zip(flat.roots, flat.targets) if t == i) for i in range(3)]
    return f"WITH {_TABLE} SELECT idx, " + ", ".join(f"round({start}::DOUBLE + 0.3::DOUBLE * ({e}), 6) + 0.0::DOUBLE AS p{i}" for i, (start, e) in enumerate(zip((0.5, -0.25, 0.0), sums))) + " FROM z"


def _net_sql(kind: str, metrics: bool) -> str:
    layers, units, activation, l1, l2, rate = NETS[kind]
    shape = network.Shape(6, 6, units, layers, activation, l1, l2)
    weights = _rule_weights(shape)
    names = [np.array([f"w{a}_{i}" for i in range(w.size)]).reshape(w.shape) for a, w in enumerate(weights)]
    sql = f"WITH {_TABLE},\np0 AS (SELECT " + ", ".join(f"{v!r}::DOUBLE AS {n}" for ns, w in zip(names, weights) for n, v in zip(ns.ravel(), w.ravel().tolist())) + ")"

    def value(e: str) -> str:
        return f"tanh({e})" if activation == "tanh" else f"CASE WHEN {e} >= 0 THEN {e} ELSE 0.2::DOUBLE * ({e}) END"

    def slope(a: str) -> str:
        return f"(1 - {a} * {a})" if activation == "tanh" else f"(CASE WHEN {a} >= 0 THEN 1 ELSE 0.2::DOUBLE END)"

    def forward(e: int) -> str:
        out, inputs, last = "", _S, f"(SELECT * FROM z, p{e})"
        for layer in range(layers):
            kernel, bias = names[2 * layer], names[2 * layer + 1]
            made = [f"a{layer}_{j}" for j in range(units)]
            sums = [" + ".join([bias[j], *[f"{s} * {kernel[i][j]}" for i, s in enumerate(inputs)]]) for j in range(units)]
            out += f",\nf{e}_{layer} AS (SELECT *, {', '.join(f'{value(f'({x})')} AS {m}' for x, m in zip(sums, made))} FROM {last})"
            inputs, last = made, f"f{e}_{layer}"
        kernel, bias = names[-2], names[-1]
        heads = [" + ".join([bias[k], *[f"{s} * {kernel[i][k]}" for i, s in enumerate(inputs)]]) for k in range(6)]
        return out + f",\no{e} AS MATERIALIZED (SELECT *, {', '.join(f'{x} AS h{k + 1}' for k, x in enumerate(heads))} FROM {last})"

    hidden = [n for layer in range(layers) for n in names[2 * layer].ravel()]
    penalty = " + ".join(f"{l1}::DOUBLE * abs({n}) + {l2}::DOUBLE * {n} * {n}" for n in hidden)
    error = "(" + " + ".join(f"pow(h{k} - t{k}, 2)" for k in range(1, 7)) + ") / 6"
    rows = []
    for e in range(EPOCHS + 1):
        sql += forward(e)
        sql += f""",
loss{e} AS (SELECT avg({error}) FILTER (NOT watch) + any_value({penalty}) AS train, avg({error}) FILTER (watch) + any_value({penalty}) AS val
  FROM o{e} WHERE split = 'train')"""
        if e == EPOCHS:
            break
        back = {k: f"(2 * (h{k + 1} - t{k + 1}) / 6)" for k in range(6)}
        grads, inner = {}, [f"a{layers - 1}_{j}" for j in range(units)]
        for k in range(6):
            grads[names[-1][k]] = f"avg({back[k]})"
            for j in range(units):
                grads[names[-2][j][k]] = f"avg({inner[j]} * {back[k]})"
        flow = {j: "(" + " + ".join(f"{names[-2][j][k]} * {back[k]}" for k in range(6)) + ")" for j in range(units)}
        for layer in range(layers - 1, -1, -1):
            flow = {j: f"({flow[j]} * {slope(f'a{layer}_{j}')})" for j in range(units)}
            inputs = _S if layer == 0 else [f"a{layer - 1}_{j}" for j in range(units)]
            for j in range(units):
                grads[names[2 * layer + 1][j]] = f"avg({flow[j]})"
                for i, s in enumerate(inputs):
                    n = names[2 * layer][i][j]
                    grads[n] = f"avg({s} * {flow[j]}) + any_value({l1}::DOUBLE * sign({n}) + 2 * {l2}::DOUBLE * {n})"
            if layer:
                flow = {i: "(" + " + ".join(f"{names[2 * layer][i][j]} * {flow[j]}" for j in range(units)) + ")" for i in range(units)}
        sql += f",\np{e + 1} AS MATERIALIZED (SELECT " + ", ".join(f"any_value({n}) - {rate}::DOUBLE * ({g}) AS {n}" for n, g in grads.items()) + f"\n  FROM o{e} WHERE split = 'train' AND NOT watch)"
        rows.append(f"SELECT {e + 1} AS epoch, {_six(f'loss{e}.train')} AS train_loss, {_six(f'loss{e + 1}.val')} AS val_loss FROM loss{e}, loss{e + 1}")
    if not metrics:
        return sql + "\n" + union_all(rows)
    # the weights of the best epoch
    best = f"(SELECT CASE WHEN loss2.val < loss1.val THEN 2 ELSE 1 END FROM loss1, loss2)"
    told = union_all(f"SELECT {', '.join([*Y, *(f'h{k}' for k in range(1, 7)), *(f'm_{y}, d_{y}' for y in Y)])} FROM o{e} WHERE split = 'test' AND {best} = {e}" for e in (1, 2))
    return f"{sql},\ntold AS ({told})\n{_metrics_sql('told')}"


def _gradient_sql() -> str:
    own, hidden = graphs.OWN, graphs.H
    num = lambda v: f"{float(v)!r}::DOUBLE"

    def layer(source: str, out: str, inputs, w, bias) -> str:
        sums = [" + ".join([num(bias[j]), *(f"{c} * {num(w[i][j])}" for i, c in enumerate(inputs))]) for j in range(len(hidden))]
        return f",\n{out} AS MATERIALIZED (SELECT name, atom_idx, d, {', '.join(f'greatest({x}, 0) AS {h}' for x, h in zip(sums, hidden))} FROM {source})"

    sql = f"WITH {OBS}, {graphs._READY}{graphs._step('ready', 'sa', own)}{layer('sa', 'u1', own, graphs.W1, graphs.B1)}"
    sql += f"{graphs._step('u1', 'sb', hidden)}{layer('sb', 'u2', hidden, graphs.W2, graphs.B2)}"
    heads = [" + ".join([num(graphs.B3[k]), *(f"avg({h}) * {num(graphs.W3[j][k])}" for j, h in enumerate(hidden))]) for k in range(6)]
    sql += f""",
pool AS (SELECT name, count(*) AS n, {', '.join(f'avg({h}) AS m{j}' for j, h in enumerate(hidden))}, {', '.join(f'{x} AS q{k}' for k, x in enumerate(heads))}
  FROM u2 GROUP BY name),
systems AS (SELECT DISTINCT idx, name FROM feats),
errors AS MATERIALIZED (SELECT pool.*, {', '.join(f'q{k} - {y} / {num(s)} AS e{k}' for k, (y, s) in enumerate(zip(Y, Y_SIZES)))}
  FROM pool JOIN systems USING (name) JOIN obs ON systems.idx = obs.idx),
back2 AS MATERIALIZED (SELECT u2.name, u2.atom_idx, u2.d, {', '.join(
    f"CASE WHEN {h} > 0 THEN ({' + '.join(f'{num(graphs.W3[j][k])} * e{k} / 3' for k in range(6))}) / n ELSE 0 END AS b{j}" for j, h in enumerate(hidden)
  )} FROM u2 JOIN errors USING (name)),
inner1 AS (SELECT name, atom_idx, d, {', '.join(
    f"{' + '.join(f'b{j} * {num(graphs.W2[i][j])}' for j in range(len(hidden)))} AS {h}" for i, h in enumerate(hidden))} FROM back2)"""
    sql += graphs._step("inner1", "sent1", hidden)
    sql += f""",
back1 AS MATERIALIZED (SELECT s.name, s.atom_idx, {', '.join(f'CASE WHEN u1.{h} > 0 THEN s.{h} ELSE 0 END AS b{j}' for j, h in enumerate(hidden))}
  FROM sent1 s JOIN u1 USING (name, atom_idx))"""
    n = len(hidden)
    parts = [("errors", ["count(*)::DOUBLE", "sum((" + " + ".join(f"e{k} * e{k}" for k in range(6)) + ") / 6)"])]
    parts += [("back1 JOIN sa USING (name, atom_idx)", [f"sum({c} * b{j})" for c in own for j in range(n)]), ("back1", [f"sum(b{j})" for j in range(n)])]
    parts += [("back2 JOIN sb USING (name, atom_idx)", [f"sum({h} * b{j})" for h in hidden for j in range(n)]), ("back2", [f"sum(b{j})" for j in range(n)])]
    parts += [("errors", [f"sum(m{j} * e{k} / 3)" for j in range(n) for k in range(6)]), ("errors", [f"sum(e{k} / 3)" for k in range(6)])]
    rows, at = [], 0
    for source, sums in parts:
        rows.append(f"SELECT unnest(range({at}, {at + len(sums)}))::INT AS pos, unnest([{', '.join(sums)}]) AS value FROM {source}")
        at += len(sums)
    return f"{sql}\nSELECT pos, {_six('value')} + 0.0::DOUBLE AS value FROM ({union_all(rows)})"


SQL = {
    "gcn_gradient": _gradient_sql(),
    "flagship": _FLAGSHIP,
    "cv_objective": _search_sql("ridge", refit=False),
    "ols_structures": _OLS,
    **{f"search_{f}_numbers": _search_sql(f) for f in TRIALS},
    "decision_stump": _DECISION,
    "tree_levels": _TREE_LEVELS,
    "boosted_levels": _boosted_levels_sql(),
    "forest_score": _forest_score_sql(),
    "forest_walk": f"WITH {OBS} SELECT target, count(*) FILTER ({holdout('idx')} = 'test') AS n, 0.0::DOUBLE AS gap FROM obs, (VALUES {', '.join(f"('{y}')" for y in Y)}) t(target) GROUP BY target",
    "boosted_stumps": _boosted_sql(),
    "slp_steps": _net_sql("slp", False),
    "mlp_steps": _net_sql("mlp", False),
    "slp_metrics": _net_sql("slp", True),
    "mlp_metrics": _net_sql("mlp", True),
}
