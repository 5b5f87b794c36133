"""Model fits, searches and the pipelines around them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import functions as F

from strucreg.catalog.common import rounded
from strucreg.catalog.graphs import _FINGERPRINT, _graph
from strucreg.catalog.sql import OBS, X, Y, bucket, holdout, rnd, uniform, union_all
from strucreg.functions import arrays
from strucreg.operators import evaluate, gcn, linear, network, search, split, stopping, training, trees
from strucreg.plans import bindings as b
from strucreg.plans import graphs as graph_plan
from strucreg.plans import scoring, tabular, train
from strucreg.scratch import scratch_path
from strucreg.sources import artifacts


def _plain(spark, sf_dir) -> tabular.TrainingTable:
    """Observations with their six numbers."""
    rows = b.observations(spark, sf_dir).withColumn("features", F.array(*X))
    return tabular.training_table(rows, "idx", Y)


def _full(spark, sf_dir) -> tabular.TrainingTable:
    """Systems with the numbers of their order and their padded coordinates."""
    # systems have at most 72 atoms, so their coordinates may be gathered without a check
    coords = arrays.flatten(b.atoms(spark, sf_dir), ["idx", "name"], None)
    rows = b.observations(spark, sf_dir).drop("name")
    with_features, length = tabular.structure_features(rows, coords, "idx", X)
    return tabular.training_table(with_features, "name", Y, length=length, split_key="idx")


def _products(table: tabular.TrainingTable) -> dict:
    return linear.cross_products(table.train, "features", table.targets, F.col("fold"))


def _everything(products: dict) -> linear.CrossProducts:
    return sum(list(products.values())[1:], next(iter(products.values())))


def _metrics(table, predicted):
    """Five metrics per target on the test rows, original units."""
    return evaluate.regression_metrics(table.pairs(predicted))


def _shown(df, columns=("mse", "rmse", "r2", "mae", "mape")):
    """Six significant digits, in a form that both engines print alike."""
    return df.withColumns({c: F.format_string("%.5e", F.col(c)).cast("double") for c in columns})


def ols_structures(spark, sf_dir):
    """Least squares on the numbers and all padded coordinates, from a triangular factor of the rows."""
    table = _full(spark, sf_dir)
    model = linear.least_squares(table.train, "features", table.targets)
    return _shown(_metrics(table, table.test.withColumn("prediction", model.predict(F.col("features")))))


# --- linear -------------------------------------------------------------------


def _coefficients(spark, sf_dir, fit):
    table = _plain(spark, sf_dir)
    model = fit(_everything(_products(table)))
    table.unpersist()
    return rounded(model.table(spark, Y, X).drop("intercept"), ["coefficient"], 4)


def ols_fit(spark, sf_dir):
    return _coefficients(spark, sf_dir, linear.ols)


def ridge_fit(spark, sf_dir):
    return _coefficients(spark, sf_dir, lambda p: linear.ridge(p, 50.0))


def lasso_fit(spark, sf_dir):
    return _coefficients(spark, sf_dir, lambda p: linear.lasso(p, 0.05))


def elastic_net_fit(spark, sf_dir):
    return _coefficients(spark, sf_dir, lambda p: linear.elastic_net(p, 0.1, 0.3))


def ols_predict(spark, sf_dir):
    """One feature, original units, so that SQL has a closed form."""
    obs = b.observations(spark, sf_dir).withColumn("split", split.holdout(F.col("idx")))
    model = linear.ols(linear.cross_products(obs.filter(F.col("split") == "train"), ["x2"], Y)[0])
    hats = model.predict_columns(["x2"], [f"h_{y}" for y in Y])
    out = obs.filter(F.col("split") == "test").select("idx", *[c.alias(n) for n, c in hats.items()])
    return rounded(out, list(hats), 3)


# Trials of the linear searches, as many as the reference makes.
TRIALS = {"ridge": 1000, "lasso": 1000, "elastic_net": 1000}


def _search_linear(spark, sf_dir, family):
    """Trials by three folds over the numbers and padded coordinates, the log written and read back, the refit of the best trial on the test rows."""
    table = _full(spark, sf_dir)
    log, _, model = search.search_linear(spark, _products(table), family, TRIALS[family])
    path = scratch_path(spark, "trials")
    artifacts.save_trials(log, path)
    winner = search.winner(artifacts.load_trials(spark, path))
    predicted = table.test.withColumn("prediction", model.predict(F.col("features")))
    return _metrics(table, predicted).withColumns({k: F.lit(winner[k]) for k in ("trial", "value")})


def search_ridge(spark, sf_dir):
    return _search_linear(spark, sf_dir, "ridge")


def search_lasso(spark, sf_dir):
    return _search_linear(spark, sf_dir, "lasso")


def search_elastic_net(spark, sf_dir):
    return _search_linear(spark, sf_dir, "elastic_net")


# --- search parts -------------------------------------------------------------

_SPACE = {
    **search.SPACES["elastic_net"],
    "max_depth": search.SPACES["boosted_trees"]["max_depth"],
    "units": search.SPACES["mlp"]["units"],
    "max_features": search.SPACES["decision_tree"]["max_features"],
}


def trial_space(spark, sf_dir):
    numbers = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trial"))
    return rounded(search.trial_table(numbers, _SPACE), ["alpha", "l1_ratio"])


def best_trial(spark, sf_dir):
    """Every event type is a study, its events are the trials."""
    trials = b.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("study"),
        F.col("event_id").alias("trial"),
        F.round("value", 0).alias("value"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("params"),
    )
    best = search.best_trial(trials, ["study"])
    return best.select("study", "trial", "value", F.col("params")["user"].alias("user"))


def _losses(spark, sf_dir):
    """Runs of a hundred epochs each."""
    return b.table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 100).alias("run"), (F.col("event_id") % 100).cast("int").alias("epoch"), F.col("value").alias("loss")
    )


def early_stop(spark, sf_dir):
    return rounded(stopping.early_stop(_losses(spark, sf_dir), ["run"], patience=20, min_delta=0.0), ["best_loss"], 4)


def early_stop_delta(spark, sf_dir):
    return rounded(stopping.early_stop(_losses(spark, sf_dir), ["run"], patience=10, min_delta=2.0), ["best_loss"], 4)


# --- trees --------------------------------------------------------------------


def _forest(spark, sf_dir, **options):
    table = _full(spark, sf_dir)
    model = trees.fit_forest(table.train, "features", Y, table.width, **options)
    return _metrics(table, model.predict(table.test))


def decision_tree(spark, sf_dir):
    return _forest(spark, sf_dir, single_tree=True, max_depth=6, min_samples_split=4, min_samples_leaf=3, max_features="0.8")


def random_forest(spark, sf_dir):
    """Ten trees per target."""
    return _forest(spark, sf_dir, n_estimators=10, max_depth=6, max_features="0.5")


def boosted_trees(spark, sf_dir):
    """Three rounds."""
    table = _full(spark, sf_dir)
    model = trees.fit_boosted(
        table.train, "name", "features", Y, table.width,
        n_estimators=3, max_depth=4, learning_rate=0.3, subsample=0.8, colsample_bytree=0.8, min_child_weight=2,
    )
    return _metrics(table, model.predict(table.test))


def _search(spark, sf_dir, model, n_trials, **options):
    table = _full(spark, sf_dir)
    _, _, fitted = train.search_model(table, model, n_trials, **options)
    return _metrics(table, fitted.predict(table.test))


def search_decision_tree(spark, sf_dir):
    """Two trials by three folds, then the refit."""
    return _search(spark, sf_dir, "decision_tree", 2)


def search_random_forest(spark, sf_dir):
    """One trial by three folds of five to ten trees, then the refit: every fold grows its forest anew."""
    return _search(spark, sf_dir, "random_forest", 1, space={"n_estimators": ("int", 5, 10), "max_depth": ("int", 3, 8)})


def search_boosted_trees(spark, sf_dir):
    """Two trials by three folds of two to four rounds, then the refit."""
    return _search(spark, sf_dir, "boosted_trees", 2, space={"n_estimators": ("int", 2, 4), "max_depth": ("int", 3, 5), "learning_rate": ("log_float", 0.1, 0.5)})


def search_slp(spark, sf_dir):
    """Twelve trials by three folds, two epochs each, all in the same jobs; then the refit."""
    return _search(spark, sf_dir, "slp", 12, epochs=2)


def search_mlp(spark, sf_dir):
    """Eight trials by three folds, two epochs each, all in the same jobs; then the refit."""
    return _search(spark, sf_dir, "mlp", 8, epochs=2)


def search_gcn(spark, sf_dir):
    """Four trials by three folds, one epoch each, all in the same jobs; then the refit, watched on the validation graphs, and its metrics on the test graphs."""
    rows, table = _graph_rows(spark, sf_dir)
    _, _, (shape, fit) = train.search_graph_model(table, 4, epochs=1)
    return _graph_metrics(rows, table, shape, fit)


# --- networks -----------------------------------------------------------------


def _network(spark, sf_dir, layers, activation, units, l1, l2, epochs):
    table = _full(spark, sf_dir)
    shape = network.Shape(table.width, len(Y), units, layers, activation, l1, l2)
    fit = network.fit(
        table.train, "name", "features", Y, shape, split.validation_part(F.col("name")),
        optimizer="RMSprop", learning_rate=2e-3, epochs=epochs,
    )
    return table, shape, fit


# Activation, units and penalties of the best known networks.
SLP = ("relu", 100, 5.181947193645403e-4, 9.731243450898303e-06)
MLP = ("leaky_relu", 87, 4.0322538610911165e-4, 2.899284099154708e-05)


def slp_train(spark, sf_dir):
    """Losses of three epochs."""
    table, _, fit = _network(spark, sf_dir, 1, *SLP, 3)
    table.unpersist()
    return fit.history_table(spark)


def slp_predict(spark, sf_dir):
    """Metrics after five epochs."""
    table, shape, fit = _network(spark, sf_dir, 1, *SLP, 5)
    return _metrics(table, table.test.withColumn("prediction", network.predict(F.col("features"), shape, fit.weights)))


def mlp_train(spark, sf_dir):
    """Losses of three epochs."""
    table, _, fit = _network(spark, sf_dir, 2, *MLP, 3)
    table.unpersist()
    return fit.history_table(spark)


def mlp_predict(spark, sf_dir):
    """Metrics after five epochs."""
    table, shape, fit = _network(spark, sf_dir, 2, *MLP, 5)
    return _metrics(table, table.test.withColumn("prediction", network.predict(F.col("features"), shape, fit.weights)))


def _graph_rows(spark, sf_dir):
    atoms, bonds = _graph(spark, sf_dir)
    keys = ("idx", "part")
    systems = atoms.select(*keys).distinct()
    rows = b.observations(spark, sf_dir).drop("name").join(systems, "idx")
    return rows, graph_plan.graph_table(rows, "idx", X, Y, atoms, bonds, keys)


def _graph_fit(spark, sf_dir, epochs):
    rows, table = _graph_rows(spark, sf_dir)
    # fixed values: units, layers and dropout of the best known graph network
    shape = gcn.Shape(table.width, len(Y), 35, 3, "relu", 0.45)
    fit = gcn.fit(
        table.training_rows(), ("idx", "part"), shape, "RMSprop", learning_rate=1e-3, weight_decay=5e-5, epochs=epochs,
        large=table.large,
    )
    return rows, table, shape, fit


def gcn_train(spark, sf_dir):
    """Losses of two epochs."""
    _, table, _, fit = _graph_fit(spark, sf_dir, 2)
    table.rows.unpersist()
    return fit.history_table(spark)


def _graph_metrics(rows, table, shape, fit):
    both = table.predict(shape, fit.weights).join(rows, ["idx", "part"])
    hats = [F.col("prediction")[i].alias(f"h_{y}") for i, y in enumerate(Y)]
    pairs = evaluate.long_pairs(both.select("idx", *Y, *hats), ["idx"], Y, Y, [f"h_{y}" for y in Y])
    return evaluate.regression_metrics(pairs)


def gcn_fit_predict(spark, sf_dir):
    """Five metrics per target of a graph network trained for three epochs on the test graphs."""
    return _graph_metrics(*_graph_fit(spark, sf_dir, 3))


def _graph_scorer():
    """A small graph network with fixed weights, and the scale of its 267 inputs."""
    shape = gcn.Shape(6 + 256 + 5, 6, 8, 2, "relu")
    return shape, np.round(shape.start(7), 6), [1000.0] * 6 + [1.0] * 256 + [10.0] * 5


def score_graph_batch(spark, sf_dir):
    """Requests with an SDF text: weights by rule, rejected requests with their reason."""
    requests = b.sdf_text(b.atoms(spark, sf_dir))
    requests = requests.withColumn("idx", F.split("name", "_")[1].cast("bigint")).join(
        b.observations(spark, sf_dir).select("idx", *X), "idx"
    )
    shape, weights, spreads = _graph_scorer()
    scored, rejected = scoring.score_graph_requests(requests, "name", X, shape, weights, ([0.0] * shape.inputs, spreads), [(0.0, 10.0)] * 6)
    prediction = [F.round(F.col("prediction")[i], 4).alias(f"p{i}") for i in range(6)]
    zeros = [F.lit(0.0).alias(f"p{i}") for i in range(6)]
    return scored.select("name", F.lit("accepted").alias("verdict"), *prediction).unionByName(
        rejected.select("name", F.col("reason").alias("verdict"), *zeros)
    )


def _graph_roundtrip(spark, sf_dir):
    """A graph network trained for an epoch, saved with its optimizer state, loaded and trained for another: predictions of both on the test graphs."""
    from strucreg.catalog import fits

    rows = fits.small_graphs(spark, sf_dir).withColumn("split", split.holdout(F.col("idx"))).persist()
    learn = rows.filter("split = 'train'").withColumn("watch", split.validation_part(F.col("idx")))
    shape = gcn.Shape(len(rows.first()["x"]) // len(rows.first()["node_ids"]), len(Y), 6, 2, "tanh")
    path = scratch_path(spark, "graph")
    half = artifacts.Checkpoints(spark, f"{path}/epochs")
    # the run that is not stopped hangs on no other, and a run has few tasks: both go on side by side
    pool = ThreadPoolExecutor(1)
    unstopped = pool.submit(lambda: gcn.fit(learn, ("idx", "part"), shape, "Adam", 1e-2, 1e-5, epochs=2))
    pool.shutdown(wait=False)
    gcn.fit(learn, ("idx", "part"), shape, "Adam", 1e-2, 1e-5, epochs=1, checkpoints=half)
    _, states = half.latest()
    now = states[0]
    slots = [now[f"slot{i}"] for i in range(2)]
    artifacts.save_network(spark, network.named_weights(shape, now["weights"], slots), {**vars(shape), "step": int(now["facts"][0])}, path + "/network")
    stored, info = artifacts.load_network(spark, path + "/network")
    shape_back = gcn.Shape(*(int(info[k]) for k in ("inputs", "outputs", "units", "layers")), info["activation"], float(info["dropout"]))
    weights_back = np.concatenate([np.ravel(w) for kind, w in stored if kind != "slot"])
    slots_back = [w for kind, w in stored if kind == "slot"]
    if not all(np.array_equal(p, q) for p, q in zip(slots, slots_back)) or int(info["step"]) != int(now["facts"][0]):
        raise ValueError("the optimizer state changed on its way")
    resumed = gcn.fit(learn, ("idx", "part"), shape_back, "Adam", 1e-2, 1e-5, epochs=2, checkpoints=half)
    whole = unstopped.result()
    test = rows.filter("split = 'test'")
    weights = [(now["weights"], weights_back), (whole.weights, resumed.weights)]
    told = [[gcn.predict_rows(test, ("idx", "part"), s, w).withColumnRenamed("prediction", n) for s, w, n in ((shape, a, "b"), (shape_back, c, "a"))] for a, c in weights]
    pairs = [before.join(after, ["idx", "part"]) for before, after in told]
    return pairs[0].withColumnsRenamed({"b": "b1", "a": "a1"}).join(pairs[1], ["idx", "part"]).select(F.concat("b1", "b").alias("before"), F.concat("a1", "a").alias("after"))


def model_roundtrip(spark, sf_dir):
    """Largest difference between predictions before saving and after loading, per model kind."""
    table = _plain(spark, sf_dir)
    forest = trees.fit_forest(table.train, "features", Y, table.width, n_estimators=3, max_depth=4)
    path = scratch_path(spark, "forest")
    forest.save(spark, path)
    loaded = trees.TreeModels.load(spark, path)
    both = loaded.predict(forest.predict(table.test, out="before"), out="after")
    boosted = trees.fit_boosted(table.train, "idx", "features", Y, table.width, n_estimators=2, max_depth=3, learning_rate=0.3)
    path = scratch_path(spark, "boosted")
    boosted.save(spark, path)
    again = trees.BoostedModel.load(spark, path)
    both_boosted = again.predict(boosted.predict(table.test, out="before"), out="after")
    shape = network.Shape(table.width, len(Y), 8, 2, "tanh")
    weights = shape.start(7)
    path = scratch_path(spark, "network")
    artifacts.save_network(spark, network.named_weights(shape, weights), vars(shape), path)
    stored, info = artifacts.load_network(spark, path)
    shape_back = network.Shape(int(info["inputs"]), int(info["outputs"]), int(info["units"]), int(info["layers"]), info["activation"])
    weights_back = np.concatenate([np.ravel(w) for _, w in stored])
    x = F.col("features")
    both_network = table.test.select(
        network.predict(x, shape, weights).alias("before"), network.predict(x, shape_back, weights_back).alias("after")
    )
    gap = F.array_max(F.zip_with("before", "after", lambda p, q: F.abs(p - q)))
    frames = [("forest", both), ("boosted", both_boosted), ("network", both_network), ("graph", _graph_roundtrip(spark, sf_dir))]
    parts = [f.agg(F.lit(kind).alias("model"), F.count(F.lit(1)).alias("n"), F.max(gap).alias("gap")) for kind, f in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        ols_structures, ols_fit, ridge_fit, lasso_fit, elastic_net_fit, ols_predict, search_ridge, search_lasso, search_elastic_net, trial_space, best_trial, early_stop, early_stop_delta, decision_tree, random_forest,
        boosted_trees, search_decision_tree, search_random_forest, search_boosted_trees, search_slp, search_mlp, search_gcn, slp_train, slp_predict, mlp_train, mlp_predict, gcn_train, gcn_fit_predict,
        score_graph_batch, model_roundtrip,
    )
}

_SCALED = OBS + f""",
s0 AS (SELECT *, {holdout('idx')} AS split FROM obs),
train AS (SELECT * FROM s0 WHERE split = 'train'),
scaled AS (SELECT idx, """ + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in [*X, *Y]
) + " FROM train)"


def _descent(l1: str, l2: str, sweeps: int) -> str:
    """Cyclic descent on the covariances of the scaled training rows."""
    xx = "[" + ", ".join("[" + ", ".join(f"avg({a} * {c})" for c in X) + "]" for a in X) + "]"
    xy = union_all(f"SELECT '{y}' AS target, [{', '.join(f'avg({x} * {y})' for x in X)}] AS xy FROM scaled" for y in Y)
    rho = "(xy[j] - list_dot_product(xx[j], w) + xx[j][j] * w[j])"
    new = f"sign({rho}) * greatest(abs({rho}) - {l1}, 0) / (xx[j][j] + {l2})"
    replaced = ", ".join(f"CASE WHEN j = {i + 1} THEN new ELSE w[{i + 1}] END" for i in range(6))
    return f"""WITH RECURSIVE {_SCALED},
xx AS MATERIALIZED (SELECT {xx} AS xx, count(*)::DOUBLE AS n FROM scaled),
xy AS MATERIALIZED ({xy}),
descent AS (
  SELECT target, 0 AS step, [0, 0, 0, 0, 0, 0]::DOUBLE[] AS w FROM xy
  UNION ALL
  SELECT target, step + 1, [{replaced}]::DOUBLE[]
  FROM (SELECT target, step, w, j, {new} AS new
        FROM (SELECT d.target, step, w, step % 6 + 1 AS j, xx, xy, n FROM descent d JOIN xy ON d.target = xy.target, xx
              WHERE step < {6 * sweeps})))
SELECT target, unnest({X!r}) AS feature, unnest(list_transform(w, lambda v: {rnd('v', 4)})) AS coefficient
FROM descent WHERE step = {6 * sweeps}"""


def _draw(name: str, spec: tuple, key: str = "trial") -> str:
    u = uniform(key, f"{name}42")
    kind, *v = spec
    if kind == "choice":
        return f"{list(v)!r}[floor({u} * {len(v)})::INT + 1]"
    if kind == "int":
        return f"(floor({u} * {v[1] - v[0] + 1}) + {v[0]})::INT"
    if kind == "log_int":
        span = f"ln({v[0] - 0.5}::DOUBLE) + {u} * (ln({v[1] + 0.5}::DOUBLE) - ln({v[0] - 0.5}::DOUBLE))"
        return f"least(greatest(round(exp({span})), {v[0]}), {v[1]})::INT"
    if kind == "float":
        return f"({u} * ({v[1]} - {v[0]})::DOUBLE + {v[0]}::DOUBLE)"
    return f"exp(ln({v[0]}::DOUBLE) + {u} * (ln({v[1]}::DOUBLE) - ln({v[0]}::DOUBLE)))"


def _early_stop_sql(patience: int, min_delta: float) -> str:
    better = f"(l.loss < s.best_loss - {min_delta}::DOUBLE)"
    return f"""WITH RECURSIVE losses AS (
  SELECT event_id // 100 AS run, (event_id % 100)::INT AS epoch, value AS loss FROM events),
seq AS (SELECT run, epoch, loss, row_number() OVER (PARTITION BY run ORDER BY epoch) AS k FROM losses),
s AS (
  SELECT run, k, epoch AS last_epoch, loss AS best_loss, epoch AS best_epoch, 0 AS waited FROM seq WHERE k = 1
  UNION ALL
  SELECT s.run, l.k, l.epoch, CASE WHEN {better} THEN l.loss ELSE s.best_loss END,
         CASE WHEN {better} THEN l.epoch ELSE s.best_epoch END, CASE WHEN {better} THEN 0 ELSE s.waited + 1 END
  FROM s JOIN seq l ON s.run = l.run AND l.k = s.k + 1 WHERE s.waited < {patience})
SELECT run, max(last_epoch) AS last_epoch, arg_max(best_epoch, k) AS best_epoch,
  {rnd('arg_max(best_loss, k)', 4)} AS best_loss, arg_max(waited, k) >= {patience} AS stopped FROM s GROUP BY run"""


def _score_graph_sql() -> str:
    shape, flat, spreads = _graph_scorer()
    w1, b1, w2, b2, w3, b3 = training.unpack(flat, shape.arrays)
    n = shape.units
    num = lambda v: f"{float(v)!r}::DOUBLE"
    rows = ", ".join("(" + ", ".join([str(bit), *(num(v) for v in w1[6 + bit])]) + ")" for bit in range(256))
    own = ["atomic_num", "valence", "charge", "aromatic", "mass"]
    shared = ", ".join(" + ".join([f"sum(g{j})", *(f"any_value({x}) / {spreads[i]} * {num(w1[i][j])}" for i, x in enumerate(X))]) + f" AS z{j}" for j in range(n))
    first = ", ".join(" + ".join([f"z{j}", *(f"{c} / 10.0 * {num(w1[262 + i][j])}" for i, c in enumerate(own))]) + f" AS h{j}" for j in range(n))

    def spread(source: str, out: str, bias) -> str:
        sums = ", ".join(f"greatest(sum(s.h{j} / sqrt(a.deg + 1) / sqrt(b.deg + 1)) + {num(bias[j])}, 0) AS h{j}" for j in range(n))
        return f"""{out} AS MATERIALIZED (
  SELECT l.name, l.dst AS atom_idx, {sums}
  FROM loops l JOIN {source} s ON l.name = s.name AND l.src = s.atom_idx JOIN degree a ON l.name = a.name AND l.src = a.atom_idx
  JOIN degree b ON l.name = b.name AND l.dst = b.atom_idx GROUP BY l.name, l.dst)"""

    second = ", ".join(" + ".join(f"h{i} * {num(w2[i][j])}" for i in range(n)) + f" AS h{j}" for j in range(n))
    heads = [" + ".join([num(b3[k]), *(f"avg(h{j}) * {num(w3[j][k])}" for j in range(n))]) for k in range(6)]
    good = " AND ".join(f"{x} <> 0" for x in X)
    return f"""WITH {OBS}, {_FINGERPRINT},
prints AS (SELECT DISTINCT name, id % 256 AS bit FROM ids),
bits(bit, {', '.join(f'g{j}' for j in range(n))}) AS (VALUES {rows}),
bad AS (SELECT DISTINCT name FROM feats WHERE valence > usual + shift),
systems AS (SELECT DISTINCT f.idx, f.name, CASE WHEN NOT ({good}) THEN 'missing value' WHEN bad.name IS NOT NULL THEN 'too many bonds' ELSE 'accepted' END AS verdict
  FROM feats f JOIN obs ON f.idx = obs.idx LEFT JOIN bad ON f.name = bad.name),
shared AS (SELECT p.name, {shared} FROM prints p JOIN bits USING (bit) JOIN systems s ON p.name = s.name JOIN obs ON s.idx = obs.idx GROUP BY p.name),
nodes AS (
  SELECT f.name, f.atom_idx, atomic_num, f.valence + h.missing AS valence, charge, aromatic, mass FROM feats f JOIN hyd h ON f.name = h.name AND f.atom_idx = h.parent
  UNION ALL SELECT name, atom_idx, 1, 1, 0, 0, 1.008::DOUBLE FROM hydrogens),
alledges AS (SELECT name, src, dst FROM edges UNION ALL SELECT name, parent, atom_idx FROM hydrogens UNION ALL SELECT name, atom_idx, parent FROM hydrogens),
degree AS MATERIALIZED (SELECT n.name, n.atom_idx, count(e.src) AS deg FROM nodes n LEFT JOIN alledges e ON n.name = e.name AND n.atom_idx = e.dst GROUP BY n.name, n.atom_idx),
loops AS MATERIALIZED (SELECT name, src, dst FROM alledges UNION ALL SELECT name, atom_idx, atom_idx FROM nodes),
h0 AS MATERIALIZED (SELECT n.name, n.atom_idx, {first} FROM nodes n JOIN shared USING (name)),
{spread('h0', 'l1', b1)},
m1 AS (SELECT name, atom_idx, {second} FROM l1),
{spread('m1', 'l2', b2)},
told AS (SELECT name, {', '.join(f'({h}) * 10 AS p{k}' for k, h in enumerate(heads))} FROM l2 GROUP BY name)
SELECT name, verdict, {', '.join(f"CASE WHEN verdict = 'accepted' THEN {rnd(f'p{k}', 4)} ELSE 0.0::DOUBLE END AS p{k}" for k in range(6))}
FROM systems JOIN told USING (name)"""


SQL = {
    "score_graph_batch": _score_graph_sql(),
    "model_roundtrip": f"""WITH {OBS} SELECT model, count(*) FILTER ({holdout('idx')} = 'test') AS n, 0.0::DOUBLE AS gap
FROM obs, (VALUES ('forest'), ('boosted'), ('network'), ('graph')) m(model) GROUP BY model""",
    "ols_fit": _descent("0.0::DOUBLE", "0.0::DOUBLE", 400),
    "ridge_fit": _descent("0.0::DOUBLE", "50.0 / n", 200),
    "lasso_fit": _descent("0.05::DOUBLE", "0.0::DOUBLE", 200),
    "elastic_net_fit": _descent("0.03::DOUBLE", "0.07::DOUBLE", 200),
    "ols_predict": f"""WITH {OBS}, s0 AS (SELECT *, {holdout('idx')} AS split FROM obs),
m AS (SELECT """ + ", ".join(f"regr_slope({y}, x2) AS w_{y}, regr_intercept({y}, x2) AS i_{y}" for y in Y)
    + " FROM s0 WHERE split = 'train') SELECT idx, " + ", ".join(f"{rnd(f'i_{y} + w_{y} * x2', 3)} AS h_{y}" for y in Y)
    + " FROM s0, m WHERE split = 'test'",
    "trial_space": "SELECT c_custkey AS trial, " + ", ".join(
        f"{rnd(_draw(n, s, 'c_custkey')) if s[0] in ('float', 'log_float') else _draw(n, s, 'c_custkey')} AS {n}"
        for n, s in _SPACE.items()
    ) + " FROM customer",
    "best_trial": """WITH t AS (SELECT event_type AS study, event_id AS trial, round(value, 0) AS value, user_id::VARCHAR AS u FROM events)
SELECT study, arg_min(trial, (value, trial)) AS trial, min(value) AS value, arg_min(u, (value, trial)) AS "user" FROM t GROUP BY study""",
    "early_stop": _early_stop_sql(20, 0.0),
    "early_stop_delta": _early_stop_sql(10, 2.0),
}
