"""Fits against closed forms, other solvers and plain loops."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from strucreg.operators import gcn, linear, network, optimizers, search, trees
from strucreg.operators.partial_sums import matrix, sum_vectors, vector_rows
from strucreg.operators.stopping import early_stop
from strucreg.operators.training import EarlyStopping, pack, unpack


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = np.column_stack([x @ [1, -2, 0, 0.5] + 0.1 * rng.normal(size=400), np.abs(x[:, 0]) + x[:, 1] * x[:, 2]])
    df = spark.createDataFrame(
        [(i, i % 3, [float(v) for v in a], float(c[0]), float(c[1])) for i, (a, c) in enumerate(zip(x, y))],
        "id long, fold int, features array<double>, y0 double, y1 double",
    ).persist()
    return df, x, y


def test_vectors_add_up_the_same_way_with_and_without_slots(spark, regression):
    df, x, _ = regression

    def task(batches):
        for b in batches:
            yield vector_rows({0: matrix(b.column("features")).sum(axis=0), 1: np.array([float(b.num_rows)])})

    for few in (True, False):
        total = sum_vectors(df.repartition(11).select("features"), task, few)
        assert np.allclose(total[0], x.sum(axis=0)) and total[1].tolist() == [400.0]


def test_linear_family_equals_other_solvers(regression):
    df, x, y = regression
    products = linear.cross_products(df, "features", ["y0", "y1"])[0]
    xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
    assert np.allclose(linear.ols(products).coef, np.linalg.lstsq(xc, yc, rcond=None)[0])
    model = linear.ridge(products, 30.0)
    assert np.allclose(model.coef, np.linalg.solve(xc.T @ xc + 30 * np.eye(4), xc.T @ yc))
    assert np.allclose(products.squared_errors(model), ((x @ model.coef + model.intercept - y) ** 2).mean(axis=0))
    rows = df.select(array_to_vector("features").alias("v"), "y0")
    for alpha, ratio in ((0.2, 1.0), (0.3, 0.4)):
        ours = linear.elastic_net(products, alpha, ratio)
        # the library scales the squared penalty by the deviation of the target
        sd = np.std(y[:, 0], ddof=1)
        l1, l2 = alpha * ratio, alpha * (1 - ratio) * sd
        theirs = LinearRegression(
            featuresCol="v", labelCol="y0", regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2), standardization=False,
            tol=1e-12, maxIter=1000, solver="l-bfgs",
        ).fit(rows)
        assert np.allclose(ours.coef[:, 0], theirs.coefficients.toArray(), atol=1e-4)
        assert abs(ours.intercept[0] - theirs.intercept) < 1e-4


def test_dependent_features_give_the_shortest_solution(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=60)
    x, y = np.column_stack([a, 2 * a, np.zeros(60)]), 3 * a + 1
    df = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(x, y)], "features array<double>, y double")
    model = linear.ols(linear.cross_products(df, "features", ["y"])[0])
    assert np.allclose(model.coef[:, 0], np.linalg.pinv(x - x.mean(axis=0)) @ (y - y.mean()), atol=1e-8)


def test_fold_errors_equal_refitting(regression):
    df, x, y = regression
    products = linear.cross_products(df, "features", ["y0", "y1"], F.col("fold"))
    errors = linear.fold_errors(products, "ridge", {"alpha": 5.0})
    fold = np.arange(400) % 3
    for k in range(3):
        xt, yt = x[fold != k], y[fold != k]
        xm, ym = xt.mean(axis=0), yt.mean(axis=0)
        w = np.linalg.solve((xt - xm).T @ (xt - xm) + 5 * np.eye(4), (xt - xm).T @ (yt - ym))
        assert np.isclose(errors[k], np.mean(((x[fold == k] - xm) @ w + ym - y[fold == k]) ** 2))


def test_search_prefers_the_lowest_then_the_earliest(spark, regression):
    df, _, _ = regression
    products = linear.cross_products(df, "features", ["y0", "y1"], F.col("fold"))
    log, best, _ = search.search_linear(spark, products, "ridge", 25)
    rows = log.collect()
    lowest = min(rows, key=lambda r: (r["value"], r["trial"]))
    assert float(lowest["params"]["alpha"]) == best["alpha"] and len(rows) == 25
    tied = search.trial_log(spark, [(3, 1.0, {"a": "x"}), (1, 1.0, {"a": "y"}), (0, 2.0, {"a": "z"})])
    assert search.best_trial(tied).first().asDict() == {"trial": 1, "value": 1.0, "params": {"a": "y"}}


def test_a_diverging_trial_never_wins(spark):
    nan, inf = float("nan"), float("inf")
    log = search.trial_log(spark, [(0, nan, {"a": "x"}), (1, 1.0, {"a": "y"}), (2, 0.5, {"a": "z"}), (3, -inf, {"a": "w"}), (4, inf, {"a": "v"})])
    assert search.winner(log)["trial"] == 2
    assert [r["state"] for r in log.orderBy("trial").collect()] == ["failed", "complete", "complete", "failed", "failed"]
    calls = iter([nan, 3.0])
    log, best = search.search(spark, "ridge", lambda params, fold: next(calls), 2, folds=1, parallel=1)
    assert best == search.random_trials(spark, "ridge", 2)[1] | {} or best["alpha"] == search.random_trials(spark, "ridge", 2)[1]["alpha"]
    with pytest.raises(ValueError, match="finite"):
        search.winner(search.trial_log(spark, [(0, nan, {}), (1, inf, {})]))


def test_descent_says_whether_it_settled(regression):
    df, _, _ = regression
    products = linear.cross_products(df, "features", ["y0", "y1"])[0]
    assert linear.lasso(products, 0.01).converged and not linear.lasso(products, 0.01, max_iter=1, tol=0.0).converged
    assert linear.FAMILIES["elastic_net"](products, {"alpha": 0.001, "l1_ratio": 0.5}).converged


def test_drawn_trials_stay_in_their_space(spark):
    for model, space in search.SPACES.items():
        for trial in search.random_trials(spark, model, 60):
            for name, (kind, *v) in space.items():
                assert trial[name] in v if kind == "choice" else v[0] <= trial[name] <= v[1]
                assert isinstance(trial[name], int) == (kind in ("int", "log_int"))


def _r2(pred, actual):
    return 1 - ((pred - actual) ** 2).sum() / ((actual - actual.mean()) ** 2).sum()


def test_trees_and_boosting_beat_the_mean(spark, regression, tmp_path):
    df, _, y = regression
    for model in (
        trees.fit_forest(df, "features", ["y0", "y1"], 4, single_tree=True, max_depth=5),
        trees.fit_forest(df, "features", ["y0", "y1"], 4, n_estimators=8, max_depth=5, max_features="0.5"),
    ):
        p = np.array([r["prediction"] for r in model.predict(df).orderBy("id").collect()])
        assert all(_r2(p[:, t], y[:, t]) > 0.5 for t in range(2))
    assert trees.min_instances(1, 10) == 5 and trees.min_instances(4, 2) == 4
    assert [trees.feature_subset(m, 10) for m in ("sqrt", "0.5", "1.0")] == ["sqrt", "5", "all"]


def test_boosting_follows_its_formula(spark, regression):
    df, x, y = regression
    model = trees.fit_boosted(df, "id", "features", ["y0", "y1"], 4, n_estimators=5, max_depth=2, learning_rate=0.5, cut_every=2)
    assert np.allclose(model.start, y.mean(axis=0)) and model.trees.targets.tolist() == [0, 1] * 5
    leaves = model.trees.leaves(x)
    current = np.tile(y.mean(axis=0), (400, 1))
    for r in range(5):
        values = np.zeros((400, 2))
        for t in range(2):
            leaf = leaves[:, 2 * r + t]
            for k in np.unique(leaf):
                residual = (y[:, t] - current[:, t])[leaf == k]
                assert np.isclose(model.trees.value[k], residual.sum() / (len(residual) + 1))
                values[leaf == k, t] = model.trees.value[k]
        current = current + 0.5 * values
    predicted = np.array([row["prediction"] for row in model.predict(df).orderBy("id").collect()])
    assert np.allclose(predicted, current) and all(_r2(predicted[:, t], y[:, t]) > 0.2 for t in range(2))


@pytest.mark.parametrize("activation", ["relu", "sigmoid", "tanh", "leaky_relu", "elu", "gelu", "silu", "mish"])
def test_network_gradient(activation):
    rng = np.random.default_rng(0)
    shape = network.Shape(5, 3, 7, 3, activation, 1e-3, 1e-2)
    w = shape.start(1) + rng.normal(0, 0.1, shape.start().size)
    x, y = rng.normal(size=(16, 5)), rng.normal(size=(16, 3))
    _, g = network.gradient(shape, w, x, y)
    for i in range(0, w.size, 7):
        e = 1e-6 * (np.arange(w.size) == i)
        numeric = (network.gradient(shape, w + e, x, y)[0] - network.gradient(shape, w - e, x, y)[0]) / 2e-6
        assert abs(numeric - g[i]) < 1e-7


def test_one_partition_is_plain_mini_batch_descent(spark, regression):
    df, x, y = regression
    shape = network.Shape(4, 2, 6, 2, "tanh", 1e-4, 1e-4)
    fit = network.fit(df, "id", "features", ["y0", "y1"], shape, F.col("fold") == 0, "Adam", 1e-2, epochs=3, partitions=1)
    rule = optimizers.DENSE["Adam"]
    train = np.arange(400) % 3 != 0
    xs, ys = x[train], y[train]
    w, slots, t, history = shape.start(42), optimizers.start_slots(rule, shape.start().size), 0, []
    for epoch in range(1, 4):
        loss = 0.0
        for a in range(0, len(xs), 16):
            part, g = network.gradient(shape, w, xs[a : a + 16], ys[a : a + 16])
            t += 1
            w, slots = rule[1](w, g, slots, t, 1e-2, 0.0)
            loss += part * len(xs[a : a + 16])
        out = network.forward(shape, w, x[~train])[0]
        history.append((epoch, loss / len(xs), float(np.mean((out - y[~train]) ** 2)) + network.penalty(shape, w)))
    assert np.allclose(fit.history, history)
    best = min(h[2] for h in history)
    assert np.isclose(fit.best_loss, best)


def test_network_learns_in_many_partitions_and_predicts(spark, regression):
    df, x, _ = regression
    shape = network.Shape(4, 2, 16, 1, "relu")
    fit = network.fit(df, "id", "features", ["y0", "y1"], shape, F.col("fold") == 0, "Adam", 2e-2, epochs=8, partitions=20)
    assert fit.history[-1][1] < 0.5 * fit.history[0][1]
    predicted = np.array([r[0] for r in df.orderBy("id").select(network.predict(F.col("features"), shape, fit.weights)).collect()])
    assert np.allclose(predicted, network.forward(shape, fit.weights, x)[0])


@pytest.mark.parametrize("flavour,name", [("DENSE", n) for n in optimizers.DENSE] + [("GRAPH", n) for n in optimizers.GRAPH])
def test_every_optimizer_goes_downhill(flavour, name):
    rule = getattr(optimizers, flavour)[name]
    w, slots = np.array([1.0, -2.0, 0.5]), optimizers.start_slots(rule, 3)
    start = float(w @ w)
    for t in range(1, 200):
        w, slots = rule[1](w, 2 * w, slots, t, 1.0 if name == "Adadelta" else 0.01, 0.0)
    assert float(w @ w) < start


def test_early_stopping_keeps_the_best_weights_themselves():
    watch = EarlyStopping(patience=2, min_delta=0.1)
    w = np.zeros(2)
    stops = []
    for epoch, loss in enumerate([1.0, 0.95, 0.5, 0.45, 0.6], start=1):
        w += 1
        stops.append(watch.update(epoch, loss, w))
    assert stops == [False, False, False, False, True]
    assert watch.best_epoch == 3 and watch.best_weights.tolist() == [3.0, 3.0]


def test_early_stop_table_follows_the_same_rule(spark):
    rng = np.random.default_rng(4)
    losses = {run: rng.uniform(size=30).round(2) for run in range(6)}
    df = spark.createDataFrame([(r, e, float(v)) for r, vs in losses.items() for e, v in enumerate(vs)], "run int, epoch int, loss double")
    for patience, delta in ((3, 0.0), (5, 0.2)):
        got = {r["run"]: r for r in early_stop(df.repartition(4), ["run"], patience, delta).collect()}
        for run, values in losses.items():
            watch = EarlyStopping(patience, delta)
            last = next((e for e, v in enumerate(values) if watch.update(e, v, np.zeros(1))), 29)
            assert (got[run]["last_epoch"], got[run]["best_epoch"], got[run]["best_loss"]) == (last, watch.best_epoch, watch.best_loss)


@pytest.fixture(scope="module")
def graphs(spark):
    """Twelve graphs of two to nine nodes with a branching bond pattern."""
    rng = np.random.default_rng(9)
    nodes, edges, targets = [], [], []
    for g in range(12):
        n = 2 + g % 8
        x = rng.normal(size=(n, 3))
        for i in range(n):
            nodes.append((g, i * 3 + 1, [float(v) for v in x[i]]))
        for i in range(1, n):
            a, b = i * 3 + 1, (i // 2) * 3 + 1
            edges += [(g, a, b), (g, b, a)]
        targets.append((g, [float(x.mean()), float(x[:, 0].sum())], g % 4 == 0))
    return (
        spark.createDataFrame(nodes, "g long, atom_idx long, features array<double>").persist(),
        spark.createDataFrame(edges, "g long, src long, dst long").persist(),
        spark.createDataFrame(targets, "g long, y array<double>, watch boolean").persist(),
    )


def test_tables_and_rows_give_the_same_gradient_and_prediction(spark, graphs):
    nodes, edges, targets = graphs
    shape = gcn.Shape(3, 2, 4, 2, "tanh", 0.4)
    weights = shape.start(3)
    rows = gcn.graph_rows(nodes, edges, targets, ["g"], 100)
    large = gcn.large_graphs(nodes, edges, targets, ["g"], 0)
    assert gcn.large_graphs(nodes, edges, targets, ["g"], 100) is None
    loss, n, g = gcn.graph_gradient(large, shape, weights, epoch=5)
    total, expected = 0.0, np.zeros_like(weights)
    for batch in rows.filter(~F.col("watch")).toArrow().to_batches():
        for _, x, src, dst, y, keys in gcn._graphs(batch):
            part, one = gcn.gradient(shape, weights, x, src, dst, y, keys, 5)
            total, expected = total + part, expected + one
    assert n == 9 and np.isclose(loss, total) and np.allclose(g, expected)
    by_row = {r["g"]: r["prediction"] for r in gcn.predict_rows(rows, ["g"], shape, weights).collect()}
    by_table = {r["g"]: r["prediction"] for r in gcn.table_predict(large, shape, weights).collect()}
    assert by_row.keys() == by_table.keys() and all(np.allclose(by_row[k], by_table[k]) for k in by_row)


def test_graph_network_learns_with_and_without_large_graphs(spark, graphs):
    nodes, edges, targets = graphs
    shape = gcn.Shape(3, 2, 8, 2, "tanh")
    for limit in (100, 6):
        rows = gcn.graph_rows(nodes, edges, targets, ["g"], limit)
        large = gcn.large_graphs(nodes, edges, targets, ["g"], limit)
        assert (large is None) == (limit == 100)
        fit = gcn.fit(rows, "g", shape, "Adam", 2e-2, 0.0, epochs=4, partitions=2, large=large)
        assert fit.history[-1][1] < fit.history[0][1]


def test_weights_survive_packing():
    shape = gcn.Shape(3, 2, 4, 2)
    w = shape.start(1)
    assert np.array_equal(pack(unpack(w, shape.arrays)), w)


@pytest.mark.parametrize("family", ["ridge", "lasso", "elastic_net"])
def test_linear_searches_read_structures(spark, sf_dir, monkeypatch, family):
    """The searches run the reference's number of trials on the numbers and the padded coordinates; two trials are enough to see it."""
    from strucreg import catalog

    seen, real = [], search.search_linear

    def few(spark, products, family, n_trials):
        seen.append((family, len(next(iter(products.values())).total) - 1 - 6, n_trials))
        return real(spark, products, family, 2)

    monkeypatch.setattr(search, "search_linear", few)
    rows = catalog.queries()[f"search_{family}"](spark, sf_dir).collect()
    assert len(rows) == 6 and {r["trial"] for r in rows} <= {0, 1}
    assert seen[0][0] == family and seen[0][1] > 6 and seen[0][2] >= 1000
    assert f"search_{family}_numbers" in catalog.oracle_sql()


@pytest.mark.parametrize("shared", [False, True])
def test_many_graphs_at_once_equal_one_by_one(shared):
    """Ids with gaps, graphs of one node without an edge, a batch that is a slice of a longer one."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        ids = np.sort(rng.choice(90, rng.integers(1, 9), replace=False)) * 10**7
        pairs = rng.integers(0, len(ids), (rng.integers(0, 12) if len(ids) > 1 else 0, 2))
        src, dst = ids[np.concatenate([pairs[:, 0], pairs[:, 1]])], ids[np.concatenate([pairs[:, 1], pairs[:, 0]])]
        row = {"node_ids": ids.tolist(), "node_keys": ids.tolist(), "x": rng.normal(size=3 * len(ids)).tolist(), "src": src.tolist(), "dst": dst.tolist(), "y": rng.normal(size=2).tolist()}
        rows.append(row | ({"shared": rng.normal(size=2).tolist()} if shared else {}))
    kinds = {c: pa.list_(pa.float64() if c in ("x", "y", "shared") else pa.int64()) for c in rows[0]}
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items()))).slice(5, 30)
    shape = gcn.Shape(5 if shared else 3, 2, 4, 3, "tanh")
    weights = shape.start(1)
    alone = [gcn.gradient(shape, weights, *g[1:5]) for g in gcn._graphs(batch)]
    loss, slope = gcn.gradient_sums(shape, weights, *gcn.joined_graphs(batch))
    assert np.isclose(loss, sum(a for a, _ in alone)) and np.allclose(slope, sum(b for _, b in alone))
