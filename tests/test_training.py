"""Many models in the same jobs, and runs that go on where they were stopped."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strucreg.operators import gcn, network, optimizers, training
from strucreg.plans import tabular, train
from strucreg.sources.artifacts import Checkpoints


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 4))
    y = np.column_stack([x @ [1, -2, 0, 0.5], np.abs(x[:, 0]) + x[:, 1]])
    data = [(i, i % 3, [float(v) for v in a], float(b), float(c)) for i, (a, (b, c)) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, fold int, features array<double>, y0 double, y1 double").persist()


SPECS = {
    k: network.Spec(network.Shape(4, 2, units, layers, "tanh", 1e-4, 1e-4), optimizer, rate, fold)
    for k, (units, layers, optimizer, rate, fold) in enumerate([(5, 1, "Adam", 1e-2, 0), (8, 2, "RMSprop", 1e-3, 1), (3, 1, "SGD", 5e-2, 2), (6, 1, "AdamW", 1e-2, 0)])
}


def _many(rows, specs, epochs=4, **options):
    return network.fit_many(rows, "id", "features", ["y0", "y1"], specs, F.col("fold"), epochs, **options)


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setJobGroup("after", "after")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_models_together_equal_models_alone(spark, rows):
    together = _many(rows, SPECS, partitions=3)
    for k, spec in SPECS.items():
        alone = network.fit(rows, "id", "features", ["y0", "y1"], spec.shape, F.col("fold") == spec.fold, spec.optimizer, spec.learning_rate, 4, partitions=3)
        assert np.allclose(alone.history, together[k].history) and np.allclose(alone.weights, together[k].weights)


def test_jobs_do_not_grow_with_the_models(spark, rows):
    _, few = _jobs(spark, "few", lambda: _many(rows, {0: SPECS[0]}, 3))
    _, more = _jobs(spark, "more", lambda: _many(rows, {k: SPECS[k % 4] for k in range(24)}, 3))
    assert 0 < more <= few


def test_models_take_turns_beyond_the_bound(rows, monkeypatch):
    whole = _many(rows, SPECS)
    monkeypatch.setattr(training, "MAX_SENT_BYTES", 1000)
    turns = _many(rows, SPECS)
    assert all(np.array_equal(whole[k].weights, turns[k].weights) for k in SPECS)


def test_stopped_models_leave(rows):
    # a rate of nothing never gains, so that model stops after its patience
    specs = {**SPECS, 4: network.Spec(SPECS[0].shape, "SGD", 0.0, 0)}
    fits = _many(rows, specs, epochs=6, patience=2)
    lengths = {k: len(f.history) for k, f in fits.items()}
    assert lengths[4] == 3 and max(lengths.values()) == 6 and fits[4].best_epoch == 1
    alone = _many(rows, SPECS, epochs=6, patience=2)
    assert all(np.array_equal(alone[k].weights, fits[k].weights) for k in SPECS)


@pytest.mark.parametrize("epoch", [1, 2, 4])
def test_a_run_goes_on_where_it_was_stopped(spark, rows, tmp_path, monkeypatch, epoch):
    whole = _many(rows, SPECS, 6)
    saved = Checkpoints(spark, str(tmp_path / "run"))
    real = training._epoch

    def stopped(rows, read, models, at, *rest):
        if at > epoch:
            raise RuntimeError("lost the driver")
        return real(rows, read, models, at, *rest)

    monkeypatch.setattr(training, "_epoch", stopped)
    with pytest.raises(RuntimeError):
        _many(rows, SPECS, 6, checkpoints=saved)
    assert saved.epochs() == [epoch]
    # what a writer left half done does not count
    (tmp_path / "run" / "epoch-99").mkdir()
    monkeypatch.setattr(training, "_epoch", real)
    again = _many(rows, SPECS, 6, checkpoints=Checkpoints(spark, str(tmp_path / "run")))
    for k in SPECS:
        assert np.array_equal(whole[k].weights, again[k].weights) and np.allclose(whole[k].history, again[k].history)
        assert all(np.array_equal(a, b) for a, b in zip(whole[k].slots, again[k].slots))


def test_search_of_networks_is_one_run(spark, rows):
    table = tabular.training_table(rows.drop("fold"), "id", ["y0", "y1"])
    (log, best, fitted), jobs = _jobs(spark, "search", lambda: train.search_model(table, "slp", 5, epochs=3))
    assert log.count() == 5 and jobs < 40 and set(best) == {"optimizer", "activation", "learning_rate", "units", "l1", "l2"}
    # each value is the mean over the folds of the error on the fold
    trial = log.orderBy("value").first()
    errors = []
    for k in range(3):
        one = train.fit_model(table, table.train, "slp", best, F.col("fold") == k, 3)
        errors.append(train.scaled_error(table, one.predict(table.train.filter(F.col("fold") == k))))
    assert np.isclose(trial["value"], np.mean(errors))
    assert np.isfinite(train.scaled_error(table, fitted.predict(table.test)))


@pytest.mark.parametrize("optimizer", ["SGD", "Adam"])
def test_a_whole_batch_is_one_step_over_all_tasks(rows, optimizer):
    """No task holds the rows, and the weights are those of plain descent however the rows lie."""
    shape = network.Shape(4, 2, 5, 2, "tanh", 1e-3, 1e-3)
    data = rows.orderBy("id").collect()
    x, y = np.array([r["features"] for r in data]), np.array([[r["y0"], r["y1"]] for r in data])
    learn = np.array([r["fold"] for r in data]) != 0
    rule = optimizers.DENSE[optimizer]
    w, history = shape.start(42), []
    slots = optimizers.start_slots(rule, w.size)
    for epoch in range(1, 4):
        loss, g = network.gradient(shape, w, x[learn], y[learn])
        w, slots = rule[1](w, g, slots, epoch, 0.05, 0.0)
        error = network.forward(shape, w, x[~learn])[0] - y[~learn]
        history.append((epoch, loss, float(np.mean(error**2)) + network.penalty(shape, w)))
    for parts in (1, 23):
        fit = network.fit(rows.repartition(parts), "id", "features", ["y0", "y1"], shape, F.col("fold") == 0, optimizer, 0.05, 3, batch=None)
        assert np.allclose(fit.history, history) and all(np.allclose(a, b) for a, b in zip(fit.slots, slots))


def test_a_large_table_has_more_models(rows, monkeypatch):
    """A model's rows are one task's: their number stays below a bound."""
    assert training.models_for(8_000_000, 504) == training.MODELS == training.models_for(0, 504)
    assert training.models_for(48_000_000, 504) * training.MODEL_BYTES >= 48_000_000 * 504
    monkeypatch.setattr(training, "MODEL_BYTES", 480)
    seen = []
    place = network.training_rows
    monkeypatch.setattr(network, "training_rows", lambda *a: seen.append(place(*a)) or seen[-1])
    _many(rows, SPECS, 1)
    assert seen[0].rdd.getNumPartitions() == 24


@pytest.mark.parametrize("optimizer,activation", [("Adam", "relu"), ("SGD", "mish"), ("RMSprop", "tanh"), ("AdamW", "silu")])
def test_models_of_a_trial_step_side_by_side(optimizer, activation, monkeypatch):
    """The folds of a trial make their steps together, with the same weights as alone; also where a fold's rows come all at once."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(400, 5)), rng.normal(size=(400, 2))
    fold = np.concatenate([rng.integers(0, 3, 300), np.full(100, 1)])
    shape = network.Shape(5, 2, 7, 2, activation, 1e-3, 1e-4)
    rule = optimizers.DENSE[optimizer]
    start = shape.start(3)
    state = (start, optimizers.start_slots(rule, start.size))
    made = []
    whole = network._Stack.gradient
    monkeypatch.setattr(network._Stack, "gradient", lambda self, *rows: made.append(len(self.weights)) or whole(self, *rows))

    def learned(folds, steps):
        learner = network._Learner(shape, rule, 1e-2, 16, [state] * len(folds), steps, 1, True)
        for a in range(0, 400, 100):
            learner.take((x[a : a + 100], y[a : a + 100]), [fold[a : a + 100] == f for f in folds])
        return learner.results()

    together = learned([0, 1, 2], [0, 4, 9])
    assert sum(made) == sum(r[6] for r in together) and len(made) < sum(made) / 2
    for f, s, (weights, slots, *told) in zip(range(3), (0, 4, 9), together):
        ((alone, alone_slots, *alone_told),) = learned([f], [s])
        assert np.array_equal(weights, alone) and all(map(np.array_equal, slots, alone_slots)) and told == alone_told
        learn = fold != f
        w, own, t = start, state[1], s
        for a in range(0, learn.sum(), 16):
            t += 1
            w, own = rule[1](w, network.gradient(shape, w, x[learn][a : a + 16], y[learn][a : a + 16])[1], own, t, 1e-2, 0.0)
        assert np.allclose(w, weights)
    assert np.array_equal(state[0], shape.start(3)) and not any(s.any() for s in state[1])


def test_graphs_of_a_batch_are_made_at_once():
    """A graph's arrays are pieces of the batch's, and its neighbour sum is the one it has alone."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = []
    for n in rng.integers(1, 9, 30).tolist():
        ends = np.stack([np.arange(n - 1), np.arange(1, n)]) * 10
        src, dst = np.hstack([ends, ends[::-1]])
        rows.append({"node_ids": (np.arange(n) * 10).tolist(), "node_keys": list(range(n)), "x": rng.normal(size=3 * n).tolist(), "src": src.tolist(), "dst": dst.tolist(), "y": [1.0, 2.0]})
    kinds = {c: pa.list_(pa.float64() if c in ("x", "y") else pa.int64()) for c in rows[0]}
    batch = pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items()))).slice(3, 20)
    graphs = list(gcn._graphs(batch))
    assert len({id(x.base if x.base.base is None else x.base.base) for _, x, *_ in graphs}) == 1
    told = gcn._spread_graphs(batch)
    assert len(told) == len(graphs) == 20 and gcn._spread_graphs(batch.slice(0, 0)) == []
    for (x, spread, y, keys), (i, own, src, dst, *_) in zip(told, graphs):
        assert np.array_equal(x, own) and np.array_equal(x.ravel(), rows[i + 3]["x"]) and list(keys) == rows[i + 3]["node_keys"]
        assert np.allclose(spread(x), gcn.spreader(len(own), src, dst)(own))
        degree = np.bincount(dst, minlength=len(x)) + 1.0
        matrix = np.diag(1 / degree)
        matrix[dst, src] = 1 / np.sqrt(degree[dst] * degree[src])
        assert np.allclose(spread(x), matrix @ x)
