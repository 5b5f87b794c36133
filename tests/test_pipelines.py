"""Whole runs from files to metrics, and the catalog on tables with one hot order."""

import shutil

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strucreg.functions import arrays
from strucreg.functions.columns import FEATURES, TARGETS
from strucreg.operators import evaluate, gcn, network, numbering
from strucreg.plans import bindings as b
from strucreg.plans import graphs as graph_plan
from strucreg.plans import scoring, tabular, train
from strucreg.sources import artifacts, structures, tables

N = 90


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A CSV and a folder of XYZ files whose targets follow from the features."""
    folder = tmp_path_factory.mktemp("files")
    rng = np.random.default_rng(11)
    (folder / "xyz").mkdir()
    lines = ["name,mass_au," + ",".join([*FEATURES, *TARGETS])]
    for i in range(N):
        x = rng.normal(size=6) + 3
        n = int(rng.integers(1, 5))
        xyz = rng.normal(size=(n, 3)).round(3)
        y = [x[t] * 2 - x[(t + 1) % 6] + xyz[0, 0] + 5 for t in range(6)]
        lines.append(",".join([f"m{i}", "1.0", *[repr(float(v)) for v in [*x, *y]]]))
        body = "".join(f"C {a} {c} {d}\n" for a, c, d in xyz)
        (folder / "xyz" / f"m{i}.xyz").write_text(f"{n}\n\n{body}")
    (folder / "observations.csv").write_text("\n".join(lines) + "\n")
    return folder


@pytest.fixture(scope="module")
def table(spark, files):
    rows = tables.read_observations(spark, str(files / "observations.csv"))
    atoms, bad = structures.quarantine_structures(structures.read_xyz(spark, str(files / "xyz")))
    assert bad.count() == 0
    coords = arrays.flatten(atoms, ["name"], max_values=216)
    features, length = tabular.structure_features(rows, coords, "name", FEATURES)
    assert length == 12
    return tabular.training_table(features, "name", TARGETS, length=length)


@pytest.mark.parametrize(
    "model,least", [("ridge", 0.99), ("lasso", 0.5), ("elastic_net", 0.3), ("decision_tree", 0.0)]
)
def test_search_from_files_to_metrics(table, model, least):
    log, best, fitted = train.search_model(table, model, n_trials=3 if model == "decision_tree" else 30)
    rows = evaluate.regression_metrics(table.pairs(fitted.predict(table.train))).collect()
    assert len(rows) == 6 and min(r["r2"] for r in rows) > least
    assert min(r["value"] for r in log.collect()) >= 0 and best


def test_pairs_are_on_original_units(spark, table, files):
    fitted = train.fit_model(table, table.train, "ols", {})
    pairs = table.pairs(fitted.predict(table.test)).filter(F.col("target") == TARGETS[0]).collect()
    original = {r["name"]: r[TARGETS[0]] for r in tables.read_observations(spark, str(files / "observations.csv")).collect()}
    assert pairs and all(np.isclose(r["y"], original[r["name"]]) and np.isclose(r["y_hat"], r["y"]) for r in pairs)


def test_networks_and_boosting_by_name(table):
    params = {"optimizer": "Adam", "activation": "tanh", "learning_rate": 1e-2, "units": 16, "l1": 0.0, "l2": 0.0, "layers": 2}
    start = train.scaled_error(table, table.train.withColumn("prediction", F.array_repeat(F.lit(0.0), 6)))
    for model, p in (
        ("mlp", params),
        ("random_forest", {"n_estimators": 5, "max_depth": 4, "min_samples_split": 2, "min_samples_leaf": 1, "max_features": "sqrt"}),
        ("boosted_trees", {"n_estimators": 2, "max_depth": 3, "learning_rate": 0.5, "subsample": 0.9, "colsample_bytree": 0.9, "min_child_weight": 1}),
    ):
        fitted = train.fit_model(table, table.train, model, p, epochs=12)
        assert train.scaled_error(table, fitted.predict(table.train)) < 0.9 * start


def _sdf(i, rng):
    n = 2 + i % 4
    atoms = "".join(f"{rng.normal():10.4f}{0.0:10.4f}{0.0:10.4f} {'CNO'[(i + k) % 3]:<3s} 0  0\n" for k in range(n))
    links = "".join(f"{k:3d}{k + 1:3d}  1  0\n" for k in range(1, n))
    return f"m\n\n\n{n:3d}{n - 1:3d}  0  0\n{atoms}{links}M  END\n$$$$\n"


@pytest.fixture(scope="module")
def graph_table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sdf")
    rng = np.random.default_rng(12)
    rows = []
    for i in range(40):
        (folder / f"m{i}.sdf").write_text(_sdf(i, rng))
        x = rng.normal(size=6) + 2
        rows.append((f"m{i}", *map(float, x), *map(float, x + i % 4)))
    columns = ["name", *FEATURES, *TARGETS]
    obs = spark.createDataFrame(rows, columns).persist()
    molecules = structures.first_record(structures.parse_sdf(structures.read_sdf_records(spark, str(folder)))).persist()
    atoms, bonds = structures.molecule_atoms(molecules).persist(), structures.molecule_bonds(molecules).persist()
    texts = spark.createDataFrame([(f"m{i}", (folder / f"m{i}.sdf").read_text()) for i in range(40)], "name string, text string")
    return obs, atoms, bonds, texts


def test_graph_run_saved_and_scored(spark, graph_table, tmp_path):
    """Trains, saves, loads, and the scoring job repeats the test predictions of the pipeline."""
    obs, atoms, bonds, texts = graph_table
    table = graph_plan.graph_table(obs, "name", FEATURES, TARGETS, atoms, bonds)
    params = {"units": 6, "layers": 2, "activation": "tanh", "dropout": 0.1, "optimizer": "AdamW", "learning_rate": 1e-2, "weight_decay": 1e-6}
    shape, fit = train.fit_graph_model(table, table.training_rows(), params, epochs=3)
    assert table.width == 267 and fit.history[-1][1] < fit.history[0][1]
    artifacts.save_network(spark, network.named_weights(shape, fit.weights, fit.slots), vars(shape), str(tmp_path / "gcn"))
    named, info = artifacts.load_network(spark, str(tmp_path / "gcn"))
    assert int(info["units"]) == 6 and sum(k == "slot" for k, _ in named) == 2
    loaded = train.flat_weights(named)
    expected = {r["name"]: r["prediction"] for part in ("train", "test", "val") for r in table.predict(shape, loaded, part).collect()}
    requests = obs.select("name", *FEATURES).join(texts, "name")
    broken = requests.limit(1).withColumns({"name": F.lit("zero"), FEATURES[2]: F.lit(0.0)}).unionByName(
        requests.limit(1).withColumns({"name": F.lit("garbled"), "text": F.lit("no molecule")})
    )
    scored, rejected = scoring.score_graph_requests(
        requests.unionByName(broken), "name", FEATURES, shape, loaded, table.feature_scaler, list(table.target_scaler.values())
    )
    got = {r["name"]: r["prediction"] for r in scored.collect()}
    assert got.keys() == expected.keys() and all(np.allclose(got[k], expected[k]) for k in got)
    assert {tuple(r) for r in rejected.collect()} == {("zero", "missing value"), ("garbled", "unreadable structure")}


def test_graph_search_and_large_graphs_give_a_trial_log(graph_table):
    obs, atoms, bonds, _ = graph_table
    table = graph_plan.graph_table(obs, "name", FEATURES, TARGETS, atoms, bonds, n_bits=16, max_nodes=11)
    assert table.large is not None
    shape = gcn.Shape(table.width, 6, 5, 2)
    both = table.predict(shape, shape.start(1), "train")
    whole = graph_plan.graph_table(obs, "name", FEATURES, TARGETS, atoms, bonds, n_bits=16)
    expected = {r["name"]: r["prediction"] for r in whole.predict(shape, shape.start(1), "train").collect()}
    got = {r["name"]: r["prediction"] for r in both.collect()}
    assert got.keys() == expected.keys() and all(np.allclose(got[k], expected[k]) for k in got)
    log, best, (shape, fit) = train.search_graph_model(whole, n_trials=2, epochs=2)
    assert log.count() == 2 and shape.units == best["units"] >= 5 and len(fit.history) == 2
    # the large graphs take part in the folds, too
    log, best, (shape, fit) = train.search_graph_model(table, n_trials=1, epochs=1, folds=2)
    assert log.count() == 1 and np.isfinite(log.first()["value"]) and len(fit.history) == 1


@pytest.fixture(scope="module")
def hot_dir(spark, sf_dir, tmp_path_factory):
    """The tables with a third of all line items in one order."""
    folder = tmp_path_factory.mktemp("hot")
    for t in oracle.TABLES:
        if t != "lineitem":
            shutil.copy(f"{sf_dir}/{t}.parquet", folder / f"{t}.parquet")
    items = b.table(spark, sf_dir, "lineitem")
    key = F.when(F.xxhash64("l_partkey", "l_suppkey", "l_shipdate") % 3 == 0, F.lit(7)).otherwise(F.col("l_orderkey"))
    items.withColumn("l_orderkey", key.cast("bigint")).distinct().write.parquet(str(folder / "lineitem_parts"))
    merged = spark.read.parquet(str(folder / "lineitem_parts")).coalesce(1)
    merged.write.parquet(str(folder / "lineitem.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["xyz_parse", "sdf_bonds", "flatten_coordinates", "circular_fingerprint", "gcn_predict", "iqr_counts", "regression_metrics"])
def test_hot_order(spark, hot_dir, monkeypatch, name):
    monkeypatch.setattr(numbering.number_within, "__defaults__", (100,))
    con = oracle.connect(hot_dir)
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{hot_dir}/lineitem.parquet/*.parquet'")
    assert con.execute("SELECT max(c) > 1500 FROM (SELECT count(*) c FROM lineitem GROUP BY l_orderkey)").fetchone()[0]
    assert oracle.differences(entry.queries()[name](spark, hot_dir), con, entry.oracle_sql()[name]) is None


def test_entry_gives_metrics(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and max(r["r2"] for r in rows) > 0.99
