"""Numbering, quantiles, statistics, scaling and splits against brute force."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from strucreg.functions import arrays
from strucreg.functions.columns import activation, nan_to_null
from strucreg.operators import eda, scale, split
from strucreg.operators.numbering import number_within
from strucreg.operators.quantiles import exact_quantiles
from strucreg.plans import bindings as b


def test_heavy_keys_get_the_same_numbers(spark):
    rows = [(1 if i % 3 else i, (i * 37) % 101, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, v int, id int").repartition(7)

    def numbers(heavy):
        out = number_within(df, ["k"], F.col("v") % 8, ["v", "id"], "n", heavy_rows=heavy)
        return {(r["k"], r["id"]): r["n"] for r in out.collect()}

    plain = numbers(10_000)
    assert numbers(50) == plain == numbers(0)
    expected = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] % 8, r[1], r[2]))):
            expected[k, r[2]] = n
    assert plain == expected


def test_atoms_of_a_heavy_order_split_into_systems(spark, sf_dir):
    light = {tuple(r) for r in b.atoms(spark, sf_dir).collect()}
    heavy = {tuple(r) for r in b.atoms(spark, sf_dir, heavy_rows=3).collect()}
    assert light == heavy


@pytest.mark.parametrize("kind", ["normal", "heavy_tail", "few_values", "hot_value"])
def test_counted_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(size=5000),
        "heavy_tail": np.exp(rng.normal(scale=20, size=3000)),
        "few_values": rng.integers(0, 4, 2000).astype(float),
        "hot_value": np.concatenate([np.full(1500, 7.25), rng.normal(size=2500) * 1e6]),
    }[kind]
    rows = [(float(v), None if i % 5 == 0 else float(-v), None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probabilities = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    counted = exact_quantiles(df, ["a", "b", "c"], probabilities, buffered_rows=10, buckets=16)
    buffered = exact_quantiles(df, ["a", "b", "c"], probabilities)
    assert np.allclose(counted["a"], np.quantile(values, probabilities), rtol=1e-12)
    assert np.allclose(counted["a"], buffered["a"], rtol=1e-12)
    assert np.allclose(counted["b"], buffered["b"], rtol=1e-12)
    assert counted["c"] == buffered["c"] == [None] * 6


def test_boxplot_and_flags_do_not_depend_on_the_quantile_path(spark, sf_dir):
    obs = b.observations_with_gaps(spark, sf_dir).persist()
    columns = ["x1", "x3", "y2", "y4"]
    for make in (eda.boxplot_stats, lambda d, c, **o: eda.flag_counts(eda.iqr_flags(d, ["idx"], c, **o), c)):
        assert sorted(map(tuple, make(obs, columns).collect())) == sorted(map(tuple, make(obs, columns, buffered_rows=5).collect()))


def test_histogram_of_constant_and_plain_columns(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.uniform(-3, 9, 400), 1)
    df = spark.createDataFrame([(float(v), 2.0, None) for v in values], "a double, c double, e double")
    out = eda.histogram(df, ["a", "c", "e"], bins=30).collect()
    for column, data in (("a", values), ("c", np.full(400, 2.0))):
        counts, edges = np.histogram(data, 30)
        got = sorted((r for r in out if r["feature"] == column), key=lambda r: r["bin"])
        assert [r["n"] for r in got] == counts.tolist()
        assert np.allclose([r["lower"] for r in got], edges[:-1])
    assert not [r for r in out if r["feature"] == "e"]


def test_pair_grid_counts(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(300, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double")
    out = eda.pair_grid(df, ["a", "b", "c"], bins=6).collect()
    for i, j in ((0, 1), (0, 2), (1, 2)):
        counts = np.histogram2d(data[:, i], data[:, j], 6)[0]
        got = np.zeros((6, 6))
        for r in out:
            if (r["a"], r["b"]) == ("abc"[i], "abc"[j]):
                got[r["bin_a"], r["bin_b"]] = r["n"]
        assert (got == counts).all()
    assert sum(r["n"] for r in out if r["a"] == r["b"] == "a") == 300


def test_p_values_equal_a_one_feature_regression(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=40), rng.normal(size=40)
    df = spark.createDataFrame([(float(a), float(0.3 * a + c)) for a, c in zip(x, y)], "x double, y double")
    ours = eda.correlation_p_values(eda.correlations(df, ["x"], ["y"])).first()
    rows = df.rdd.map(lambda r: (Vectors.dense(r["x"]), r["y"])).toDF(["features", "label"])
    theirs = LinearRegression(solver="normal").fit(rows).summary
    assert ours["n"] == 40
    assert abs(ours["p"] - theirs.pValues[0]) < 1e-9
    assert abs(ours["t"] - theirs.tValues[0]) < 1e-8


def test_p_value_formulas_meet_where_they_change():
    for t in (0.0, 0.5, 1.96, 3.3, 6.0):
        assert math.isclose(eda.t_test_p(t, 99_999), eda.t_test_p(t, 100_001), rel_tol=2e-4, abs_tol=1e-15)
    assert math.isclose(eda.t_test_p(2.0, 10), 0.0733880347707, rel_tol=1e-9)
    assert eda.t_test_p(float("inf"), 5) == 0.0


def test_missing_values_do_not_count(spark):
    df = nan_to_null(spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (3.0, None), (4.0, 9.0)], "x double, y double"), ["x", "y"])
    row = eda.correlations(df, ["x"], ["y"]).first()
    assert row["n"] == 2 and abs(row["r"] - 1) < 1e-12
    interval = eda.confidence_interval(df, ["x"]).first()
    margin = eda.Z_95 * np.std([1, 3, 4], ddof=1) / math.sqrt(4)
    assert abs(interval["width"] - 2 * margin) < 1e-12


def test_scaling_round_trip_constant_column_and_weights(spark):
    rng = np.random.default_rng(8)
    data = np.column_stack([rng.normal(size=50), np.full(50, 3.0), rng.uniform(size=50)])
    counts = rng.integers(1, 5, 50)
    df = spark.createDataFrame(
        [(*map(float, r), [float(v) for v in r], int(n)) for r, n in zip(data, counts)],
        "a double, b double, c double, v array<double>, n int",
    )
    params = scale.as_params(scale.fit_standard(df, ["a", "b", "c"]))
    assert params["b"] == (3.0, 1.0)
    assert np.allclose(params["a"], (data[:, 0].mean(), data[:, 0].std()))
    back = scale.inverse(scale.transform(df, params), params).select("a", "b", "c").collect()
    assert np.allclose([tuple(r) for r in back], data)
    mean, sd = scale.as_vectors(scale.fit_standard_array(df, "v"))
    assert np.allclose(mean, data.mean(axis=0)) and np.allclose(sd, [data[:, 0].std(), 1, data[:, 2].std()])
    mean, sd = scale.as_vectors(scale.fit_standard_array(df, "v", "n"))
    repeated = np.repeat(data, counts, axis=0)
    assert np.allclose(mean, repeated.mean(axis=0)) and np.allclose(sd, [repeated[:, 0].std(), 1, repeated[:, 2].std()])
    low = scale.as_params(scale.fit_minmax(df, ["a", "b"]))
    assert low["b"] == (3.0, 1.0) and scale.transform(df, low).agg(F.max("a"), F.min("a"), F.max("b")).first()[:3] == (1, 0, 0)


def test_splits_are_complete_and_independent_of_partitioning(spark):
    df = spark.range(20_000).select(
        "id", split.three_way(F.col("id")).alias("s"), split.kfold(F.col("id")).alias("k"), split.holdout(F.col("id")).alias("h")
    )
    rows = {tuple(r) for r in df.collect()}
    assert rows == {tuple(r) for r in df.repartition(13).collect()}
    assert {r[1] for r in rows} == {"train", "val", "test"} and {r[2] for r in rows} == {0, 1, 2}
    assert all((r[1] == "test") == (r[3] == "test") for r in rows)
    assert abs(sum(r[3] == "test" for r in rows) / 20_000 - 0.1) < 0.01


def test_padding_keeps_the_prefix_and_long_structures_are_set_aside(spark):
    atoms = spark.createDataFrame(
        [("a", i, float(i), 0.5, -1.0) for i in range(3)] + [("hot", i, 1.0, 2.0, 3.0) for i in range(40)],
        "name string, atom_idx long, x double, y double, z double",
    ).repartition(5)
    flat = {r["name"]: r["coords"] for r in arrays.flatten(atoms, ["name"], 12).collect()}
    assert flat == {"a": [0.0, 0.5, -1.0, 1.0, 0.5, -1.0, 2.0, 0.5, -1.0]}
    assert [tuple(r) for r in arrays.over_length(atoms, ["name"], 12).collect()] == [("hot", 120)]
    assert arrays.flatten_long(atoms, ["name"]).count() == 129
    padded = spark.createDataFrame([([1.0, 2.0],), ([1.0] * 4,)], "a array<double>").select(arrays.pad(F.col("a"), 3)).collect()
    assert [r[0] for r in padded] == [[1.0, 2.0, 0.0], None]


def test_activations_pass_missing_values_on(spark):
    df = spark.createDataFrame([(None,), (-800.0,), (800.0,)], "x double")
    for name in ("relu", "sigmoid", "tanh", "leaky_relu", "elu", "gelu", "silu", "mish"):
        missing, low, high = (r[0] for r in df.select(activation(name, F.col("x"))).collect())
        assert missing is None and math.isfinite(low) and math.isfinite(high)


def test_quantiles_of_any_doubles_agree_with_the_built_in(spark):
    """Infinities, denormals, huge values, ties: both ways, and a bounded number of passes."""
    inf, tiny = float("inf"), 5e-324
    columns = {
        "a": [-inf, 1.0, 2.0, 3.0, 4.0, inf, None, float("nan")],
        "b": [tiny, 2 * tiny, 3 * tiny, -tiny, 0.0, 1e-310, 1.0, 2.0],
        "c": [1e300, -1e300, 1e-300, 1.7e308, -1.7e308, 0.0, 1.0, 1.0],
        "d": [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0, 1.0, 1.0, 1.0, 1.0],
        "e": [inf] * 8,
        "f": [None] * 8,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    wanted = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    plain = exact_quantiles(df, list(columns), wanted)
    counted = exact_quantiles(df, list(columns), wanted, buffered_rows=0)
    assert repr(plain) == repr(counted)


def test_p_values_have_one_formula():
    """Many and few degrees of freedom meet, also far out in the tail."""
    for t in (1e-6, 0.3, 2.0, 9.0, 30.0):
        below, above = eda.t_test_p(t, 99_999.0), eda.t_test_p(t, 100_001.0)
        assert below > 0 and abs(below / above - 1) < 0.05 * max(1.0, t * t / 100) and abs(eda.t_test_p(t, 1e12) / math.erfc(t / math.sqrt(2)) - 1) < 1e-6
    assert abs(eda.t_test_p(2.0, 10.0) - 0.07338803477074042) < 1e-13 and abs(eda.t_test_p(1.0, 1.0) - 0.5) < 1e-13
