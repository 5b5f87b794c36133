"""Result tables, metrics and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from strucreg.catalog.common import rounded
from strucreg.catalog.sql import ATOMS, OBS, X, Y, rnd, union_all
from strucreg.functions.columns import PROPERTY_LABELS, RESULT_NAMES
from strucreg.operators import evaluate
from strucreg.operators.linear import LinearModel
from strucreg.plans import bindings as b
from strucreg.plans import scoring

HAT = [f"h{i}" for i in range(1, 7)]
# plain formulas stand for a model, so that SQL can say the same
FORMULAS = ["x2 * 0.95", "x2 * 0.99", "x2 / x5 * 1.5", "x1 * 0.05", "x2 / x5 * 0.5", "x6 * 0.02"]


def _predicted(spark, sf_dir):
    obs = b.observations(spark, sf_dir)
    return obs.select("idx", *Y, *[F.expr(f).alias(h) for f, h in zip(FORMULAS, HAT)])


def _pairs(spark, sf_dir):
    return evaluate.long_pairs(_predicted(spark, sf_dir), ["idx"], Y, Y, HAT)


def result_table(spark, sf_dir):
    both = _predicted(spark, sf_dir)
    joined = evaluate.join_predictions(both.select("idx", *Y), both.select("idx", *HAT), "idx")
    out = evaluate.result_table(joined, "idx", Y, HAT)
    return rounded(out, [f"Predicted_{n}" for n in RESULT_NAMES])


def regression_metrics(spark, sf_dir):
    out = evaluate.regression_metrics(_pairs(spark, sf_dir))
    # a target of exactly 0 makes its fraction huge; such a value is shown in thousands
    mape = F.when(F.col("mape") > 1e9, F.round("mape", -4)).otherwise(F.round("mape", 6))
    return rounded(rounded(out.withColumn("mape", mape), ["r2"], 6), ["mse", "rmse", "mae"], 2)


def pooled_mae(spark, sf_dir):
    return rounded(evaluate.pooled_mae(_pairs(spark, sf_dir)), ["mae"], 4)


def scaled_loss(spark, sf_dir):
    """On predictions and actuals cut to a comparable size."""
    small = _pairs(spark, sf_dir).withColumns({c: F.col(c) / 1000000 for c in ("y", "y_hat")})
    return rounded(evaluate.mean_row_loss(small, "idx"), ["loss"], 8)


def score_long(spark, sf_dir):
    """The small shift keeps values off the ties that engines print differently."""
    shown = _predicted(spark, sf_dir).withColumns({h: F.col(h) + 0.000013 for h in HAT})
    return evaluate.score_long(shown, ["idx"], HAT)


SLOTS = 216
# keeps predictions off the ties that engines round differently
OFF_TIES = 0.00000137


def literal_model() -> LinearModel:
    """Weights by rule: small multiples that differ per slot and target."""
    import numpy as np

    coef = np.array([[((i * 7 + j * 3) % 11 - 5) / 100 for j in range(6)] for i in range(6 + SLOTS)])
    return LinearModel(coef, np.array([(j - 2) / 10 for j in range(6)]))


def score_batch(spark, sf_dir):
    """Requests with a zero value are rejected; the others go from structure text to long results."""
    atoms = b.atoms(spark, sf_dir)
    requests = b.observations(spark, sf_dir).select("idx", *X).join(
        b.xyz_text(atoms).withColumn("idx", F.split("name", "_")[1].cast("bigint")), "idx"
    )
    scaler = ([float(i % 5) for i in range(6 + SLOTS)], [float(i % 3 + 10) for i in range(6 + SLOTS)])
    targets = [(j + OFF_TIES, float(j + 1)) for j in range(6)]
    scored, rejected = scoring.score_requests(requests, "name", X, literal_model(), scaler, targets, SLOTS)
    shown = scored.select("name", F.lit(True).alias("accepted"), *[F.round(F.col("prediction")[j], 6).alias(f"p{j}") for j in range(6)])
    none = [F.lit(None).cast("double").alias(f"p{j}") for j in range(6)]
    return shown.unionByName(rejected.select("name", F.lit(False).alias("accepted"), *none))


QUERIES = {
    f.__name__: f
    for f in (result_table, regression_metrics, pooled_mae, scaled_loss, score_long, score_batch)
}

_PRED = OBS + ",\npred AS (SELECT idx, " + ", ".join(Y) + ", " + ", ".join(
    f"{f} AS {h}" for f, h in zip(FORMULAS, HAT)
) + " FROM obs),\npairs AS (" + union_all(
    f"SELECT idx, '{y}' AS target, {y} AS y, {h} AS y_hat FROM pred" for y, h in zip(Y, HAT)
) + ")"


def _score_sql() -> str:
    def slot(i: int) -> str:
        return f"x{i + 1}" if i < 6 else f"coalesce(coords[{i - 5}], 0)"

    def target(j: int) -> str:
        terms = " + ".join(
            f"({slot(i)} - {i % 5}) / {i % 3 + 10}.0::DOUBLE * {((i * 7 + j * 3) % 11 - 5) / 100}::DOUBLE"
            for i in range(6 + SLOTS)
        )
        return f"(({terms} + {(j - 2) / 10}::DOUBLE) * {j + 1} + {j + OFF_TIES}::DOUBLE)"

    good = " AND ".join(f"{x} <> 0" for x in X)
    return f"""WITH {OBS}, {ATOMS},
flat AS (SELECT idx, name, flatten(list([x, y, z] ORDER BY atom_idx)) AS coords FROM atoms GROUP BY idx, name),
raw AS (SELECT flat.name, {good} AS accepted, {', '.join(f'{target(j)} AS r{j}' for j in range(6))} FROM flat JOIN obs ON flat.idx = obs.idx)
SELECT name, accepted, {', '.join(f'CASE WHEN accepted THEN {rnd(f"r{j}", 6)} END AS p{j}' for j in range(6))} FROM raw"""


SQL = {
    "result_table": f"WITH {_PRED} SELECT idx AS Index, " + ", ".join(
        f"{y} AS Actual_{n}, {rnd(h)} AS Predicted_{n}" for y, h, n in zip(Y, HAT, RESULT_NAMES)
    ) + ", CASE WHEN idx < 48 THEN 'red' ELSE 'blue' END AS Color FROM pred",
    "regression_metrics": f"""WITH {_PRED}
SELECT target, {rnd('avg(pow(y - y_hat, 2))', 2)} AS mse, {rnd('sqrt(avg(pow(y - y_hat, 2)))', 2)} AS rmse,
  {rnd('1 - avg(pow(y - y_hat, 2)) / var_pop(y)')} AS r2, {rnd('avg(abs(y - y_hat))', 2)} AS mae,
  CASE WHEN avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16)) > 1e9
    THEN round(avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16)), -4)
    ELSE {rnd('avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16))')} END AS mape FROM pairs GROUP BY target""",
    "pooled_mae": f"WITH {_PRED} SELECT {rnd('avg(abs(y - y_hat))', 4)} AS mae FROM pairs",
    "scaled_loss": f"""WITH {_PRED}, per AS (SELECT idx, avg(pow(y / 1000000 - y_hat / 1000000, 2)) AS loss FROM pairs GROUP BY idx)
SELECT {rnd('avg(loss)', 8)} AS loss FROM per""",
    "score_long": f"WITH {_PRED} " + union_all(
        f"SELECT idx, {i} AS no, '{label}' AS property, printf('%.4f', {h} + 0.000013::DOUBLE) AS prediction FROM pred"
        for i, (h, label) in enumerate(zip(HAT, PROPERTY_LABELS))
    ),
    "score_batch": _score_sql(),
}
