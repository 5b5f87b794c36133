"""Scoring of many requests as one job: validate, parse, pad, scale, predict, scale back."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strucreg.functions import arrays
from strucreg.functions.columns import all_filled, to_numeric
from strucreg.operators import gcn, graph, scale
from strucreg.operators.linear import LinearModel
from strucreg.sources.structures import LINE_END, first_record, molecule_atoms, molecule_bonds, parse_sdf, split_sdf_text


def fold_scaling(
    model: LinearModel, features: tuple[Sequence[float], Sequence[float]], targets: Sequence[tuple[float, float]]
) -> LinearModel:
    """The same model on unscaled features and targets, so that scoring is one product per row."""
    mean, sd = (np.asarray(v, dtype=np.float64) for v in features)
    y_mean, y_sd = (np.array(v, dtype=np.float64) for v in zip(*targets))
    coef = model.coef / sd[:, None]
    return LinearModel(coef * y_sd, (model.intercept - mean @ coef) * y_sd + y_mean)


def request_features(
    requests: DataFrame, key: str, required: Sequence[str], length: int
) -> tuple[DataFrame, DataFrame]:
    """Requests ``(key, numbers..., text)`` to accepted ``(key, features)`` and rejected ``(key, reason)``.

    The structure is parsed inside its row (a request carries one file), nothing is shuffled.
    """
    lines = F.split("text", LINE_END)
    tokens = F.transform(
        F.slice(lines, F.lit(3), F.size(lines)), lambda s: F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " ")
    )
    numbers = F.flatten(
        F.transform(
            F.filter(tokens, lambda t: F.size(t) == 4),
            lambda t: F.transform(F.slice(t, 2, 3), to_numeric),
        )
    )
    # a generator keeps the parse from being repeated per reference
    parsed = requests.select(key, *required, F.inline(F.array(F.struct(numbers.alias("coords")))))
    reason = (
        F.when(~all_filled(required), "missing value")
        .when(F.col("coords").isNull() | (F.size("coords") == 0), "missing structure")
        .when(F.exists("coords", lambda v: v.isNull()), "unreadable structure")
        .when(F.size("coords") > length, "structure too long")
    )
    judged = parsed.withColumn("reason", reason)
    scalars = F.array(*[F.col(c).cast("double") for c in required])
    accepted = judged.filter(F.col("reason").isNull()).select(
        key, F.concat(scalars, arrays.pad(F.col("coords"), length)).alias("features")
    )
    return accepted, judged.filter(F.col("reason").isNotNull()).select(key, "reason")


def score_requests(
    requests: DataFrame,
    key: str,
    required: Sequence[str],
    model: LinearModel,
    feature_scaler: tuple[Sequence[float], Sequence[float]],
    target_scaler: Sequence[tuple[float, float]],
    length: int,
) -> tuple[DataFrame, DataFrame]:
    """``(key, prediction array)`` of the accepted requests and ``(key, reason)`` of the others."""
    accepted, rejected = request_features(requests, key, required, length)
    direct = fold_scaling(model, feature_scaler, target_scaler)
    return accepted.select(key, direct.predict(F.col("features")).alias("prediction")), rejected


def score_graph_requests(
    requests: DataFrame,
    key: str,
    required: Sequence[str],
    shape: gcn.Shape,
    weights: np.ndarray,
    feature_scaler: tuple[Sequence[float], Sequence[float]],
    target_scaler: Sequence[tuple[float, float]],
    n_bits: int = 256,
) -> tuple[DataFrame, DataFrame]:
    """The same for requests ``(key, numbers..., text)`` that carry an SDF file and a graph network.

    The first usable record counts; a record came in one row, so its graph is one row, too. A structure with an impossible
    atom is rejected.
    """
    parsed = parse_sdf(split_sdf_text(requests.select(F.col(key).alias("name"), F.coalesce("text", F.lit("")).alias("text"))))
    molecules = first_record(parsed).persist()
    atoms, bonds = molecule_atoms(molecules), molecule_bonds(molecules)
    bad = graph.invalid_structures(atoms, bonds)
    known = molecules.select("name").join(bad, "name", "left").select(F.col("name").alias(key), F.col("reason").alias("_bad"), F.lit(1).alias("_read"))
    reason = (
        F.when(~all_filled(required), "missing value")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "missing structure")
        .when(F.col("_read").isNull(), "unreadable structure")
        .otherwise(F.col("_bad"))
    )
    judged = requests.join(known, key, "left").withColumn("reason", reason).persist()
    accepted = judged.filter(F.col("reason").isNull()).select(F.col(key).alias("name"), *required)
    atoms = atoms.join(accepted.select("name"), "name", "left_semi")
    bonds = bonds.join(accepted.select("name"), "name", "left_semi")
    prints = graph.circular_fingerprint(atoms, bonds, n_bits=n_bits)
    # both are read several times, and making them is most of the work
    full_atoms, full_bonds = (df.persist() for df in graph.add_hydrogens(atoms, bonds))
    mean, sd = ([float(x) for x in v] for v in feature_scaler)
    own = ["atomic_num", "valence", "charge", "aromatic", "mass"]
    first = len(mean) - len(own)
    nodes = graph.atom_features(full_atoms, full_bonds).select(
        "name", "atom_idx",
        scale.transform_array(F.array(*[F.col(c).cast("double") for c in own]), mean[first:], sd[first:]).alias("features"),
    )
    n = len(required)
    per_graph = accepted.join(prints, "name").select(
        "name",
        F.array_repeat(F.lit(0.0), shape.outputs).alias("y"),
        scale.transform_array(F.array(*[F.col(c).cast("double") for c in required]), mean[:n], sd[:n]).alias("shared"),
        gcn.set_places(F.col("on_bits"), *graph.scaled_bits(mean[n:first], sd[n:first])),
    )
    rows = gcn.graph_rows(nodes, graph.symmetric_edges(full_bonds), per_graph, ["name"], max_nodes=None)
    low, width = (list(v) for v in zip(*target_scaler))
    scored = gcn.predict_rows(rows, ["name"], shape, weights).select(
        F.col("name").alias(key), scale.inverse_array(F.col("prediction"), low, width).alias("prediction")
    )
    return scored, judged.filter(F.col("reason").isNotNull()).select(key, "reason")
