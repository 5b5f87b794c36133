"""The tabular pipeline: structures to features, split, scaling, fit, scores on original units."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strucreg.functions import arrays
from strucreg.operators import scale, split


@dataclass
class TrainingTable:
    """Scaled rows ``key, split, fold, features, targets...`` and the state needed to go back."""

    rows: DataFrame
    key: str
    targets: list[str]
    feature_scaler: tuple[list[float], list[float]]
    target_scaler: dict[str, tuple[float, float]]
    length: int
    rejected: DataFrame  # key and reason of the rows left out

    @property
    def train(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.rows.filter(F.col("split") == "test")

    @property
    def width(self) -> int:
        return len(self.feature_scaler[0])

    def unpersist(self) -> None:
        self.rows.unpersist()

    def pairs(self, predicted: DataFrame, column: str = "prediction") -> DataFrame:
        """``(key, target, y, y_hat)`` on original units from scaled targets and a prediction array."""
        rows = []
        for i, t in enumerate(self.targets):
            mean, sd = self.target_scaler[t]
            rows.append(
                F.struct(
                    F.lit(t).alias("target"),
                    (F.col(t) * sd + mean).alias("y"),
                    (F.col(column)[i] * sd + mean).alias("y_hat"),
                )
            )
        return predicted.select(self.key, F.explode(F.array(*rows)).alias("r")).select(self.key, "r.*")


def structure_features(
    rows: DataFrame, coordinates: DataFrame, key: str, features: Sequence[str], length: int | None = None
) -> tuple[DataFrame, int]:
    """Adds ``features``, the scalar values followed by the zero-padded ``coords`` of ``coordinates``, and ``reason``.

    ``length`` is the padded length; by default the longest structure decides. Rows without a structure, or with one
    longer than a given length, stay with NULL features and the reason; training reports them.
    """
    if length is None:
        length = int(coordinates.agg(F.max(F.size("coords")).alias("m")).first()["m"] or 0)
    scalars = F.array(*[F.col(f).cast("double") for f in features])
    reason = F.when(F.col("coords").isNull(), "missing structure").when(F.size("coords") > length, "structure too long")
    joined = rows.join(coordinates, key, "left").withColumns(
        {"features": F.concat(scalars, arrays.pad(F.col("coords"), length)), "reason": reason}
    )
    return joined.drop("coords"), length


def _finite(value):
    return F.coalesce(F.abs(value.cast("double")) < float("inf"), F.lit(False))


def judged(rows: DataFrame, targets: Sequence[str], features: str = "features") -> DataFrame:
    """Adds ``reason``, NULL for rows that can be trained on. One NaN would spoil the mean and scale of its column for all rows."""
    bad_target = ~_finite(F.col(targets[0]))
    for t in targets[1:]:
        bad_target = bad_target | ~_finite(F.col(t))
    known = F.col("reason") if "reason" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn(
        "reason",
        F.when(known.isNotNull(), known)
        .when(F.col(features).isNull() | F.exists(features, lambda v: ~_finite(v)), "missing or infinite feature")
        .when(bad_target, "missing or infinite target"),
    )


def training_table(
    rows: DataFrame,
    key: str,
    targets: Sequence[str],
    features: str = "features",
    folds: int = 3,
    length: int = 0,
    split_key: str | None = None,
) -> TrainingTable:
    """Splits by ``split_key`` (the key unless rows share their targets with others of that key), fits both scalers on the training
    rows, returns the scaled and persisted table and the rows left out."""
    targets = list(targets)
    all_rows = judged(rows, targets, features)
    by = F.col(split_key or key)
    parts = all_rows.filter(F.col("reason").isNull()).select(
        key,
        split.holdout(by).alias("split"),
        split.kfold(by, folds).alias("fold"),
        F.col(features).alias("features"),
        *targets,
    ).persist()
    train = parts.filter(F.col("split") == "train")
    mean, sd = scale.as_vectors(scale.fit_standard_array(train, "features"))
    y_params = scale.as_params(scale.fit_standard(train, targets))
    scaled = scale.transform(
        parts.withColumn("features", scale.transform_array(F.col("features"), mean, sd)), y_params
    ).persist()
    scaled.count()
    parts.unpersist()
    rejected = all_rows.filter(F.col("reason").isNotNull()).select(key, "reason")
    return TrainingTable(scaled, key, targets, (mean, sd), y_params, length, rejected)
