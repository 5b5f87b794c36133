"""Early stopping read off a table of losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def early_stop(losses: DataFrame, keys: Sequence[str], patience: int = 20, min_delta: float = 0.0) -> DataFrame:
    """``(keys, last_epoch, best_epoch, best_loss, stopped)`` from ``(keys, epoch, loss)``.

    The rule looks back at the last accepted loss, so a run is folded in epoch order. A run
    has as many rows as its training had epochs (at most a thousand in any configuration).
    """
    start = F.struct(
        F.lit(0).alias("last_epoch"),
        F.lit(0).alias("best_epoch"),
        F.lit(float("inf")).alias("best_loss"),
        F.lit(0).alias("waited"),
    )

    def step(s, e):
        better = e["loss"] < s["best_loss"] - min_delta
        moved = F.struct(
            e["epoch"].alias("last_epoch"),
            F.when(better, e["epoch"]).otherwise(s["best_epoch"]).alias("best_epoch"),
            F.when(better, e["loss"]).otherwise(s["best_loss"]).alias("best_loss"),
            F.when(better, 0).otherwise(s["waited"] + 1).alias("waited"),
        )
        return F.when(s["waited"] >= patience, s).otherwise(moved)

    epochs = F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("loss").cast("double").alias("loss"))))
    folded = losses.groupBy(*keys).agg(epochs.alias("e")).select(*keys, F.aggregate("e", start, step).alias("s"))
    return folded.select(
        *keys, "s.last_epoch", "s.best_epoch", "s.best_loss", (F.col("s.waited") >= patience).alias("stopped")
    )
