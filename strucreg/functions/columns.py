"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the twelve energy columns and of the six result quantities.
FEATURES = [
    "hf_gibbs_free_energy_ev",
    "hf_electronic_energy_ev",
    "hf_entropy_ev",
    "hf_enthalpy_ev",
    "hf_dipole_moment_d",
    "hf_gap_ev",
]
TARGETS = [
    "dft_gibbs_free_energy_ev",
    "dft_electronic_energy_ev",
    "dft_entropy_ev",
    "dft_enthalpy_ev",
    "dft_dipole_moment_d",
    "dft_gap_ev",
]
RESULT_NAMES = [
    "Gibbs_Energy",
    "Electronic_Energy",
    "Entropy",
    "Enthalpy",
    "Dipole_Moment",
    "Band_Gap",
]
PROPERTY_LABELS = [
    "Gibbs Free Energy (eV)",
    "Electronic Energy (eV)",
    "Entropy (eV)",
    "Enthalpy (eV)",
    "Dipole Moment (D)",
    "Band Gap (eV)",
]

# Fixed value: what counts as a number in text.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
# Texts that mean a missing value.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

_TWO_32 = float(2**32)


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One missing marker: done once at load, so every later aggregate skips it."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def to_numeric(column: str | Column) -> Column:
    """Unparsable text becomes missing. A cast alone would also take type suffixes and hexadecimal forms."""
    c = F.trim(F.col(column) if isinstance(column, str) else column)
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def is_missing(column: str) -> Column:
    return F.col(column).isNull() | F.trim(column).isin(MISSING)


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Unpivot ``columns`` to rows ``(keys, name, value)``, missing values kept."""
    return df.unpivot(list(keys), list(columns), name, value)


def hash32(key: Column, seed: int | str) -> Column:
    """32 bits of a salted digest: the same on every engine, order and partitioning."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint")


def bucket(key: Column, seed: int | str, n: int) -> Column:
    return (hash32(key, seed) % n).cast("int")


def uniform(key: Column, seed: int | str) -> Column:
    """Value in [0, 1) fixed by key and seed."""
    return hash32(key, seed) / F.lit(_TWO_32)


def point_color(index: Column, threshold: int = 48) -> Column:
    return F.when(index < threshold, F.lit("red")).otherwise(F.lit("blue"))


def four_decimals(value: Column) -> Column:
    return F.format_string("%.4f", value)


def all_filled(columns: Sequence[str]) -> Column:
    """Every required number is present and not 0.0."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c) != 0.0, F.lit(False))
    return ok


def _softplus(x: Column) -> Column:
    # log(1 + e^x) without overflow for large x
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _erf(x: Column) -> Column:
    """Error function: its series near 0, the continued fraction of the complement (forward, 60 terms) beyond 2."""
    square = x * x
    series = F.lit(1.0)
    for n in range(40, 0, -1):  # x e^(-x^2) sum (2 x^2)^n / (1 3 5 ...), all terms positive
        series = F.lit(1.0) + F.lit(2.0) * square / F.lit(2.0 * n + 1.0) * series
    near = x * F.exp(-square) * series * (2.0 / math.sqrt(math.pi))
    size = F.greatest(F.abs(x), F.lit(2.5))
    fraction = size
    for n in range(60, 0, -1):
        fraction = size + F.lit(n / 2.0) / fraction
    far = F.signum(x) * (F.lit(1.0) - F.exp(-square) / fraction / math.sqrt(math.pi))
    return F.when(F.abs(x) < 2.5, near).otherwise(far)


def activation(name: str, x: Column, leaky_slope: float = 0.2) -> Column:
    """``leaky_slope`` is 0.2 for the dense networks and 0.01 for the graph network."""
    if name == "relu":
        return F.when(x >= 0, x).when(x < 0, F.lit(0.0))
    if name == "sigmoid":
        return _sigmoid(x)
    if name == "tanh":
        return F.tanh(x)
    if name == "leaky_relu":
        return F.when(x >= 0, x).otherwise(x * leaky_slope)
    if name == "elu":
        return F.when(x >= 0, x).otherwise(F.expm1(x))
    if name == "silu":
        return x * _sigmoid(x)
    if name == "mish":
        return x * F.tanh(_softplus(x))
    if name == "gelu":
        return F.lit(0.5) * x * (F.lit(1.0) + _erf(x / math.sqrt(2.0)))
    if name == "linear":
        return x
    raise ValueError(f"unknown activation: {name}")
