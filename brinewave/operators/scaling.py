"""Scalers: one pass of statistics, kept as a table of one row per column, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("standard", "minmax", "robust")


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ("time",)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def fit(df: DataFrame, columns: list[str], kind: str = "standard", quantiles: tuple[float, float] = (25.0, 75.0)) -> DataFrame:
    """One row: for each column its <c>_shift and <c>_scale; a scale of zero counts as one."""
    if kind not in KINDS:
        raise ValueError(f"scaler must be one of {KINDS}")
    low, high = (q / 100 for q in quantiles)
    out = []
    for c in columns:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        shift, scale = {
            "standard": (F.avg(x), F.stddev_pop(x)),
            "minmax": (F.min(x), F.max(x) - F.min(x)),
            "robust": (F.percentile(x, 0.5), F.percentile(x, high) - F.percentile(x, low)),
        }[kind]
        out += [shift.alias(f"{c}_shift"), F.when(scale == 0, 1.0).otherwise(scale).alias(f"{c}_scale")]
    return df.agg(*out)


def apply(df: DataFrame, params: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0, kind: str = "standard") -> DataFrame:
    """Scale with fitted parameters, a table of one row."""
    met = df.join(F.broadcast(params))
    for c in columns:
        unit = (F.col(c) - F.col(f"{c}_shift")) / F.col(f"{c}_scale")
        met = met.withColumn(c, unit * (high - low) + low if kind == "minmax" else unit)
    return met.drop(*params.columns)


def scale(df: DataFrame, kind: str = "standard", columns: list[str] | None = None, **how) -> DataFrame:
    columns = columns or numeric_columns(df)
    span = how.pop("feature_range", (0.0, 1.0))
    return apply(df, fit(df, columns, kind, **how), columns, *span, kind=kind)
