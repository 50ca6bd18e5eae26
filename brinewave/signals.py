"""Signals over tables, in two forms.

Long: (signal_id, n, value), one row per sample. Array: (signal_id, samples), one
row per signal of bounded length. Missing samples are null inside the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_from_rows(df: DataFrame, signal: str, order: list[str], value: str) -> DataFrame:
    """Number the rows of each signal by ``order`` (which must be unique in a signal)."""
    w = Window.partitionBy(signal).orderBy(*order)
    n = (F.row_number().over(w) - 1).cast("long")
    return df.select(F.col(signal).alias("signal_id"), n.alias("n"), F.col(value).cast("double").alias("value"))


def long_from_arrays(df: DataFrame, signal: str, samples: str) -> DataFrame:
    rows = df.select(F.col(signal).alias("signal_id"), F.posexplode(samples).alias("n", "value"))
    return rows.select("signal_id", F.col("n").cast("long").alias("n"), F.col("value").cast("double").alias("value"))


def arrays(df: DataFrame, signal: str, samples: str) -> DataFrame:
    """The array form of a table that holds arrays."""
    return df.select(F.col(signal).alias("signal_id"), F.col(samples).cast("array<double>").alias("samples"))


def to_arrays(long: DataFrame) -> DataFrame:
    """Array form of a long form whose signals fit into rows."""
    item = F.sort_array(F.collect_list(F.struct("n", "value")))
    return long.groupBy("signal_id").agg(F.transform(item, lambda x: x["value"]).alias("samples"))


def sampling_rate(df: DataFrame, time: str = "time") -> DataFrame:
    """(signal_id, fs): one over the step of ``time`` if all steps are alike, else 1."""
    w = Window.partitionBy("signal_id").orderBy(time)
    steps = df.select("signal_id", time, (F.col(time) - F.lag(time).over(w)).alias("dt"))
    first = steps.filter("dt is not null").groupBy("signal_id").agg(F.min_by("dt", time).alias("dt0"), F.min("dt").alias("lo"), F.max("dt").alias("hi"))
    limit = 1e-8 + 1e-5 * F.abs("dt0")
    even = (F.abs(F.col("lo") - F.col("dt0")) <= limit) & (F.abs(F.col("hi") - F.col("dt0")) <= limit)
    return first.select("signal_id", F.when(even & (F.col("dt0") > 0), 1 / F.col("dt0")).otherwise(1.0).alias("fs"))


def clean(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value reads as a number."""
    number = F.col(value).cast("string").try_cast("double")
    return df.withColumn(value, number).filter(F.col(value).isNotNull() & ~F.isnan(value))
