"""Windows over event time; the same functions serve batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, keys: list[str], duration: str, value: str, slide: str | None = None) -> DataFrame:
    """(keys, start, n, total, mean, high) of windows of ``duration``, sliding if ``slide`` is given."""
    w = F.window(F.col(time).cast("timestamp"), duration, slide) if slide else F.window(F.col(time).cast("timestamp"), duration)
    rows = df.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    return rows.select(*keys, F.col("w.start").alias("start"), "n", "total", "mean", "high")


def sessions(df: DataFrame, time: str, keys: list[str], gap: str, value: str) -> DataFrame:
    """(keys, start, end, n, total) of runs of events no further apart than ``gap``."""
    rows = df.groupBy(*keys, F.session_window(F.col(time).cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")
