"""Structured Streaming twins of the window operators, and a stateful smoother."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from brinewave.operators import time_windows


def events(spark: SparkSession, folder: str, schema: str, time: str, late: str, glob: str = "events.parquet") -> DataFrame:
    """A stream of Parquet files with a watermark on ``time``."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(stream: DataFrame, time: str, keys: list[str], duration: str, value: str, slide: str | None = None) -> DataFrame:
    return time_windows.tumbling(stream, time, keys, duration, value, slide)


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, value: str) -> DataFrame:
    return time_windows.sessions(stream, time, keys, gap, value)


def smoothed(stream: DataFrame, key: str, order: str, value: str, alpha: float = 0.5) -> DataFrame:
    """Exponential smoothing per key with one number of state; a batch's rows are put in order."""

    def step(_: Any, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        y = state.get[0] if state.exists else None
        out = []
        for x in rows[value]:
            y = x if y is None else alpha * x + (1 - alpha) * y
            out.append(y)
        state.update((float(y),))
        yield pd.DataFrame({key: rows[key].to_numpy(), order: rows[order].to_numpy(), "smoothed": out})

    kinds = dict(stream.dtypes)
    chosen = stream.select(key, order, value)
    return chosen.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, smoothed double", "y double", "append", "NoTimeout")


def drain(df: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> StreamingQuery:
    """Run a stream into a table in memory until its input is used up."""
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query
