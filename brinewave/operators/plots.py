"""The data of plots as frames: spectrogram, magnitude, phase, waveform, scalogram."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewave.operators import framing, kernels, spectral


def waveform(long: DataFrame, sr: float, most: int | None = None) -> DataFrame:
    """(signal_id, time_s, value), the first ``most`` samples if given."""
    rows = long if most is None else long.filter(F.col("n") < most)
    return rows.select("signal_id", (F.col("n") / float(sr)).alias("time_s"), "value")


def spectrogram(long: DataFrame, sr: float, length: int, hop: int, low: float = 0.0, high: float | None = None) -> DataFrame:
    """(signal_id, frame, frequency, db) of uncentred frames' power densities."""
    framed = framing.frames(long, length, hop, center=False)
    rows = framed.select("signal_id", "frame", F.posexplode(spectral.periodogram(F.col("samples"), length, sr)).alias("k", "p"))
    rows = rows.select("signal_id", "frame", (F.col("k") * (sr / length)).alias("frequency"), (10 * F.log10(F.col("p") + 2.22e-16)).alias("db"))
    return rows.filter((F.col("frequency") >= low) & (F.col("frequency") <= (sr / 2 if high is None else high)))


def colour_limits(spectra: DataFrame) -> DataFrame:
    """(signal_id, low, high): the 5th and 99th percentile of decibels."""
    return spectra.groupBy("signal_id").agg(F.percentile("db", 0.05).alias("low"), F.percentile("db", 0.99).alias("high"))


def unwrapped_phase(bins: DataFrame) -> DataFrame:
    """(signal_id, k, phase): phases of (signal_id, k, re, im) without jumps above pi."""
    w = Window.partitionBy("signal_id").orderBy("k")
    rows = bins.withColumn("_p", F.atan2("im", "re"))
    step = F.col("_p") - F.lag("_p").over(w)
    turn = F.coalesce(-F.round(step / (2 * math.pi)), F.lit(0.0))
    return rows.withColumn("_t", turn).select("signal_id", "k", (F.col("_p") + 2 * math.pi * F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("phase"))


def scalogram(arrays: DataFrame, n: int, scales: int | list[float] = 64) -> DataFrame:
    """(signal_id, scale, n, magnitude) of the continuous wavelet transform of signals of n samples."""
    widths = np.geomspace(1, max(2, n / 8), scales) if isinstance(scales, int) else np.asarray(scales, float)
    rows = kernels.apply(arrays, lambda x: np.abs(kernels.cwt(x, widths)).ravel())
    flat = rows.select("signal_id", F.posexplode("values").alias("_i", "magnitude"))
    table = F.array(*[F.lit(float(w)) for w in widths])
    return flat.select("signal_id", F.element_at(table, (F.floor(F.col("_i") / n) + 1).cast("int")).alias("scale"), (F.col("_i") % n).alias("n"), "magnitude")
