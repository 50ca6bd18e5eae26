"""Spectra and their features; a signal or frame is one row with its samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.functions import arrays as A
from brinewave.functions.arrays import EPS, once, total
from brinewave.operators.kernels import by_length


def spectrum(df: DataFrame, n: int, window: str | None = None, periodic: bool = False, bins: int | None = None) -> DataFrame:
    """``df`` with ``spectrum``, the one-sided transform of its ``samples`` of length n."""
    a = F.col("samples") if window is None else A.windowed(F.col("samples"), window, n, periodic)
    return df.withColumn("spectrum", A.dft(a, n, bins))


def bins(df: DataFrame, n: int, sr: float, *keys: str) -> DataFrame:
    """One row per bin: keys, k, frequency, re, im."""
    rows = df.select(*keys, F.posexplode("spectrum").alias("k", "_z"))
    return rows.select(*keys, "k", (F.col("k") * (sr / n)).alias("frequency"), F.col("_z.re").alias("re"), F.col("_z.im").alias("im"))


def inverse(spectrum: Column, n: int) -> Column:
    """Real samples of a whole (two-sided) transform of length n."""
    cos = A.literal([math.cos(2 * math.pi * i / n) for i in range(n)])
    sin = A.literal([math.sin(2 * math.pi * i / n) for i in range(n)])

    def sample(i: Column) -> Column:
        at = lambda k: ((k * i) % n + 1).cast("int")
        return total(F.zip_with(spectrum, A.index(n), lambda z, k: z["re"] * F.element_at(cos, at(k)) - z["im"] * F.element_at(sin, at(k)))) / n

    return F.transform(A.index(n), sample)


def periodogram(a: Column, n: int, fs: float, window: str = "hann", detrend: bool = True, scaling: str = "density") -> Column:
    """array<double>: one-sided power spectrum of n samples, the inner bins doubled."""
    if scaling not in ("density", "spectrum"):
        raise ValueError("scaling must be 'density' or 'spectrum'")
    w = A.window(window, n, periodic=True)
    scale = 1 / (fs * sum(x * x for x in w)) if scaling == "density" else 1 / sum(w) ** 2
    m = A.mean(a)
    flat = F.transform(a, lambda x: x - m) if detrend else a
    p = A.power(A.dft(A.times(flat, A.literal(w)), n))
    last = n // 2
    twice = lambda k: F.when((k == 0) | ((k == last) & F.lit(n % 2 == 0)), 1.0).otherwise(2.0)
    return F.transform(p, lambda x, k: x * scale * twice(k))


def welch(framed: DataFrame, n: int, fs: float, window: str = "hann", detrend: bool = True, scaling: str = "density") -> DataFrame:
    """(signal_id, k, frequency, psd): the mean of the frames' periodograms."""
    rows = framed.select("signal_id", F.posexplode(periodogram(F.col("samples"), n, fs, window, detrend, scaling)).alias("k", "p"))
    return rows.groupBy("signal_id", "k").agg(F.avg("p").alias("psd")).withColumn("frequency", F.col("k") * (fs / n))


# -- features of a magnitude spectrum m over frequencies f -------------------

def frequencies(n: int, sr: float, bins: int | None = None) -> Column:
    return A.literal([k * sr / n for k in range(bins or n // 2 + 1)])


def centroid(m: Column, f: Column) -> Column:
    s = total(m)
    return F.when(s < EPS, 0.0).otherwise(total(A.times(f, m)) / s)


def bandwidth(m: Column, f: Column, p: float = 2.0) -> Column:
    s, c = total(m), centroid(m, f)
    spread = once(c, lambda c: total(F.zip_with(f, m, lambda x, y: F.pow(F.abs(x - c), F.lit(p)) * y)))
    return F.when(s < EPS, 0.0).otherwise(F.pow(spread / s, F.lit(1 / p)))


def flatness(m: Column) -> Column:
    low = F.exp(A.mean(F.transform(m, lambda x: F.ln(x + EPS))))
    middle = A.mean(m)
    return F.when(middle < EPS, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), low / middle)))


def rolloff(m: Column, f: Column, share: float = 0.85) -> Column:
    """The first frequency below which ``share`` of the power lies; the last one for silence."""
    p = A.squares(m)
    whole = total(p)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))
    goal = whole * share
    step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), (acc["below"] + F.when(acc["sum"] + x < goal, 1).otherwise(0)).alias("below"))
    at = F.least(F.aggregate(p, start, step, lambda acc: acc["below"]) + 1, F.size(f))
    return F.when(whole < EPS, F.element_at(f, -1)).otherwise(F.element_at(f, at))


def dominant(m: Column, f: Column) -> Column:
    """The frequency of the first largest magnitude."""
    return F.element_at(f, F.array_position(m, F.array_max(m)).cast("int"))


SPECTRAL_FEATURES = {
    "spectral_centroid": centroid,
    "spectral_bandwidth": bandwidth,
    "spectral_flatness": lambda m, f: flatness(m),
    "spectral_rolloff": rolloff,
    "dominant_frequency": dominant,
}


# -- mel and cepstrum ----------------------------------------------------------

def mel(hz: float) -> float:
    """The mel scale that is linear to 1 kHz and logarithmic above."""
    return hz / (200 / 3) if hz < 1000 else 15 + math.log(hz / 1000) / (math.log(6.4) / 27)


def hertz(m: float) -> float:
    return m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * math.log(6.4) / 27)


def mel_filters(sr: float, n: int, n_mels: int) -> list[list[float]]:
    """Triangles of unit area over the bins of an n-point transform."""
    edges = [hertz(mel(sr / 2) * i / (n_mels + 1)) for i in range(n_mels + 2)]
    out = []
    for lo, mid, hi in zip(edges, edges[1:], edges[2:], strict=False):
        out.append([max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo) for f in (k * sr / n for k in range(n // 2 + 1))])
    return out


def mel_power(p: Column, filters: list[list[float]]) -> Column:
    return F.array(*[total(A.times(p, A.literal(row))) for row in filters])


def mfcc(df: DataFrame, n: int, sr: float, n_mels: int = 128, n_mfcc: int = 13, top_db: float = 80.0) -> DataFrame:
    """Frames (signal_id, frame, samples) with ``mfcc``; the reference level is each signal's largest.

    Mel powers and cosine transforms are matrix products over the frames of an Arrow
    batch; between them one shuffle finds the signals' levels. Frames that are null or
    not n samples long give null.
    """
    taper, filters = np.array(A.window("hann", n, periodic=True)), np.array(mel_filters(sr, n, n_mels))
    i, j = np.arange(n_mfcc)[:, None], np.arange(n_mels)
    basis = np.sqrt(np.where(i == 0, 1, 2) / n_mels) * np.cos(np.pi * i * (2 * j + 1) / (2 * n_mels))

    @F.pandas_udf("array<double>")
    def mel_of(samples: pd.Series) -> pd.Series:
        frames = (None if x is None or len(x) != n else x for x in samples)
        return pd.Series(by_length(frames, lambda x: np.abs(np.fft.rfft(x * taper)) ** 2 @ filters.T), dtype=object)

    @F.pandas_udf("array<double>")
    def cosines(mel: pd.Series, top: pd.Series) -> pd.Series:
        floor = 10 * np.log10(np.maximum(1e-10, top.to_numpy(float)))
        level = (None if x is None else np.append(x, f) for x, f in zip(mel, floor, strict=True))
        db = lambda x: np.maximum(10 * np.log10(np.maximum(1e-10, x[:, :-1])) - x[:, -1:], -top_db)
        return pd.Series(by_length(level, lambda x: db(x) @ basis.T), dtype=object)

    framed = df.withColumn("_mel", mel_of("samples"))
    top = framed.groupBy("signal_id").agg(F.max(F.array_max("_mel")).alias("_top"))
    return framed.join(top, "signal_id").withColumn("mfcc", cosines("_mel", "_top")).drop("_mel", "_top")
