"""The feature driver: any of the known features of framed signals, in one table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.functions import arrays as A
from brinewave.operators import framing, kernels, spectral, time_features

#: Frames up to this length get their spectra from column expressions, longer ones from an FFT.
EXPRESSION_LIMIT = 128

#: name -> (what it needs, its parameters)
CATALOG: dict[str, tuple[str, dict]] = {
    **{name: ("frame", {}) for name in time_features.TIME_FEATURES},
    "signal_entropy": ("frame", {"bins": 10}),
    "zero_crossing_rate": ("frame", {}),
    "rms_energy": ("frame", {}),
    **{name: ("spectrum", {}) for name in spectral.SPECTRAL_FEATURES},
    "spectral_bandwidth": ("spectrum", {"p": 2.0}),
    "spectral_rolloff": ("spectrum", {"share": 0.85}),
    "spectral_contrast": ("signal", {"n_bands": 6, "fmin": 200.0}),
    "mfcc": ("signal", {"n_mfcc": 13, "n_mels": 128}),
    "hnr": ("signal", {}),
    "jitter": ("signal", {"f0_min": 75.0, "f0_max": 600.0}),
    "shimmer": ("signal", {}),
}


def catalog(spark: SparkSession) -> DataFrame:
    """(name, needs, parameters) of every feature."""
    rows = [(n, k, ", ".join(f"{a}={b}" for a, b in p.items())) for n, (k, p) in sorted(CATALOG.items())]
    return spark.createDataFrame(rows, "name string, needs string, parameters string")


def magnitudes(framed: DataFrame, n: int, window: str = "hann") -> DataFrame:
    """Frames with ``m``, the magnitudes of their one-sided spectra."""
    if n <= EXPRESSION_LIMIT:
        return framed.withColumn("m", A.magnitude(A.dft(A.windowed(F.col("samples"), window, n, periodic=True), n)))
    weights = np.array(A.window(window, n, periodic=True))
    kinds = [(f.name, f.dataType.simpleString()) for f in framed.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["samples"].to_pylist(), float).reshape(-1, n)
            m = np.abs(np.fft.rfft(x * weights, axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(m), pa.list_(pa.float64()))], [*batch.schema.names, "m"])

    return framed.mapInArrow(run, ", ".join(f"{a} {b}" for a, b in kinds) + ", m array<double>")


def _signal_columns(name: str, params: dict) -> list[str]:
    if name == "mfcc":
        return [f"mfcc_{k}" for k in range(params["n_mfcc"])]
    if name == "spectral_contrast":
        return [*(f"contrast_band_{i}" for i in range(params["n_bands"])), "contrast_delta"]
    return [name]


def _of_signals(long: DataFrame, how: dict[str, dict], sr: float, length: int, hop: int) -> DataFrame:
    """(signal_id, frame, columns) of the features that look at the whole signal, by one pass over each.

    Jitter and shimmer share one search for the pitch, contrast and coefficients one spectrum.
    """

    def rows(x: np.ndarray) -> Iterator[np.ndarray]:
        m = np.abs(kernels.stft(x, length, hop)) if {"spectral_contrast", "mfcc"} & set(how) else None
        f0, voiced, _ = kernels.pyin(x, sr, frame=length, hop=hop) if {"jitter", "shimmer"} & set(how) else (None, None, None)
        for name, params in how.items():
            if name == "hnr":
                yield kernels.hnr(x, length, hop)
            elif name == "spectral_contrast":
                yield from kernels.contrast(m, sr, length, params["n_bands"], params["fmin"]).T
            elif name == "mfcc":
                mels = (m**2) @ filters.T
                db = 10 * np.log10(np.maximum(1e-10, mels))
                yield from (np.maximum(db - db.max(initial=-100.0), -80.0) @ basis.T).T
            elif name == "jitter":
                yield kernels.jitter(f0, voiced, params["f0_min"], params["f0_max"])
            else:
                yield kernels.shimmer(np.sqrt((kernels._frames(x, length, hop) ** 2).mean(axis=1)), voiced)

    if "mfcc" in how:
        mels = how["mfcc"]["n_mels"]
        filters = np.array(spectral.mel_filters(sr, length, mels))
        i, j = np.arange(how["mfcc"]["n_mfcc"])[:, None], np.arange(mels)
        basis = np.sqrt(np.where(i == 0, 1, 2) / mels) * np.cos(np.pi * i * (2 * j + 1) / (2 * mels))
    names = [c for name, params in how.items() for c in _signal_columns(name, params)]

    def run(rows_of: pa.Table) -> pa.Table:
        order = np.argsort(rows_of["n"].to_numpy(), kind="stable")
        found = list(rows(rows_of["value"].to_numpy().astype(float)[order]))
        size = max(map(len, found))
        padded = [pa.array(np.pad(v, (0, size - len(v)), constant_values=np.nan) if len(v) < size else v, from_pandas=True) for v in found]
        ids = rows_of["signal_id"].slice(0, 1)
        return pa.Table.from_arrays([ids.take(pa.array(np.zeros(size, np.int64))), pa.array(np.arange(size)), *padded], ["signal_id", "frame", *names])

    kind = long.schema["signal_id"].dataType.simpleString()
    return long.groupBy("signal_id").applyInArrow(run, f"signal_id {kind}, frame long, " + ", ".join(f"{c} double" for c in names))


def extract(long: DataFrame, names: list[str], sr: float, length: int = 2048, hop: int = 512, center: bool = True, window: str = "hann", params: dict[str, dict] | None = None) -> DataFrame:
    """(signal_id, frame, time_s, features): the features of every frame.

    ``["all"]`` takes every known one in order of name. Frames are made once; those
    features that need a whole signal take it from one group per signal, all together.
    """
    names = sorted(CATALOG) if names == ["all"] else list(dict.fromkeys(names))
    unknown = [n for n in names if n not in CATALOG]
    if unknown:
        raise ValueError(f"unknown features {unknown}; there are {sorted(CATALOG)}")
    how = {n: CATALOG[n][1] | (params or {}).get(n, {}) for n in names}
    if "spectral_bandwidth" in names and "spectral_centroid" not in names:
        names.insert(names.index("spectral_bandwidth"), "spectral_centroid")
    framed = framing.frame_times(framing.frames(long, length, hop, center), sr, length, hop, center)
    if any(CATALOG[n][0] == "spectrum" for n in names):
        framed = magnitudes(framed, length, window)
    f, a = spectral.frequencies(length, sr), F.col("samples")
    columns = []
    for n in names:
        if n == "zero_crossing_rate":
            columns.append(time_features.zero_crossing_rate(F.col("own"), length).alias(n))
        elif n == "rms_energy":
            columns.append(A.rms(a).alias(n))
        elif CATALOG[n][0] == "frame":
            columns.append(time_features.TIME_FEATURES[n](a, **how[n]).alias(n))
        elif CATALOG[n][0] == "spectrum":
            columns.append((spectral.SPECTRAL_FEATURES[n](F.col("m"), f) if n == "spectral_flatness" else spectral.SPECTRAL_FEATURES[n](F.col("m"), f, **how.get(n, {}))).alias(n))
    rows = framed.select("signal_id", "frame", "time_s", *columns)
    whole = {n: how[n] for n in names if CATALOG[n][0] == "signal"}
    return rows.join(_of_signals(long, whole, sr, length, hop), ["signal_id", "frame"], "left") if whole else rows
