"""Column expressions over array<double>: sums, moments, spectra, windows.

All work on one row, so a frame's features cost no shuffle; the transform is a
kernel on Arrow batches, the others run in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.22e-16


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where a lambda of ``use`` needs it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def squares(a: Column) -> Column:
    return F.transform(a, lambda x: x * x)


def magnitudes(a: Column) -> Column:
    return F.transform(a, lambda x: F.abs(x))


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def moment(a: Column, m: Column, k: int) -> Column:
    """Mean of (x - m) ** k."""
    return once(m, lambda m: total(F.transform(a, lambda x: F.pow(x - m, F.lit(float(k)))))) / F.size(a)


def rms(a: Column) -> Column:
    return F.sqrt(mean(squares(a)))


def index(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


# -- windows ---------------------------------------------------------------

def window(kind: str, n: int, periodic: bool = False) -> list[float]:
    """Samples of a window; symmetric unless ``periodic``."""
    if kind not in COSINES and kind not in ("boxcar", "rectangular", "bartlett", "triang"):
        raise ValueError(f"unknown window {kind!r}")
    if n <= 1:
        return [1.0] * n
    m = n if periodic else n - 1
    if kind in ("boxcar", "rectangular"):
        return [1.0] * n
    if kind == "bartlett":
        return [1 - abs(2 * i / m - 1) for i in range(n)]
    if kind == "triang":
        size = n + 1 if periodic else n
        half = (size + 1) // 2
        up = [2 * i / (size + 1) if size % 2 else (2 * i - 1) / size for i in range(1, half + 1)]
        return (up + up[::-1][size % 2 :])[:n]
    return [sum((-1) ** j * c * math.cos(2 * math.pi * j * i / m) for j, c in enumerate(COSINES[kind])) for i in range(n)]


# Coefficients of cosine windows.
COSINES = {
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def windowed(a: Column, kind: str, n: int, periodic: bool = False) -> Column:
    return times(a, literal(window(kind, n, periodic)))


# -- spectra ---------------------------------------------------------------

#: Transforms up to this length are direct sums, longer ones an FFT.
DIRECT_LIMIT = 128
#: Rows that are transformed at once.
BLOCK = 1024


def dft(a: Column, n: int, bins: int | None = None) -> Column:
    """array<struct<re, im>> of the first ``bins`` of n; null numbers unless ``a`` has n samples.

    A NumPy kernel on Arrow batches. Direct sums go through all rows and bins of a block
    sample by sample, so that a bin's sum has the order of its samples.
    """
    count = bins or n // 2 + 1

    @F.arrow_udf("array<struct<re:double,im:double>>")
    def transformed(samples: pa.Array) -> pa.Array:
        re, im, known = _sums(*_rows(samples, n), count)
        unknown = np.repeat(~known, count)
        parts = pa.StructArray.from_arrays([pa.array(x.ravel(), mask=unknown) for x in (re, im)], ["re", "im"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(samples) + 1) * count, pa.int32()), parts)

    return transformed(a)


def _rows(samples: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A list array as a matrix of n columns, and which rows have n known samples; the others are zeros."""
    sizes = pc.fill_null(pc.list_value_length(samples), 0).to_numpy()
    flat, first = samples.flatten(), np.cumsum(sizes) - sizes
    known = (sizes == n) & samples.is_valid().to_numpy(zero_copy_only=False)
    x = np.zeros((len(sizes), n))
    at = first[known][:, None] + np.arange(n)
    x[known] = flat.to_numpy(zero_copy_only=False)[at]
    if flat.null_count:
        known[known] = flat.is_valid().to_numpy(zero_copy_only=False)[at].all(axis=1)
        x[~known] = 0.0
    return x, known


def _sums(x: np.ndarray, known: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Real and imaginary parts (rows, count) of the transforms of the rows."""
    n = x.shape[1]
    if n > DIRECT_LIMIT:
        z = np.fft.fft(x, axis=1)[:, np.arange(count) % n]
        return np.ascontiguousarray(z.real), np.ascontiguousarray(z.imag), known
    cos, sin = (np.array([f(2 * math.pi * i / n) for i in range(n)]) for f in (math.cos, math.sin))
    re, im = np.empty((len(x), count)), np.empty((len(x), count))
    for start in range(0, len(x), BLOCK):
        block = np.ascontiguousarray(x[start : start + BLOCK].T)
        sums = np.zeros((2, count, block.shape[1]))
        for i, row in enumerate(block):
            turn = np.arange(count) * i % n
            sums[0] += cos[turn][:, None] * row
            sums[1] += sin[turn][:, None] * row
        re[start : start + BLOCK], im[start : start + BLOCK] = sums[0].T, -sums[1].T
    return re, im, known


def magnitude(spectrum: Column) -> Column:
    return F.transform(spectrum, lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"]))


def power(spectrum: Column) -> Column:
    return F.transform(spectrum, lambda z: z["re"] * z["re"] + z["im"] * z["im"])
