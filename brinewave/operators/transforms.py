"""Convolution, correlation, Laplace and Haar transforms as expressions or equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.functions.arrays import total

MODES = ("full", "same", "valid")


def _span(mode: str, n: Column, k: Column) -> tuple[Column, Column]:
    """First index and length of a mode's part of the full result."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    whole = n + k - 1
    if mode == "full":
        return F.lit(0), whole
    if mode == "same":
        return F.floor((k - 1) / 2).cast("int"), n
    return F.least(n, k) - 1, F.greatest(n, k) - F.least(n, k) + 1


def convolve(a: Column, kernel: Column, mode: str = "same") -> Column:
    """Convolution of two arrays; 'same' has the first one's length."""
    n, k = F.size(a), F.size(kernel)
    first, length = _span(mode, n, k)

    def at(i: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), i - k + 1), F.least(i, n - 1)
        return F.when(lo <= hi, total(F.transform(F.sequence(lo, hi), lambda j: F.element_at(a, j + 1) * F.element_at(kernel, i - j + 1)))).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), length - 1), lambda x: at(x + first))


def correlate(a: Column, b: Column, mode: str = "full") -> Column:
    """Cross-correlation: convolution with the reversed second array."""
    return convolve(a, F.reverse(b), mode)


def autocorrelate(a: Column, mode: str = "full") -> Column:
    return correlate(a, a, mode)


def laplace(df: DataFrame, s_values: list[complex], t_step: float = 1.0) -> DataFrame:
    """(signal_id, s_re, s_im, re, im): the sum of x[n] exp(-s n dt) dt for each s."""
    points = F.array(*[F.struct(F.lit(float(complex(s).real)).alias("s_re"), F.lit(float(complex(s).imag)).alias("s_im")) for s in s_values])
    rows = df.select("signal_id", "samples", F.explode(points).alias("s"))
    part = lambda f: total(F.transform("samples", lambda x, n: x * F.exp(-F.col("s.s_re") * n * t_step) * f(F.col("s.s_im") * n * t_step) * t_step))
    return rows.select("signal_id", "s.s_re", "s.s_im", part(F.cos).alias("re"), (-part(F.sin)).alias("im"))


def haar(a: Column) -> Column:
    """struct<approximation, detail> of one level; an odd array repeats its last sample."""
    even = F.when(F.size(a) % 2 == 1, F.concat(a, F.slice(a, -1, 1))).otherwise(a)
    half = F.sequence(F.lit(0), (F.size(even) / 2).cast("int") - 1)
    pair = lambda sign: F.transform(half, lambda i: (F.element_at(even, 2 * i + 1) + sign * F.element_at(even, 2 * i + 2)) / F.sqrt(F.lit(2.0)))
    return F.struct(pair(1).alias("approximation"), pair(-1).alias("detail"))


def inverse_haar(levels: Column) -> Column:
    a, d = levels["approximation"], levels["detail"]
    up = F.zip_with(a, d, lambda x, y: F.array((x + y) / F.sqrt(F.lit(2.0)), (x - y) / F.sqrt(F.lit(2.0))))
    return F.flatten(up)


def exponential_smoothing(a: Column, alpha: float = 0.5) -> Column:
    """y[0] = x[0], y[n] = alpha x[n] + (1 - alpha) y[n - 1]."""
    start = F.slice(a, 1, 1)
    step = lambda acc, x: F.concat(acc, F.array(alpha * x + (1 - alpha) * F.element_at(acc, -1)))
    return F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), start, step)
