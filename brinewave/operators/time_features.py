"""Time-domain features of frames, each a column expression over the frame's samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.functions.arrays import EPS, magnitudes, mean, moment, once, rms, total


def mean_amplitude(a: Column) -> Column:
    return F.when(F.size(a) > 0, mean(magnitudes(a))).otherwise(0.0)


def std_dev_amplitude(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sqrt(moment(a, mean(a), 2))).otherwise(0.0)


def skewness(a: Column) -> Column:
    """Bias-corrected; 0 below two samples or without variance."""
    n, m = F.size(a).cast("double"), mean(a)
    var = moment(a, m, 2)
    g = moment(a, m, 3) / F.pow(var, F.lit(1.5))
    return F.when((n < 2) | (var < EPS), 0.0).when(n == 2, 0.0).otherwise(g * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_val(a: Column) -> Column:
    """Bias-corrected excess; 0 below four samples or without variance."""
    n, m = F.size(a).cast("double"), mean(a)
    var = moment(a, m, 2)
    g = moment(a, m, 4) / (var * var) - 3
    return F.when((n < 4) | (var < EPS), 0.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def peak_amplitude(a: Column) -> Column:
    return F.coalesce(F.array_max(magnitudes(a)), F.lit(0.0))


def crest_factor(a: Column) -> Column:
    r = rms(a)
    return F.when((F.size(a) == 0) | (r < EPS), 0.0).otherwise(peak_amplitude(a) / r)


def signal_entropy(a: Column, bins: int = 10) -> Column:
    """Shannon entropy (nats) of a histogram of equal widths; 0 for constant frames."""
    lo, hi = F.array_min(a), F.array_max(a)
    bin_of = once(F.struct(lo.alias("lo"), hi.alias("hi")), lambda r: F.transform(a, lambda x: F.least(F.lit(bins - 1), F.floor((x - r["lo"]) / ((r["hi"] - r["lo"]) / bins)).cast("int"))))
    counts = once(bin_of, lambda own: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(own, lambda x: x == b)) / F.size(a)))
    return F.when((F.size(a) < 2) | (hi - lo < EPS), 0.0).otherwise(-total(F.transform(counts, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(0.0))))


def zero_crossing_rate(own: Column, length: int) -> Column:
    """Sign changes between neighbours of the signal by the frame's length; edges repeat, so they add none."""
    n = F.size(own)
    pairs = F.zip_with(F.slice(own, F.lit(1), n - 1), F.slice(own, F.lit(2), n - 1), lambda x, y: F.when((x < -1e-10) != (y < -1e-10), 1.0).otherwise(0.0))
    return F.when(n > 1, total(pairs)).otherwise(0.0) / length


TIME_FEATURES = {
    "mean_amplitude": mean_amplitude,
    "std_dev_amplitude": std_dev_amplitude,
    "skewness": skewness,
    "kurtosis_val": kurtosis_val,
    "peak_amplitude": peak_amplitude,
    "crest_factor": crest_factor,
    "signal_entropy": signal_entropy,
}


def summary(long: DataFrame, sr: float) -> DataFrame:
    """signal_id, duration_seconds, rms_global, peak_amplitude of whole signals, by partial sums."""
    return long.groupBy("signal_id").agg(
        (F.count("value") / F.lit(float(sr))).alias("duration_seconds"),
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms_global"),
        F.max(F.abs("value")).alias("peak_amplitude"),
    )


def frame_energy(membership: DataFrame, length: int) -> DataFrame:
    """rms_energy, peak_amplitude, mean_amplitude of frames by partial sums, without frame arrays."""
    v = F.col("value")
    return membership.groupBy("signal_id", "frame").agg(
        F.sqrt(F.sum(v * v) / length).alias("rms_energy"),
        F.max(F.abs(v)).alias("peak_amplitude"),
        (F.sum(F.abs(v)) / length).alias("mean_amplitude"),
    )
