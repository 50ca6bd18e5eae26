"""Queries over kernels: rows only, their properties are tested in tests/test_kernels.py."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.operators import kernels as K
from brinewave.plans import catalogue as cat


def _kernel(name: str, f: Callable[..., np.ndarray], seeded: bool = False, digits: int = 6, oracle: str | None = None) -> None:
    @cat.query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cat.spread(K.apply(cat.vectors(spark, sf_dir), f, seeded), "values", "value", digits=digits)


for _kind, _cut in (("lowpass", 100.0), ("highpass", 100.0), ("bandpass", [50.0, 200.0]), ("bandstop", [50.0, 200.0])):
    _sos = K.butterworth(_cut, 1000.0, 5, _kind)
    _kernel(f"butter_{_kind}", lambda x, sos=_sos: K.zero_phase(sos, x[None])[0])


@cat.query("filter_response", """select f as frequency, round(-10 * log10(1 + pow(tan(pi() * f / 1000) / tan(pi() * 0.1), 10)), 3) + 0.0 as gain_db from (select unnest(generate_series(0, 99)) * 5.0::double as f)""")
def filter_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    sos = K.butterworth(100.0, 1000.0, 5)
    freqs = np.arange(0, 500, 5.0)
    gain = 20 * np.log10(np.maximum(1e-12, np.abs(K.response(sos, freqs, 1000.0))))
    return spark.createDataFrame([(float(f), round(float(g), 3) + 0.0) for f, g in zip(freqs, gain, strict=True)], "frequency double, gain_db double")


@cat.query("hilbert_envelope", f"""with {cat.E}, {cat.dft_sql()}, t as (select e.signal_id, e.n, k, re, im from (select signal_id, n from e) e join sp using (signal_id)),
    a as (select signal_id, n, sum(case when k in (0, 32) then 1 else 2 end * (re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64))) / 64 as x,
    sum(case when k in (0, 32) then 1 else 2 end * (re * sin(2 * pi() * k * n / 64) + im * cos(2 * pi() * k * n / 64))) / 64 as y from t group by 1, 2)
    select signal_id, n, round(sqrt(x * x + y * y), 5) as value from a""")
def hilbert_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.spread(K.apply(cat.vectors(spark, sf_dir), lambda x: np.abs(K.analytic(x))), "values", "value", digits=5)


@cat.query("hilbert_parts", f"""with {cat.E}, {cat.dft_sql()}, t as (select e.signal_id, e.n, k, re, im from (select signal_id, n from e) e join sp using (signal_id))
    select signal_id, n, round(sum(case when k in (0, 32) then 1 else 2 end * (re * cos(2 * pi() * k * n / 64) - im * sin(2 * pi() * k * n / 64))) / 64, 5) + 0.0 as re,
    round(sum(case when k in (0, 32) then 1 else 2 end * (re * sin(2 * pi() * k * n / 64) + im * cos(2 * pi() * k * n / 64))) / 64, 5) + 0.0 as im from t group by 1, 2""")
def hilbert_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.apply(cat.vectors(spark, sf_dir), lambda x: np.concatenate([K.analytic(x).real, K.analytic(x).imag]))
    both = rows.select("signal_id", F.posexplode(F.arrays_zip(F.slice("values", 1, cat.N).alias("re"), F.slice("values", cat.N + 1, cat.N).alias("im"))).alias("n", "p"))
    return both.select("signal_id", F.col("n").cast("long").alias("n"), cat.r("p.re", 5).alias("re"), cat.r("p.im", 5).alias("im"))


_kernel("dwt_db4", lambda x: np.concatenate(K.wavedec(x, "db4", 2)))
_kernel("idwt_sym5", lambda x: K.waverec(K.wavedec(x, "sym5", 2), "sym5")[: len(x)])
_kernel("cqt", lambda x: K.cqt(x, 1000.0, 32.0, 24, 12, 32).ravel())
_kernel("cwt", lambda x: K.cwt(x, np.geomspace(1, 8, 6)).ravel())
_kernel("f0_yin", lambda x: K.yin(x, 1000.0, 40.0, 400.0, 64, 16))
_kernel("f0_pyin", lambda x: K.pyin(x, 1000.0, 40.0, 400.0, 64, 16)[0])
_kernel("jitter", lambda x: K.jitter(*K.pyin(x, 1000.0, 40.0, 400.0, 64, 16)[:2]))
_kernel("shimmer", oracle=f"""with {cat.E}, g as (select unnest(generate_series(0, 16)) as frame), w as (select signal_id, frame, sqrt(sum(v * v) / 16) as a from e join g on n >= frame * 4 - 8 and n < frame * 4 + 8 group by 1, 2),
    b as (select signal_id, frame, a, lag(a) over (partition by signal_id order by frame) as b from w)
    select signal_id, frame as n, round(coalesce(2 * abs(a - b) / (a + b), 0), 6) + 0.0 as value from b""", f=lambda x: K.shimmer(np.sqrt((K._frames(x, 16, 4) ** 2).mean(axis=1)), np.ones(1 + len(x) // 4, bool)))
_kernel("hnr", lambda x: K.hnr(x, 16, 4))
_kernel("hpss", lambda x: K.transient_shape(x, 0.5, 16, 4))
_kernel("spectral_contrast", lambda x: K.contrast(np.abs(K.stft(x, 64, 16)), 1000.0, 64, 3, 50.0).ravel())
_kernel("onsets", lambda x: K.onsets(x, 1000.0, 16, 4))
_kernel("spectral_denoise", lambda x: K.denoise(x, 1000.0, 0.016, 1.0, 16, 4))
_kernel("add_noise", lambda x, seed: K.add_noise(x, 15.0, seed), seeded=True)
_kernel("pitch_shift", lambda x: K.pitch_shift(x, 2, 12, 16, 4))
_kernel("time_stretch", lambda x: K.time_stretch(x, 1.25, 16, 4))
_kernel("image_cubic", lambda x: K.resize(x.reshape(8, 8), (5, 5), 3).ravel())
_kernel("batch_wavelet", lambda x: np.concatenate(K.wavedec(x)))


@cat.query("batch_fft", f"with {cat.E}, {cat.dft_sql('v * (0.5 - 0.5 * cos(2 * pi() * n / 63))')} select signal_id, k, round(k * 1000.0 / 64, 6) as frequency, round(sqrt(re * re + im * im), 6) as magnitude from sp")
def batch_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cat.spread(K.apply(cat.vectors(spark, sf_dir), lambda x: np.abs(K.fft(x)[:33])), "values", "magnitude").withColumnRenamed("n", "k")
    return rows.withColumn("frequency", cat.r(F.col("k") * 1000.0 / 64))
