"""Effects on long signals (signal_id, n, value), as column expressions and windows; echoes run along sorted rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _within(name: str, x: float, lo: float, hi: float, open_top: bool = False) -> None:
    if not (lo <= x < hi if open_top else lo <= x <= hi):
        raise ValueError(f"{name} must lie between {lo} and {hi}")


def gain(df: DataFrame, db: float) -> DataFrame:
    return df.withColumn("value", F.col("value") * 10 ** (db / 20))


def compress(df: DataFrame, threshold: float = 0.8, ratio: float = 4.0) -> DataFrame:
    """What exceeds the threshold is divided by the ratio; hard knee."""
    _within("threshold", threshold, 0, 1)
    if ratio < 1:
        raise ValueError("ratio must be at least 1")
    over = F.signum(F.col("value")) * (threshold + (F.abs(F.col("value")) - threshold) / ratio)
    return df.withColumn("value", F.when(F.abs(F.col("value")) > threshold, over).otherwise(F.col("value")))


def lfo(shape: str, rate: float, sr: float) -> Column:
    """Oscillation in -1..1 at sample n."""
    t = F.col("n") / F.lit(float(sr)) * rate
    if shape == "sine":
        return F.sin(2 * math.pi * t)
    phase = t - F.floor(t)
    if shape == "triangle":
        return F.when(phase < 0.5, 4 * phase - 1).otherwise(3 - 4 * phase)
    if shape == "square":
        return F.signum(F.sin(2 * math.pi * t))
    raise ValueError(f"unknown shape {shape!r}")


def tremolo(df: DataFrame, sr: float, rate: float = 5.0, depth: float = 0.5, shape: str = "sine") -> DataFrame:
    _within("depth", depth, 0, 1)
    return df.withColumn("value", F.col("value") * ((1 - depth) + depth * lfo(shape, rate, sr)))


def comb(df: DataFrame, lag: int, feedback: float, wet: float, dry: float) -> DataFrame:
    """out[n] = dry x[n] + wet w[n - lag], w[n] = x[n] + feedback w[n - lag].

    Samples of one residue modulo the lag form a chain of their own. Chains are dealt
    to partitions and sorted, and a task runs along its rows with one number, so that
    no echo is dropped, whatever the feedback, no chain needs to fit into memory and
    the time is that of the rows. Missing samples (or rows) give no echo and damp.
    """
    value = F.col("value").cast("double")
    if lag <= 0:
        return df.withColumn("value", (dry + wet) * value)
    import pyarrow as pa

    feedback, wet, dry = float(feedback), float(wet), float(dry)
    columns = [f"`{f.name}` {'double' if f.name == 'value' else f.dataType.simpleString()}" for f in df.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, state = (None, None), 0, 0.0
        for batch in batches:
            out = []
            for key, chain, link, x in zip(*(batch[c].to_pylist() for c in ("signal_id", "_chain", "_link", "value")), strict=True):
                if (key, chain) != at and not (key != key and at[0] != at[0] and chain == at[1]):
                    at, last, state = (key, chain), link, 0.0
                # rows of a null signal are no signal
                echo = 0.0 if key is None else state * feedback ** (link - last - 1) if link > last else 0.0
                out.append(None if x is None else dry * x + wet * echo)
                last, state = link, (x or 0.0) + feedback * echo
            kept = [pa.array(out, pa.float64()) if f == "value" else batch[f] for f in names]
            yield pa.RecordBatch.from_arrays(kept, names)

    names = df.columns
    rows = df.withColumns({"value": value, "_chain": F.pmod("n", F.lit(lag)), "_link": F.floor(F.col("n") / lag)})
    return rows.repartition("signal_id", "_chain").sortWithinPartitions("signal_id", "_chain", "_link").mapInArrow(run, ", ".join(columns))


def delay(df: DataFrame, sr: float, delay_time: float = 0.5, feedback: float = 0.4, wet: float = 0.5, dry: float = 1.0) -> DataFrame:
    _within("feedback", feedback, 0, 1, open_top=True)
    _within("wet", wet, 0, 1)
    _within("dry", dry, 0, 1)
    return comb(df, int(delay_time * sr), feedback, wet, dry)


def _modulated(df: DataFrame, sr: float, rate: float, depth: float, base: float, feedback: float, wet: float, dry: float, shape: str) -> DataFrame:
    """Delay by base + depth * lfo, linearly interpolated between samples; the echo is of the input."""
    shift = (F.lit(base) + depth * lfo(shape, rate, sr)) * sr
    rows = df.withColumn("_at", F.col("n") - F.greatest(F.lit(0.0), shift)).withColumn("_lo", F.floor("_at"))
    most = math.ceil((base + depth) * sr) + 2
    w = Window.partitionBy("signal_id").orderBy("n").rowsBetween(-most, 0)
    past = F.collect_list("value").over(w)
    back = lambda i: F.try_element_at(F.reverse(past), (F.col("n") - i + 1).cast("int"))
    part = F.col("_at") - F.col("_lo")
    echo = F.coalesce(back(F.col("_lo")), F.lit(0.0)) * (1 - part) + F.coalesce(F.when(part > 0, back(F.col("_lo") + 1)), F.lit(0.0)) * part
    return rows.withColumn("value", dry * F.col("value") + wet * (1 + feedback) * echo).drop("_at", "_lo")


def chorus(df: DataFrame, sr: float, rate: float = 1.5, depth: float = 0.002, delay: float = 0.025, feedback: float = 0.2, wet: float = 0.5, dry: float = 1.0, shape: str = "sine", mode: str = "compat") -> DataFrame:
    """``compat``: a fixed delay of the buffer's length, as results to match have it; ``modulated``: a moving one."""
    if mode == "modulated":
        return _modulated(df, sr, rate, depth, delay, feedback, wet, dry, shape)
    return comb(df, math.ceil((delay + depth) * sr) + 2, feedback, wet, dry)


def flanger(df: DataFrame, sr: float, rate: float = 0.5, depth: float = 0.0005, delay: float = 0.001, feedback: float = 0.5, wet: float = 0.5, dry: float = 0.5, shape: str = "sine", mode: str = "compat") -> DataFrame:
    if depth >= delay:
        raise ValueError("depth must be below delay")
    if not -1 <= feedback < 1:
        raise ValueError("feedback must lie in [-1, 1)")
    return chorus(df, sr, rate, depth, delay, feedback, wet, dry, shape, mode)


def reverb(arrays: DataFrame, response: list[float], wet: float = 0.3, dry: float = 0.7) -> DataFrame:
    """Full convolution with an impulse response, longer than the signal by its length less one."""
    from brinewave.functions.arrays import literal
    from brinewave.operators.transforms import convolve

    _within("wet", wet, 0, 1)
    echo = convolve(F.col("samples"), literal(response), "full")
    padded = F.concat("samples", F.array_repeat(F.lit(0.0), len(response) - 1))
    return arrays.withColumn("samples", F.zip_with(padded, echo, lambda x, e: dry * x + wet * e))


def impulse_response(sr: float, decay_time: float = 0.5, seed: int | None = None) -> list[float]:
    """Exponentially decaying seeded noise, its peak 1."""
    import numpy as np

    n = max(1, int(sr * decay_time * 1.5))
    t = np.arange(n) / sr
    r = np.random.default_rng(seed).standard_normal(n) * np.exp(-t / decay_time * math.log(1000))
    return (r / max(np.abs(r).max(), 2.22e-16)).tolist()


def widen(df: DataFrame, width: float = 1.5) -> DataFrame:
    """Mid/side widening of (left, right)."""
    if width < 0:
        raise ValueError("width must not be negative")
    mid, side = (F.col("left") + F.col("right")) / 2, (F.col("left") - F.col("right")) / 2
    return df.withColumns({"left": mid + width * side, "right": mid - width * side})


def equalise(df: DataFrame, bands: dict[float, float], sr: float, q: float = 1.414, mode: str = "compat", kinds: dict[float, str] | None = None) -> DataFrame:
    """Equaliser. ``compat`` leaves the signal as it is, as results to match do.

    ``kinds`` names a band's filter: peak (the default), low_shelf, high_shelf, notch (its gain is not used).
    """
    kinds = kinds or {}
    for f in bands:
        if not 0 < f < sr / 2:
            raise ValueError("band frequencies must lie between 0 and half the sampling rate")
        if kinds.get(f, "peak") not in ("peak", "low_shelf", "high_shelf", "notch"):
            raise ValueError(f"unknown kind of band: {kinds[f]!r}")
    if mode == "compat":
        return df
    from brinewave.operators import kernels as K

    def section(f: float, gain_db: float):
        kind = kinds.get(f, "peak")
        if kind == "notch":
            return K.notch_sos(f, q, sr)
        return K.peaking_sos(f, gain_db, q, sr) if kind == "peak" else K.shelf_sos(f, gain_db, q, sr, kind == "high_shelf")

    return K.sos_filter(df, [section(f, g) for f, g in bands.items()], zero_phase=False)


def clip_pcm(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.least(F.greatest(F.col("value"), F.lit(-1.0)), F.lit(1.0)))


def amplify(df: DataFrame, factor: float = 2.0) -> DataFrame:
    return df.withColumn("value", F.col("value") * factor)


def square(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value") * F.col("value"))
