"""Segments of signals: fixed lengths, by silence, around events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewave.operators.framing import membership


def fixed_length(long: DataFrame, sr: float, seconds: float, overlap: float = 0.0, pad: bool = True, min_seconds: float | None = None) -> DataFrame:
    """(signal_id, segment_id, start, own, length): one row per segment, ``own`` its real samples.

    With ``pad`` every start below the signal's length gives a segment of ``length``
    samples, else only full ones; ``min_seconds`` looks at the real samples.
    """
    if not 0 <= overlap < 1:
        raise ValueError("overlap must lie in [0, 1)")
    if seconds <= 0:
        raise ValueError("segments must have a positive length")
    length = int(seconds * sr)
    count = long.groupBy("signal_id").agg(F.count("*").alias("c"))
    if length == 0:
        return count.select("signal_id", *[F.lit(0).cast("long").alias(x) for x in ("segment_id", "start", "own", "length")]).limit(0)
    hop = max(1, int(length * (1 - overlap)))
    starts = count.select("signal_id", "c", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1, F.lit(hop).cast("long"))).alias("segment_id", "start"))
    rows = starts.withColumn("own", F.least(F.lit(length).cast("long"), F.col("c") - F.col("start"))).withColumn("length", F.lit(length).cast("long"))
    if not pad:
        rows = rows.filter(F.col("own") == length)
    if min_seconds is not None:
        rows = rows.filter(F.col("own") >= int(min_seconds * sr))
    return rows.select("signal_id", F.col("segment_id").cast("long").alias("segment_id"), "start", "own", "length")


def fixed_samples(long: DataFrame, sr: float, seconds: float, overlap: float = 0.0, pad: bool = True, min_seconds: float | None = None) -> DataFrame:
    """(signal_id, segment_id, pos, value) of fixed-length segments, zeros where the signal has ended."""
    rows = fixed_length(long, sr, seconds, overlap, pad, min_seconds)
    spread = rows.select("signal_id", "segment_id", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("pos"))
    spread = spread.withColumn("n", F.col("start") + F.col("pos"))
    met = spread.join(long, ["signal_id", "n"], "left")
    return met.select("signal_id", "segment_id", "pos", F.coalesce("value", F.lit(0.0)).alias("value"))


def merge_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Union of (start, end) intervals by key where the next starts before the current end."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)
    rows = df.withColumn("_new", fresh).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def islands(df: DataFrame, keys: list[str], position: str, flag: str) -> DataFrame:
    """(keys, flag, first, last + 1) of runs of equal flags."""
    rank = F.row_number().over(Window.partitionBy(*keys, flag).orderBy(position))
    rows = df.withColumn("_run", F.col(position) - rank)
    return rows.groupBy(*keys, flag, "_run").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end")).drop("_run")


def by_silence(long: DataFrame, sr: float, threshold_db: float = -40.0, min_silence: float = 0.1, min_segment: float = 0.2, padding: float = 0.05, frame: int = 512, hop: int | None = None) -> DataFrame:
    """(signal_id, segment_id, start, end) between silences of at least ``min_silence`` seconds."""
    if threshold_db > 0:
        raise ValueError("the threshold must not be positive")
    if min(min_silence, min_segment, padding) < 0:
        raise ValueError("durations must not be negative")
    hop = frame // 4 if hop is None else hop
    if hop <= 0:
        raise ValueError("the hop must be positive")
    need = max(1, math.ceil(min_silence * sr / hop))
    energy = membership(long, frame, hop).groupBy("signal_id", "frame").agg(F.sqrt(F.sum(F.col("value") * F.col("value")) / frame).alias("rms"))
    loudest = F.max("rms").over(Window.partitionBy("signal_id"))
    flagged = energy.withColumn("_top", loudest).filter(F.col("_top") >= 2.22e-16)
    flagged = flagged.withColumn("silent", (F.col("rms") < F.col("_top") * 10 ** (threshold_db / 20)).cast("int"))
    quiet = islands(flagged.select("signal_id", "frame", "silent"), ["signal_id"], "frame", "silent").filter((F.col("silent") == 1) & (F.col("end") - F.col("start") >= need))
    sizes = flagged.groupBy("signal_id").agg((F.max("frame") + 1).alias("n_frames"))
    # between silences: from the last one's end to the next one's start
    edges = quiet.select("signal_id", "start", "end").unionByName(sizes.select("signal_id", F.col("n_frames").alias("start"), F.col("n_frames").alias("end")))
    last = F.coalesce(F.lag("end").over(Window.partitionBy("signal_id").orderBy("start", "end")), F.lit(0))
    loud = edges.select("signal_id", last.alias("a"), F.col("start").alias("b")).filter("a < b")
    total = long.groupBy("signal_id").agg(F.count("*").alias("_n"))
    pad = int(padding * sr)
    rows = loud.join(total, "signal_id").select(
        "signal_id", F.greatest(F.lit(0).cast("long"), F.col("a") * hop - pad).alias("start"), F.least(F.col("_n"), F.col("b") * hop + pad).alias("end"),
    ).filter(F.col("end") - F.col("start") >= int(min_segment * sr))
    merged = merge_intervals(rows, ["signal_id"])
    number = F.row_number().over(Window.partitionBy("signal_id").orderBy("start")) - 1
    return merged.select("signal_id", number.cast("long").alias("segment_id"), "start", "end")


def by_event(events: DataFrame, counts: DataFrame, sr: float, duration: float | None = None, pre: float = 0.05, post: float = 0.2) -> DataFrame:
    """(signal_id, event_id, start, end) around events (signal_id, event_id, time_s), clipped to the signal.

    ``counts`` has (signal_id, c). With ``duration`` the segment is centred on the event.
    """
    if duration is not None and duration <= 0 or min(pre, post) < 0:
        raise ValueError("durations must be positive")
    at = F.floor(F.col("time_s") * sr)
    if duration is not None:
        size = int(duration * sr)
        start, end = at - size // 2, at - size // 2 + size
    else:
        start, end = at - int(pre * sr), at + int(post * sr)
    rows = events.join(counts, "signal_id").select("signal_id", "event_id", F.greatest(F.lit(0).cast("long"), start).alias("start"), F.least(F.col("c"), end).alias("end"))
    return rows.filter("start < end")
