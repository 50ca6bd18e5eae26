"""Overlapping frames of long signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_ids(length: int, hop: int, center: bool, count: str = "_count"):
    """The frames that sample ``n`` of a signal of ``_count`` samples lies in."""
    pad = length // 2 if center else 0
    n = F.col("n")
    last = F.floor(F.col(count) / hop) if center else F.floor((F.col(count) - length) / hop)
    first = F.greatest(F.lit(0), F.ceil((n + pad - length + 1) / hop))
    stop = F.least(F.floor((n + pad) / hop), last)
    return F.when(first <= stop, F.sequence(first.cast("long"), stop.cast("long")))


def membership(long: DataFrame, length: int, hop: int, center: bool = True) -> DataFrame:
    """(signal_id, frame, pos, value): each sample once for every frame that holds it.

    Frame count: 1 + n // hop if centred (with half a frame of zeros around), else
    1 + (n - length) // hop, none for shorter signals.
    """
    if length <= 0 or hop <= 0:
        raise ValueError("frame and hop lengths must be positive")
    count = F.count(F.lit(1)).over(Window.partitionBy("signal_id"))
    pad = length // 2 if center else 0
    rows = long.withColumn("_count", count).withColumn("frame", F.explode(frame_ids(length, hop, center)))
    return rows.select("signal_id", "frame", (F.col("n") + pad - F.col("frame") * hop).cast("int").alias("pos"), "value")


def frames(long: DataFrame, length: int, hop: int, center: bool = True) -> DataFrame:
    """(signal_id, frame, samples, own): frames as arrays of ``length``, zeros where the signal is not.

    ``own`` has the signal's samples only. One shuffle; a group is one frame.
    """
    item = F.sort_array(F.collect_list(F.struct("pos", "value")))
    rows = membership(long, length, hop, center).groupBy("signal_id", "frame").agg(item.alias("_items"))
    own = F.transform("_items", lambda x: x["value"])
    lead = F.element_at("_items", 1)["pos"]
    tail = F.lit(length - 1) - F.element_at("_items", -1)["pos"]
    samples = F.concat(F.array_repeat(F.lit(0.0), lead), own, F.array_repeat(F.lit(0.0), tail))
    return rows.select("signal_id", "frame", samples.alias("samples"), own.alias("own"))


def frame_times(framed: DataFrame, sr: float, length: int, hop: int, center: bool = True) -> DataFrame:
    """Frames with time_s; a centred frame's time lies half a frame after its start."""
    offset = length // 2 if center else 0
    return framed.withColumn("time_s", (F.col("frame") * hop + offset) / F.lit(float(sr)))
