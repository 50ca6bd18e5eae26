"""Datasets from frame features: vectors per segment, padded sequences, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "median": lambda c: F.percentile(c, 0.5),
    "min": F.min,
    "max": F.max,
}


def vectors(features: DataFrame, segments: DataFrame, aggregation: str | dict[str, str] = "mean", columns: list[str] | None = None, bucket: int = 64) -> DataFrame:
    """One row per segment (signal_id, segment_id, ...): each feature aggregated over start <= frame < end.

    NaN counts as missing. A segment that does not lie within the signal's frames
    has nulls. The range join is an equi-join on buckets of ``bucket`` frames.
    """
    columns = columns or [c for c in features.columns if c not in ("signal_id", "frame", "time", "time_s")]
    how = aggregation if isinstance(aggregation, dict) else dict.fromkeys(columns, aggregation)
    for c in columns:
        if how.get(c, "mean") not in AGGREGATES:
            raise ValueError(f"aggregation must be one of {sorted(AGGREGATES)}")
    counts = features.groupBy("signal_id").agg((F.max("frame") + 1).alias("_n"))
    valid = segments.join(counts, "signal_id").filter("start >= 0 and start < end and end <= _n and start < _n")
    spread = valid.select("signal_id", "segment_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))).alias("_b"))
    framed = features.select("signal_id", "frame", *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns], F.floor(F.col("frame") / bucket).alias("_b"))
    met = spread.join(framed, ["signal_id", "_b"]).filter("frame >= start and frame < end")
    rows = met.groupBy("signal_id", "segment_id").agg(*[AGGREGATES[how.get(c, "mean")](F.col(c)).alias(c) for c in columns])
    return segments.join(rows, ["signal_id", "segment_id"], "left")


def sequences(features: DataFrame, columns: list[str], max_length: int, padding: float = 0.0, truncate: str = "post") -> DataFrame:
    """(signal_id, step, columns): exactly ``max_length`` steps, cut before or after, padded at the end."""
    if truncate not in ("pre", "post"):
        raise ValueError("truncate must be 'pre' or 'post'")
    if max_length <= 0:
        raise ValueError("the length must be positive")
    counts = features.groupBy("signal_id").agg(F.count("*").alias("_n"), F.min("frame").alias("_first"))
    skip = F.greatest(F.lit(0), F.col("_n") - max_length) if truncate == "pre" else F.lit(0)
    steps = counts.select("signal_id", (F.col("_first") + skip).alias("_from"), F.explode(F.sequence(F.lit(0), F.lit(max_length - 1))).alias("step"))
    steps = steps.withColumn("frame", F.col("_from") + F.col("step"))
    met = steps.join(features.select("signal_id", "frame", *columns), ["signal_id", "frame"], "left")
    return met.select("signal_id", F.col("step").cast("long").alias("step"), *[F.coalesce(F.col(c).cast("double"), F.lit(padding)).alias(c) for c in columns])


def _coordinates(n: int, size: int) -> list[tuple[int, int, float]]:
    """For each output index the two input indices and the share of the second."""
    out = []
    for i in range(size):
        x = i * (n - 1) / (size - 1) if size > 1 else 0.0
        lo = min(int(x), n - 1)
        out.append((lo, min(lo + 1, n - 1), x - lo))
    return out


def resize(image: Column, shape: tuple[int, int], size: tuple[int, int], order: int = 1) -> Column:
    """Bilinear (order 1) or nearest (order 0) resize of array<array<double>> of a known shape."""
    if order not in (0, 1):
        raise ValueError("column expressions resize with order 0 or 1; use kernels.resize beyond")
    rows, cols = _coordinates(shape[0], size[0]), _coordinates(shape[1], size[1])

    def near(c: tuple[int, int, float]) -> int:
        return c[0] if c[2] < 0.5 else c[1]

    def pixel(r: tuple, c: tuple) -> Column:
        at = lambda i, j: image[i][j]
        if order == 0:
            return at(near(r), near(c))
        top = at(r[0], c[0]) * (1 - c[2]) + at(r[0], c[1]) * c[2]
        low = at(r[1], c[0]) * (1 - c[2]) + at(r[1], c[1]) * c[2]
        return top * (1 - r[2]) + low * r[2]

    return F.array(*[F.array(*[pixel(r, c) for c in cols]) for r in rows])


def unit_range(image: Column) -> Column:
    """Values moved to 0..1; a constant image is 0."""
    flat = F.flatten(image)
    lo, hi = F.array_min(flat), F.array_max(flat)
    return F.transform(image, lambda row: F.transform(row, lambda x: F.when(hi - lo < 2.22e-16, 0.0).otherwise((x - lo) / (hi - lo))))
