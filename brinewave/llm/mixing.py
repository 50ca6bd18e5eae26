"""Mixing sources to target weights by cube-method balanced sampling.

Every source has a target of words. Its ratio to the source's size, at most 3,
is the expected number of times that each of its documents is taken: the whole
part for sure, the fraction as an inclusion probability. The cube method moves
the vector of fractions through the null space of the constraints (the words and
the number of documents taken stay what they are) until only a few fractions are
left. That flight runs in blocks of bounded size; what each block leaves (two
documents at most) flies again in blocks, level by level, until a source has one
block left. Of that block one document of each size class (a power of two, the
``RESERVED`` smallest classes) stays out of the flight; those and the two or fewer
fractions that the flight leaves are the landing problem. It is solved by looking
at every corner of its cube: the one nearest to the target of words stands, then
the one nearest to the number of documents.

Random choices are seeded by source, level and block and rows are put in a fixed
order, so that reruns agree. Null texts have size 0; a null source is one of its
own, last in order. Equal rows are different documents that may be taken
differently, but as often in every rerun. An empty table gives an empty result.
Only doc_id, text and source are looked at; ``take`` keeps all columns, whatever
their names and kinds. Sources may be many: their sizes, weights and targets stay
in tables; only sums over them reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewave.llm.common import WORD, cut, drop_cut, plainly_named

CAP = 3.0


def fly(size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1.

    Three fractions at a time move along the vector that changes neither their
    sum nor their sum of sizes, up or down so that expectations stay.
    """
    p = p.astype(float).copy()
    rng = np.random.default_rng(seed)
    queue = [int(i) for i in rng.permutation(np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9)))]
    draws = iter(rng.random(len(queue) + 1))
    s, q = size.tolist(), p.tolist()
    held: list[int] = []
    while True:
        while len(held) < 3 and queue:
            held.append(queue.pop())
        if len(held) < 3:
            break
        i, j, k = held
        u = (s[j] - s[k], s[k] - s[i], s[i] - s[j])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min((1 - q[x]) / d if d > 0 else q[x] / -d for x, d in zip(held, u, strict=True) if d)
        down = min(q[x] / d if d > 0 else (1 - q[x]) / -d for x, d in zip(held, u, strict=True) if d)
        step = up if next(draws) < down / (up + down) else -down
        for x, d in zip(held, u, strict=True):
            v = q[x] + step * d
            q[x] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
        held = [x for x in held if 0.0 < q[x] < 1.0]
    p[:] = q
    return p


#: Size classes of which a last block keeps a document for the landing.
RESERVED = 14


def reserve(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The first open document of each size class, of the smallest classes."""
    at = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    kind = np.frexp(size[at])[1]
    return at[np.sort(np.unique(kind, return_index=True)[1][:RESERVED])]


def land(size: np.ndarray, p: np.ndarray, missing: float) -> np.ndarray:
    """Round the last fractions so that the words they take come nearest to ``missing``, then to their number."""
    at = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    out = np.round(p)
    corners = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    off = np.abs(corners @ size[at] - missing).round(6)
    out[at] = corners[np.lexsort((np.abs(corners.sum(axis=1) - p[at].sum()).round(6), off))[0]]
    return out


def _seed(*parts) -> int:
    return zlib.crc32(repr(parts).encode())


FLOWN = "_key string, size long, _h1 long, _h2 long, _p double"


def flight(rows: DataFrame, blocks: DataFrame, level: int, last: bool) -> DataFrame:
    """One level: the rows (_key, size, _h1, _h2, _p) with their new _p; ``blocks`` (_key, _n) are the sources' numbers of blocks."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h1", "_h2"], kind="stable")
        size, p = pdf["size"].to_numpy(float), pdf["_p"].to_numpy(float)
        held = reserve(size, p) if pdf["_n"].iloc[0] == 1 else np.zeros(0, np.int64)
        flown = p.copy()
        flown[held] = 0
        flown = fly(size, flown, _seed(level, *map(str, key)))
        flown[held] = p[held]
        if last:
            flown = land(size, flown, float(size @ p) - float(size @ (flown > 1 - 1e-9)))
        return pdf.assign(_p=flown)[["_key", "size", "_h1", "_h2", "_p"]]

    dealt = rows.join(blocks, "_key").withColumn("_block", F.pmod(F.xxhash64("_h1", F.lit(level)), F.col("_n")))
    return dealt.select("_key", "size", "_h1", "_h2", "_p", "_n", "_block").groupBy("_key", "_block").applyInPandas(run, FLOWN)


def numbered(per: DataFrame) -> DataFrame:
    """``per`` (a row a source) with _i, the source's place by code point, null last."""
    ranged = per.withColumn("_none", F.col("source").isNull()).repartitionByRange("_none", "source").withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    before = parts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_none", "source")) - 1
    return ranged.withColumn("_in", place).join(F.broadcast(before), "_part").withColumn("_i", F.col("_before") + F.col("_in")).drop("_none", "_part", "_in", "_before")


def aimed(per: DataFrame, weights: dict | None, cap: float, pattern: tuple = (5.0, 2.0, 1.0)) -> DataFrame:
    """``per`` (source, source_size, n) with _key, weight, target and _ratio.

    The targets are least(cap * size, rate * weight). The rate rises from the one
    without a cap until no further source is above its cap.
    """
    if weights is None:
        number = F.pmod("_i", F.lit(len(pattern))).cast("int")
        per = numbered(per).withColumn("weight", F.element_at(F.array(*map(F.lit, pattern)), number + 1)).drop("_i")
    else:
        table = per.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_s string, weight double")
        per = per.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    per = cut(per, "weighed")
    most = F.col("source_size") * cap
    total, whole = per.agg(F.sum("source_size"), F.sum("weight")).first()
    rate, held = (float(total) / whole if whole else 0.0), 0
    while True:
        over = F.col("weight") * rate > most
        n, capped, free = per.agg(F.count_if(over), F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == held or not free:
            break
        rate, held = (total - capped) / free, n
    target = F.least(most.cast("double"), F.col("weight") * rate)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("_key")
    ratio = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("_ratio")
    return per.select(key, "source_size", "n", target.alias("target"), ratio)


def mix(df: DataFrame, weights: dict | None = None, cap: float = CAP, block_rows: int = 4_000, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, size, source, source_size, target, taken and copies of every document.

    ``weights`` by source; by default 5, 2, 1 repeating in order of the sources. The
    tables of sources are broadcast up to ``broadcast_rows`` rows, and joined by a
    shuffle beyond. _k1 and _k2 are hashes of the whole row; equal rows share them.
    """

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = df.select("doc_id", "source", size.alias("size"), *row_keys(df))
    # Equal rows travel as one with their number, and are told apart by it.
    rows = cut(rows.groupBy("_k1", "_k2", "doc_id", "source", "size").agg(F.count("*").alias("_m")), "sizes")
    per = cut(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("_m")).alias("source_size"), F.sum("_m").alias("n")), "sources")
    few = per.limit(broadcast_rows + 1).count() <= broadcast_rows
    plan = cut(aimed(per, weights, cap), "plan")
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))).join(small(plan.drop("n")), "_key")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m")))).drop("_m")
    rows = rows.withColumns({"_h1": F.xxhash64("_k1", "_k2", "_i"), "_h2": F.xxhash64("_i", "_k2", "_k1")})
    rows = rows.withColumn("_whole", F.floor(F.col("_ratio") + 1e-12)).withColumn("_p", F.greatest(F.lit(0.0), F.col("_ratio") - F.col("_whole")))
    open_rows = rows.filter((F.col("_p") > 1e-9) & (F.col("size") > 0)).select("_key", "size", "_h1", "_h2", "_p")
    done, level, left = [], 0, plan.select("_key", "n")
    while True:
        blocks = cut(left.select("_key", F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("long").alias("_n")), f"blocks{level}")
        last = (blocks.agg(F.max("_n")).first()[0] or 1) == 1
        flown = cut(flight(open_rows, small(blocks), level, last), f"flight{level}")
        drop_cut(blocks)
        if last:
            done.append(flown)
            break
        settled = (F.col("_p") < 1e-9) | (F.col("_p") > 1 - 1e-9)
        done.append(flown.filter(settled))
        open_rows, level = flown.filter(~settled), level + 1
        left = open_rows.groupBy("_key").agg(F.count("*").alias("n"))
    moved = done[0]
    for part in done[1:]:
        moved = moved.unionByName(part)
    out = rows.join(moved.filter("_p > 0.5").select("_h1", "_h2", F.lit(1).alias("_q")), ["_h1", "_h2"], "left")
    copies = (F.col("_whole") + F.coalesce("_q", F.lit(0))).cast("long")
    return out.select("doc_id", "size", "source", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "_k1", "_k2")


def row_keys(df: DataFrame) -> list:
    """128 bits of hash of the whole row, whatever its columns are called; columns that hold maps or variants are hashed as JSON."""
    as_json = lambda kind: "map<" in kind or "variant" in kind
    columns = [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if as_json(kind) else F.col(f"`{c}`") for c, kind in df.dtypes]
    return [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit("second"), *columns[::-1]).alias("_k2")]


def report(df: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every document."""
    return mix(df, **how).select("doc_id", "size", "source_size", "target", "taken", "source")


def take(df: DataFrame, broadcast_rows: int = 500_000, **how) -> DataFrame:
    """The rows of ``df`` that the mix takes, as often as it takes them.

    The choice (a key and a number for each row taken) is broadcast up to
    ``broadcast_rows`` rows, and joined by a shuffle beyond.
    """
    key = ["_k1", "_k2"]
    plain = plainly_named(df, "doc_id", "text", "source")
    mixed = mix(plain, **how)
    chosen = cut(mixed.groupBy(*key).agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_m")).filter("_copies > 0"), "chosen")
    drop_cut(mixed)
    few = chosen.limit(broadcast_rows + 1).count() <= broadcast_rows
    met = plain.select("*", *row_keys(plain)).join(F.broadcast(chosen) if few else chosen, key)
    rows = met.filter("_m = 1")
    if chosen.filter("_m > 1").limit(1).count():
        rows = rows.unionByName(met.filter("_m > 1").dropDuplicates(key))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*plain.columns).toDF(*df.columns)
