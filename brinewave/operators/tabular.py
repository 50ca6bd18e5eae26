"""The tabular layer: SQL over a frame, filters, derived columns, description, export."""

from __future__ import annotations

import re
import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewave.functions.dialect import from_sqlite
from brinewave.functions.expressions import condition, expression


def run_sql(df: DataFrame, query: str, args: dict | None = None, name: str = "df", dialect: str = "spark") -> DataFrame:
    """A SELECT over ``df`` under the name ``df``; named parameters come from ``args``.

    ``dialect`` may be ``sqlite``.
    """
    query = from_sqlite(query) if dialect == "sqlite" else query
    spark, view = df.sparkSession, f"frame_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(view)
    try:
        own = re.match(r"\s*with\b", query, re.I)
        rest = f", {query[own.end() :]}" if own else f" {query}"
        return spark.sql(f"WITH {name} AS (SELECT * FROM {view}){rest}", args=args or {})
    except Exception as error:
        raise RuntimeError(f"SQL failed: {error}") from error
    finally:
        spark.catalog.dropTempView(view)


def filter_rows(df: DataFrame, text: str, variables: dict | None = None) -> DataFrame:
    """Rows that fulfil a filter such as ``value > 10 and channel == 'B'``."""
    return df.filter(condition(text, df.columns, variables))


def transform(df: DataFrame, expressions: dict[str, str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, select: list[str] | None = None, sort: list[str] | None = None, functions: dict | None = None) -> DataFrame:
    """Derived columns (which may call ``functions``, such as a registry's), then drop, rename, select, sort (a leading minus sorts downwards)."""
    for name, text in (expressions or {}).items():
        df = df.withColumn(name, expression(text, columns=df.columns, functions=functions))
    df = df.drop(*(drop or [])).withColumnsRenamed(rename or {})
    if select:
        df = df.select(*select)
    return df.orderBy(*[F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_first(c) for c in sort]) if sort else df


def math_range(spark: SparkSession, text: str, start: float, stop: float, step: float) -> DataFrame:
    """(x, result) of an expression in x over start, start + step, ... below stop."""
    if step == 0:
        raise ValueError("the step must not be zero")
    n = max(0, -int(-(stop - start) // step))
    x = spark.range(n).select((F.lit(float(start)) + F.col("id") * float(step)).alias("x"))
    return x.withColumn("result", expression(text, {"x": F.col("x")}).cast("double"))


def describe(df: DataFrame) -> DataFrame:
    """(column, type, n, n_present, n_distinct, mean, std, min, max), one pass over the table."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    null = F.lit(None).cast("double")
    stats = []
    for c in names:
        x = F.col(f"`{c}`")
        number = (lambda f, x=x, c=c: f(x.cast("double")) if c in numeric else null)
        stats.append(F.struct(
            F.lit(c).alias("column"), F.lit(dict(df.dtypes)[c]).alias("type"), F.count("*").alias("n"), F.count(x).alias("n_present"),
            F.countDistinct(x).alias("n_distinct"), *[number(f).alias(k) for k, f in (("mean", F.avg), ("std", F.stddev), ("min", F.min), ("max", F.max))],
        ))
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def head(df: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """The first n rows in an order that ends with a unique key."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The last n rows by columns, first to last; a bounded sort in reverse, never the whole table."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def show(df: DataFrame, n: int = 20, form: str = "table") -> str:
    """At most n rows as text: a table, CSV or JSON lines."""
    rows = df.limit(n).toPandas()
    if form not in ("table", "csv", "json"):
        raise ValueError("form must be 'table', 'csv' or 'json'")
    return rows.to_string(index=False) if form == "table" else rows.to_csv(index=False) if form == "csv" else rows.to_json(orient="records", lines=True)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], distinct: str) -> DataFrame:
    """(keys, distinct, shares): each group's number of values and the least values with a share of the rows up to them.

    Exact, over the counts of equal values; nulls do not count. Groups need not fit into memory.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_value")).agg(F.count(value).alias("_n"))
    group = Window.partitionBy(*keys)
    rows = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy("_value")), "_all": F.sum("_n").over(group)})
    # decimals, as 0.9 of a count must not be a fraction more than it is
    reached = lambda share: F.col("_upto") >= F.lit(Decimal(str(share))) * F.col("_all")
    return rows.groupBy(*keys).agg(F.count("_value").alias(distinct), *[F.min(F.when(reached(share), F.col("_value"))).alias(name) for name, share in shares.items()])


def range_join(left: DataFrame, right: DataFrame, keys: list[str], point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= point < high and equal keys: an equi-join on buckets of ``width``."""
    first, last = F.floor(F.col(low) / width), F.floor(F.col(high) / width)
    spread = right.filter(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    met = left.withColumn("_bucket", F.floor(F.col(point) / width)).join(spread, [*keys, "_bucket"])
    return met.filter((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop("_bucket")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Each left row with the latest right row of its keys at or before it: one union, one window."""
    values = [c for c in right.columns if c not in keys and c != time]
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    null_row = F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType)
    val = F.struct(F.col(time).alias("_at"), *values)
    null_val = F.lit(None).cast(right.select(val.alias("v")).schema["v"].dataType)
    a = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), null_val.alias("_val"))
    b = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), null_row.alias("_row"), val.alias("_val"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = a.unionByName(b).withColumn("_val", F.last("_val", ignorenulls=True).over(w)).filter("_side = 1")
    return met.select("_row.*", F.col("_val._at").alias(f"{time}_right"), *[F.col(f"_val.{c}").alias(c) for c in values])
