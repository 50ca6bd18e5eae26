"""Round trips through the readers and writers: what was written reads back as the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brinewave.plans import catalogue as cat
from brinewave.session import scratch
from brinewave.sources import formats

CUSTOMER = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.table(spark, sf_dir, "customer").select(*CUSTOMER)


def _round_trip(name: str, ext: str, how: dict | None = None) -> None:
    @cat.query(name, f"select {', '.join(CUSTOMER)} from customer")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = scratch(spark, f"customer{ext}")
        formats.write(_customer(spark, sf_dir), path, **(how or {}))
        return formats.read(spark, path).select(*CUSTOMER)


_round_trip("source_csv", ".csv")
_round_trip("source_json", ".json")
_round_trip("source_json_records", ".json", {"records": True})
_round_trip("source_parquet", ".parquet")


@cat.query("source_append", "select n_nationkey, cast(2 as bigint) as n from nation")
def source_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = scratch(spark, "nation.parquet"), cat.table(spark, sf_dir, "nation")
    formats.write(rows, path)
    formats.write(rows, path, mode="append")
    return formats.read(spark, path).groupBy("n_nationkey").count().withColumnRenamed("count", "n")


@cat.query("source_folder", "select r_regionkey, r_name, true as has_path from region")
def source_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "regions")
    formats.write_csv(cat.table(spark, sf_dir, "region").select("r_regionkey", "r_name"), folder)
    rows = formats.read_folder(spark, folder, ".csv", "r_regionkey long, r_name string")
    return rows.select("r_regionkey", "r_name", rows["path"].endswith(".csv").alias("has_path"))
