"""The pipeline: every stage's decisions on a small corpus and on the smallest tables."""

import re

import corpus_pipeline as cp
from brinewave.llm import simjoin, toxicity
from brinewave.llm.common import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    bad = {r["doc_id"] for r in toxicity.report(docs, labels).filter("predicted = 1").collect()}
    one = cut(cp.drop_toxic(spark, docs, SF), "one")
    assert one.schema == docs.schema and {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    two = cut(cp.drop_near_duplicates(spark, one, SF), "two")
    assert two.columns == docs.columns
    kept = {r["component_id"] for r in simjoin.report(one).collect()}
    assert {r["doc_id"] for r in two.collect()} == kept and two.count() == len(kept)
    three = cut(cp.rewrite_personal_data(spark, two, SF), "three")
    assert three.dtypes == docs.dtypes and three.count() == two.count()
    for r in three.collect():
        assert len(r["text"] or "") == r["n_chars"] and not re.search(r"[\w.]+@[\w-]+\.[\w.]+", r["text"])
    four = cut(cp.mix_sources(spark, three, SF), "four")
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} <= kept
    five = cp.pack_sequences(spark, four, SF).collect()
    assert sum(r["piece"] == 0 for r in five) == four.count()


def test_run(spark):
    rows = cp.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    first = docs.first()
    odd = spark.createDataFrame([(None, None, None, None, None), (90001, "", "en", None, 0), (90002, None, None, "x", 0), tuple(first), tuple(first)], docs.schema)
    wide = docs.unionByName(odd).selectExpr("*", "'a' as _k1", "'b' as _all", "'c' as score", "map('k', 1) as m", "doc_id as node", "text as _row")
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        rows = cut(stage(spark, rows, str(tmp_path)), name)
        assert rows.dtypes == wide.dtypes and rows.count() > 0
        found = rows.collect()
        assert {(r["_k1"], r["_all"], r["score"], r["m"]["k"]) for r in found} == {("a", "b", "c", 1)} and all(r["node"] == r["doc_id"] for r in found)
        if name in ("near_duplicates", "personal_data"):
            assert sum(r["doc_id"] == first["doc_id"] for r in found) == 1 and sum(not r["text"] for r in found) == 3
    assert cp.pack_sequences(spark, rows, str(tmp_path)).filter("piece = 0").count() == rows.count()
