"""Readers, writers, the registry, streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.operators import tabular, time_windows
from brinewave.sources import formats
from brinewave.streaming import windows

SF = "/root/testdata/sf0.001"


def test_csv_json_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "colA int, colB string")
    for ext in (".csv", ".json", ".parquet"):
        path = f"{tmp_path}/out{ext}"
        formats.write(df, path)
        assert sorted((int(r["colA"]), r["colB"]) for r in formats.read(spark, path).collect()) == [(1, "x"), (2, "y")]
        with pytest.raises(Exception, match="(?i)exists"):
            formats.write(df, path)
        formats.write(df, path, mode="append")
        assert formats.read(spark, path).count() == 4
        formats.write(df, path, mode="overwrite")
        assert formats.read(spark, path).count() == 2
    (tmp_path / "a.json").write_text('[{"time": 0, "value": 1.5},\n {"time": 1, "value": 2.5}]')
    (tmp_path / "l.json").write_text('{"time": 0, "value": 1.5}\n{"time": 1, "value": 2.5}\n')
    for name in ("a", "l"):
        assert sorted((r["time"], r["value"]) for r in formats.read(spark, f"{tmp_path}/{name}.json").collect()) == [(0, 1.5), (1, 2.5)]
    with pytest.raises(ValueError):
        formats.read(spark, "data.xyz")
    with pytest.raises(ValueError):
        formats.write(df, "data.csv", mode="ignore")


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "b.npz", first=np.arange(5), second=np.ones((2, 2)) / 3)
    got = {r["name"]: r for r in formats.read(spark, f"{tmp_path}/b.npz").collect()}
    assert got["first"]["data"] == [0, 1, 2, 3, 4] and got["second"]["shape"] == [2, 2] and got["first"]["dtype"].startswith("int")
    formats.write(spark.createDataFrame([(1.0, 2), (3.0, 4)], "a double, b int").coalesce(1), f"{tmp_path}/o.npz")
    with np.load(tmp_path / "o.npz") as z:
        assert z["a"].tolist() == [1, 3] and z["b"].tolist() == [2, 4]


def test_wav(spark, tmp_path):
    tone = 0.5 * np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)
    df = spark.createDataFrame([("tone", 8000, tone.tolist()), ("loud", 8000, [2.0, -2.0, 0.0])], "name string, sr int, samples array<double>")
    formats.write_wav(df, str(tmp_path))
    got = {r["signal_id"].rsplit("/", 1)[1]: r for r in formats.read(spark, f"{tmp_path}/*.wav").collect()}
    assert np.allclose(got["tone.wav"]["samples"], tone, atol=1e-4) and got["loud.wav"]["samples"][:2] == pytest.approx([1, -1], abs=1e-4)
    half = formats.read(spark, f"{tmp_path}/tone.wav", sr=4000, offset=0.25, duration=0.5).first()
    assert half["sr"] == 4000 and len(half["samples"]) == 2000
    rate, x = formats.decode_wav(formats.encode_wav(np.stack([tone, -tone]), 8000), mono=False)
    assert x.shape == (2, 8000) and np.allclose(x[0], -x[1], atol=1e-4)
    names = formats.segment_names(spark.createDataFrame([(0,), (11,)], "segment_id long"), "clip", 12)
    assert sorted(r["name"] for r in names.collect()) == ["clip_segment_00", "clip_segment_11"]


def test_registry(spark, tmp_path):
    own = formats.Registry()
    own.add_reader("TXT", lambda s, p: s.read.text(p))
    (tmp_path / "n.txt").write_text("one\ntwo\n")
    assert formats.read(spark, f"{tmp_path}/n.txt", registry=own).count() == 2 and own.extensions() == [".txt"]

    @own.register(name="double")
    def twice(c):
        return c * 2

    assert spark.range(3).select(own.functions["double"](F.col("id")).alias("x")).agg(F.sum("x")).first()[0] == 6


def test_folder_and_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,value\n0,1.0\n")
    (tmp_path / "b.csv").write_text("time,value\n0,2.0\n1,3.0\n")
    (tmp_path / "c.txt").write_text("no table")
    got = formats.read_folder(spark, str(tmp_path), ".csv", "time double, value double")
    assert got.count() == 3 and got.select("path").distinct().count() == 2
    formats.save_table(spark.createDataFrame([(1,)], "a int"), "brinewave_test_table")
    formats.save_table(spark.createDataFrame([(2,), (3,)], "a int"), "brinewave_test_table")
    assert formats.query_table(spark, "select sum(a) from brinewave_test_table where a > :low", {"low": 0}).first()[0] == 5
    spark.sql("drop table brinewave_test_table")


SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def test_streams_equal_batches(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    for i, part in enumerate(table.randomSplit([0.5, 0.5], 1)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    stream = lambda: windows.events(spark, f"{tmp_path}/in/*", SCHEMA, "ts", "3650 days", "*.parquet")
    key = lambda df: sorted(map(str, ((r["user_id"], r["start"], r["n"], round(r["total"], 6)) for r in df.collect())))
    windows.drain(windows.tumbling(stream(), "ts", ["user_id"], "6 hours", "value"), "tumbled")
    assert key(spark.table("tumbled")) == key(time_windows.tumbling(table, "ts", ["user_id"], "6 hours", "value"))
    windows.drain(windows.tumbling(stream(), "ts", ["user_id"], "6 hours", "value", "3 hours"), "slid")
    assert key(spark.table("slid")) == key(time_windows.tumbling(table, "ts", ["user_id"], "6 hours", "value", "3 hours"))
    windows.drain(windows.sessions(stream(), "ts", ["user_id"], "2 hours", "value"), "met")
    assert key(spark.table("met")) == key(time_windows.sessions(table, "ts", ["user_id"], "2 hours", "value"))


def test_stateful_smoothing(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    low = table.filter("event_id < 500")
    low.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = lambda: windows.events(spark, f"{tmp_path}/in/*", SCHEMA, "ts", "1 day", "*.parquet")
    windows.drain(windows.smoothed(stream(), "user_id", "event_id", "value", 0.3), "smooth", "append")
    got = {(r["user_id"], r["event_id"]): r["smoothed"] for r in spark.table("smooth").collect()}
    last, want = {}, {}
    for r in low.orderBy("event_id").collect():
        y = r["value"] if r["user_id"] not in last else 0.3 * r["value"] + 0.7 * last[r["user_id"]]
        last[r["user_id"]] = want[r["user_id"], r["event_id"]] = y
    assert got == pytest.approx(want)


def test_arrays_in_memory(tmp_path):
    grid = np.arange(6.0).reshape(2, 3)
    formats.save_arrays(grid, f"{tmp_path}/g.npz")
    assert (np.load(f"{tmp_path}/g.npz")["data"] == grid).all()
    formats.save_arrays(grid, f"{tmp_path}/g.csv")
    assert (tmp_path / "g.csv").read_text().splitlines() == ["0.0,1.0,2.0", "3.0,4.0,5.0"]
    formats.save_arrays(grid[0], f"{tmp_path}/v.csv")
    assert (tmp_path / "v.csv").read_text().splitlines() == ["value", "0.0", "1.0", "2.0"]
    formats.save_arrays({"a": grid, "b": grid[0]}, f"{tmp_path}/n.npz")
    assert sorted(np.load(f"{tmp_path}/n.npz").files) == ["a", "b"]
    for bad in ((grid[None], "x.csv"), ({"a": grid}, "x.csv"), (grid, "x.json")):
        with pytest.raises(ValueError):
            formats.save_arrays(bad[0], f"{tmp_path}/{bad[1]}")


def test_bundles_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        np.savez(f"{tmp_path}/in/b{i}.npz", x=np.arange(i + 1), y=np.full((2, 2), i / 4, np.float32))
    formats.write_bundles(formats.read_npz(spark, f"{tmp_path}/in"), f"{tmp_path}/out")
    for i in range(3):
        got = np.load(f"{tmp_path}/out/b{i}.npz")
        assert (got["x"] == np.arange(i + 1)).all() and got["x"].dtype == np.int64
        assert (got["y"] == i / 4).all() and got["y"].dtype == np.float32 and got["y"].shape == (2, 2)


def test_points_and_records(spark, tmp_path):
    (tmp_path / "p.json").write_text('[{"time": 0, "amplitude": 1.5}, {"time": 1, "amplitude": -2}]')
    row = formats.read_points(spark, f"{tmp_path}/p.json", 8.0).first()
    assert row["samples"] == [1.5, -2.0] and row["sr"] == 8.0
    df = spark.range(10, numPartitions=3).selectExpr("id", "if(id = 4, null, concat('\"', id)) as t")
    formats.write(df, f"{tmp_path}/r.json", records=True)
    assert sorted(map(tuple, formats.read(spark, f"{tmp_path}/r.json").select("id", "t").collect())) == sorted(map(tuple, df.collect()))
    for part in (tmp_path / "r.json").glob("part-*.txt"):
        assert isinstance(json.loads(part.read_text()), list)


def test_show(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string").coalesce(1).orderBy("a")
    assert tabular.show(df, 1, "csv") == "a,b\n1,x\n"
    assert tabular.show(df, 2, "json").splitlines() == ['{"a":1,"b":"x"}', '{"a":2,"b":"y"}']
    assert "x" in tabular.show(df)
    with pytest.raises(ValueError):
        tabular.show(df, 1, "xml")
    registry = formats.default_registry()
    registry.register(lambda x: x * 2, name="twice")
    assert tabular.transform(df, {"c": "twice(a) + 1"}, functions=registry.functions).first()["c"] == 3
