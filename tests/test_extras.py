"""The feature driver, plot data, dialect, plugins, settings, workflows."""

import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave import config, plugins, workflow
from brinewave.functions.dialect import from_sqlite
from brinewave.operators import extract, kernels, plots, spectral
from brinewave.plans.catalogue import ORACLES, QUERIES
from brinewave.signals import to_arrays
from brinewave.sources.formats import Registry


def tone(spark, n=4096, sr=8000, f=440):
    x = 0.4 * np.sin(2 * np.pi * f * np.arange(n) / sr)
    return spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "signal_id long, n long, value double")


def test_extract_long_frames(spark):
    got = extract.extract(tone(spark), ["dominant_frequency", "spectral_bandwidth", "rms_energy", "mfcc", "spectral_contrast"], 8000, 1024, 512).orderBy("frame").collect()
    assert len(got) == 1 + 4096 // 512 and got[3]["time_s"] == pytest.approx((3 * 512 + 512) / 8000)
    assert abs(got[4]["dominant_frequency"] - 440) < 8000 / 1024 and got[4]["rms_energy"] == pytest.approx(0.4 / math.sqrt(2), rel=0.02)
    assert "spectral_centroid" in got[0].asDict() and "mfcc_12" in got[0].asDict() and "contrast_delta" in got[0].asDict()


def test_extract_names(spark):
    with pytest.raises(ValueError):
        extract.extract(tone(spark), ["none"], 8000)
    assert extract.catalog(spark).count() == len(extract.CATALOG) == 19


def test_short_and_long_spectra_agree(spark, monkeypatch):
    long = tone(spark, 512)
    names = ["spectral_centroid", "spectral_rolloff", "spectral_flatness"]
    a = extract.extract(long, names, 8000, 64, 32).orderBy("frame").collect()
    monkeypatch.setattr(extract, "EXPRESSION_LIMIT", 1)
    b = extract.extract(long, names, 8000, 64, 32).orderBy("frame").collect()
    for x, y in zip(a, b, strict=True):
        assert [x[n] for n in names] == pytest.approx([y[n] for n in names], rel=1e-6, abs=1e-9)


def test_plots(spark):
    x = np.random.default_rng(0).normal(size=32)
    long = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "signal_id long, n long, value double")
    bins = spectral.bins(spectral.spectrum(to_arrays(long), 32), 32, 1.0, "signal_id")
    got = [r["phase"] for r in plots.unwrapped_phase(bins).orderBy("k").collect()]
    assert got == pytest.approx(np.unwrap(np.angle(np.fft.rfft(x))).tolist(), abs=1e-6)
    assert plots.waveform(long, 10, 5).count() == 5 and plots.scalogram(to_arrays(long), 32, 3).count() == 96
    spec = plots.spectrogram(long, 10.0, 8, 4, 1.0, 4.0)
    assert spec.agg(F.min("frequency"), F.max("frequency")).first()[0] >= 1.0
    assert plots.colour_limits(spec).first()["low"] <= plots.colour_limits(spec).first()["high"]


def test_dialect_numbers(spark):
    def one(text):
        return spark.sql("select " + from_sqlite(text) + " as x from (select 5 as a, 2 as b, 0 as z, 2.5D as d, '12abc' as t, 'none' as w, cast(null as string) as v)").first()["x"]

    for text, want in {"a / b": 2, "a / z": None, "-a / b": -2, "a / d": 2.0, "7 / b / b": 1, "a * 3 / b": 7, "(a + 4) / abs(b - 4)": 4, "a / b * d": 5.0, "1 + a / -b": -1, "(a / b + 1) / b": 1, "7 / (a / (b / 1))": 3, "9 / (a / d) / b": 2.25, "case when a / b = 2 then 1 end": 1,
                       "cast(t as integer)": 12, "cast(w as real)": 0.0, "cast(v as int)": None, "cast(d as integer)": 2, "cast(a / b as real)": 2.0, "'a/b'": "a/b", "cast(a as text)": "5"}.items():
        if text.endswith("text)"):
            text = text.replace("text", "string")
        assert one(text) == want, text


def test_dialect():
    got = from_sqlite("SELECT \"a b\", total(x), ifnull(y, 'like total(z)') FROM df WHERE n LIKE 'A%' AND group_concat(q, ',') <> ''")
    assert got == "SELECT `a b`, coalesce(sum(x), 0D), coalesce(y, 'like total(z)') FROM df WHERE n ilike 'A%' AND listagg(q, ',') <> ''"
    with pytest.raises(ValueError):
        from_sqlite("select a from b where c glob '*'")


PLUGIN = '''
class Own:
    name, version = "own", "1.0"
    def setup(self, config): self.config = config
    def register(self, registry): registry.register(lambda c: c * 2, name="twice")
    def teardown(self): pass
'''


def test_plugins(spark, tmp_path):
    for name, api, code in (("own", ">=0.1,<9", PLUGIN), ("far", ">=9", PLUGIN), ("bad", "", "raise RuntimeError('broken')")):
        folder = tmp_path / "plugins" / name
        folder.mkdir(parents=True)
        (folder / f"{name}_code.py").write_text(code)
        (folder / "plugin.toml").write_text(f'name = "{name}"\nversion = "1.0"\napi = "{api or ">=0"}"\nentry_point = "{name}_code:Own"\n')
    (tmp_path / "plugins" / "poor").mkdir()
    (tmp_path / "plugins" / "poor" / "plugin.toml").write_text('name = "poor"\n')
    registry = Registry()
    loader = plugins.Loader(registry, tmp_path / "plugins", tmp_path / "state.json")
    loader.load()
    status = {r["name"]: r["status"] for r in loader.catalog(spark).collect()}
    assert status == {"own": "loaded", "far": "error-incompatible", "bad": "error-load_failed", "poor": "error-load_failed"}
    assert spark.range(3).select(registry.functions["twice"](F.col("id")).alias("x")).agg(F.sum("x")).first()[0] == 6
    loader.enable("own", False)
    again = plugins.Loader(Registry(), tmp_path / "plugins", tmp_path / "state.json")
    again.load()
    assert again.status["own"][1] == "disabled"
    loader.teardown()
    assert plugins.compatible("~=0.1", "0.4.0") and not plugins.compatible("!=0.4", "0.4.0") and plugins.compatible("", "1")


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text("[stft]\nn_fft = 1024\n[segmentation]\nmin_silence = 0.5\n")
    got = config.load([tmp_path / "a.toml", tmp_path / "none.toml"], {"BRINEWAVE__STFT__HOP_LENGTH": "256", "OTHER": "1"})
    assert (got.stft.n_fft, got.stft.hop_length, got.segmentation.min_silence) == (1024, 256, 0.5)
    assert config.show(got, "stft")["n_fft"] == 1024
    with pytest.raises(ValueError):
        config.load([], {"BRINEWAVE__STFT__NONE": "1"})


def test_workflow(spark):
    steps = [
        workflow.Step("sum", lambda a: a.agg(F.sum("id").alias("s")), ["double"]),
        workflow.Step("read", lambda: spark.range(4)),
        workflow.Step("double", lambda a: a.select((F.col("id") * 2).alias("id")), ["read"]),
    ]
    frames, errors = workflow.run(steps)
    assert frames["sum"].first()["s"] == 12 and not errors
    broken = workflow.Step("double", lambda a: a.select("gone"), ["read"])
    frames, errors = workflow.run([steps[0], steps[1], broken], keep_going=True)
    assert set(frames) == {"read"} and errors["sum"] == "needs double"
    with pytest.raises(ValueError):
        workflow.run([workflow.Step("a", lambda x: x, ["b"]), workflow.Step("b", lambda x: x, ["a"])])
    with pytest.raises(ValueError):
        workflow.run([workflow.Step("a", lambda x: x, ["none"])])


def test_quantiles_next_to_a_step(spark, tmp_path):
    # a boundary of values lies five rows below the median; a group without values; nulls
    v = (F.col("id") * 7919) % 200000
    rows = spark.range(0, 200000, 1, 8).select(F.lit("A").alias("l_returnflag"), F.when(v < 99995, 1.0).when(v < 179995, 2.0).otherwise(3.0).alias("l_quantity"))
    odd = spark.createDataFrame([("B", None), ("C", None), ("C", 7.0), (None, 1.0), (None, float("nan"))], "l_returnflag string, l_quantity double")
    rows.unionByName(odd).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["approximate_aggregates"](spark, str(tmp_path)).select("l_returnflag", "quantities", "middle", "high").collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, con.execute(ORACLES["approximate_aggregates"]).fetchall()))
    assert ("A", 3, 2.0, 3.0) in map(tuple, got)


def test_extract_looks_at_a_signal_once(spark):
    long = tone(spark, 2048, 8000).unionByName(tone(spark, 512, 8000).withColumn("signal_id", F.lit(1).cast("long")))
    names = ["hnr", "jitter", "mfcc", "shimmer", "spectral_contrast"]
    found = extract.extract(long, names, 8000, 256, 64)
    assert found._jdf.queryExecution().executedPlan().toString().count("FlatMapGroups") == 1
    got = {(r["signal_id"], r["frame"]): r for r in found.collect()}
    for key, n in ((0, 2048), (1, 512)):
        x = np.array([r["value"] for r in tone(spark, n, 8000).orderBy("n").collect()])
        f0, voiced, _ = kernels.pyin(x, 8000, frame=256, hop=64)
        level = np.sqrt((kernels._frames(x, 256, 64) ** 2).mean(axis=1))
        for name, want in (("hnr", kernels.hnr(x, 256, 64)), ("jitter", kernels.jitter(f0, voiced)), ("shimmer", kernels.shimmer(level, voiced))):
            assert np.allclose([got[key, i][name] for i in range(len(want))], want)


def test_pitch_of_no_dip_is_unvoiced():
    # no lag between the limits: nothing is found, and no search is made for it
    start = time.process_time()
    for _ in range(200):
        f0, voiced, p = kernels.pyin(np.sin(np.arange(80.0)), 100.0, frame=16, hop=8)
    assert len(f0) == 11 and np.isnan(f0).all() and not voiced.any() and not p.any()
    assert time.process_time() - start < 0.6
