"""Operators beyond the catalogue: small inputs with known results, odd inputs, refusals, plans."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave import signals
from brinewave.functions import arrays as A
from brinewave.functions.expressions import condition, expression
from brinewave.operators import assemble, effects, framing, scaling, segment, spectral, tabular, time_features, transforms


def long(spark, *values):
    return spark.createDataFrame([(i, n, float(v)) for i, vs in enumerate(values) for n, v in enumerate(vs)], "signal_id long, n long, value double")


def array(spark, *values):
    return spark.createDataFrame([(i, [float(v) for v in vs]) for i, vs in enumerate(values)], "signal_id long, samples array<double>")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("signal_id", "n").collect()]


def test_filter_text(spark):
    df = spark.createDataFrame([(0, 10, "A"), (1, 20, "B"), (2, 5, "A"), (3, 25, "B"), (4, 15, "A")], "time int, value int, channel string")
    assert [tuple(r) for r in tabular.filter_rows(df, "value > 10 and channel == 'B'").collect()] == [(1, 20, "B"), (3, 25, "B")]
    got = tabular.run_sql(df, "SELECT time, value FROM df WHERE channel = 'A' ORDER BY value DESC").collect()
    assert [tuple(r) for r in got] == [(4, 15), (0, 10), (2, 5)]
    assert tabular.run_sql(df, "with x as (select max(value) as m from df) select m from x").first()[0] == 25
    for bad in ("nothing > 1", "value >", "__import__('os')", "value.real > 1", "`gone` == 1"):
        with pytest.raises(ValueError):
            tabular.filter_rows(df, bad)
    with pytest.raises(RuntimeError):
        tabular.run_sql(df, "SELECT gone FROM df").collect()


def test_expressions(spark):
    one = spark.range(1)
    value = lambda text, **v: one.select(expression(text, v).alias("x")).first()[0]
    assert value("sin(x) + pi", x=0.5) == pytest.approx(math.sin(0.5) + math.pi) and value("np.sqrt(a) ** 2", a=9.0) == pytest.approx(9)
    assert value("1 if 0 < x < 2 else 0", x=1) == 1 and value("-a // 2", a=5) == -3
    for bad in ("__import__('os')", "open('f')", "unknown", "x.__class__", "[1, 2]", "lambda: 1", "sin(x=1)"):
        with pytest.raises((ValueError, NameError)):
            expression(bad, {"x": 1.0})
    assert "IN" in str(condition("a in [1, 2] or not b != 'x'", ["a", "b"])).upper()


def test_frames(spark):
    got = {r["frame"]: r["samples"] for r in framing.frames(long(spark, range(1, 8)), 4, 2).collect()}
    assert got == {0: [0, 0, 1, 2], 1: [1, 2, 3, 4], 2: [3, 4, 5, 6], 3: [5, 6, 7, 0]}
    assert framing.frames(long(spark, [1, 2]), 4, 2, center=False).count() == 0
    with pytest.raises(ValueError):
        framing.membership(long(spark, [1]), 0, 2)


def test_time_features_of_odd_frames(spark):
    df = array(spark, [], [2.0] * 8, [0.0] * 8, [1.0, -1.0], [3.0])
    for name, f in time_features.TIME_FEATURES.items():
        got = [r[0] for r in df.select(f(F.col("samples")).alias("x")).collect()]
        assert all(x is not None and not math.isnan(x) for x in got), name
        assert got[0] == 0.0 and got[2] == 0.0
    assert [r[0] for r in df.select(time_features.crest_factor(F.col("samples"))).collect()] == [0, 1, 0, 1, 1]


def test_spectral_features_of_odd_spectra(spark):
    df = array(spark, [0.0] * 5, [0, 0, 3, 0, 0], [1.0] * 5)
    f = A.literal([0, 10, 20, 30, 40])
    rows = df.select(*[g(F.col("samples"), f).alias(k) for k, g in spectral.SPECTRAL_FEATURES.items()]).collect()
    assert rows[0]["spectral_rolloff"] == 40 and rows[0]["spectral_centroid"] == 0 and rows[0]["spectral_flatness"] == 0
    assert rows[1]["dominant_frequency"] == 20 == rows[1]["spectral_centroid"] and rows[1]["spectral_bandwidth"] == 0
    assert rows[2]["spectral_flatness"] == pytest.approx(1)


def test_windows_match_definitions():
    assert A.window("hann", 5) == pytest.approx([0, 0.5, 1, 0.5, 0]) and A.window("hann", 4, periodic=True) == pytest.approx([0, 0.5, 1, 0.5])
    assert A.window("triang", 4) == pytest.approx([0.25, 0.75, 0.75, 0.25]) and A.window("triang", 3) == pytest.approx([0.5, 1, 0.5])
    assert A.window("blackman", 1) == [1.0]
    with pytest.raises(ValueError):
        A.window("none", 4)


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_convolution_against_numpy(spark, mode):
    rng = np.random.default_rng(0)
    for n, k in ((5, 3), (9, 4), (6, 6)):
        a, b = rng.normal(size=n), rng.normal(size=k)
        df = array(spark, a).withColumn("x", transforms.convolve(F.col("samples"), A.literal(b.tolist()), mode))
        assert df.first()["x"] == pytest.approx(np.convolve(a, b, mode).tolist())
        df = array(spark, a).withColumn("x", transforms.correlate(F.col("samples"), A.literal(b.tolist()), mode))
        assert df.first()["x"] == pytest.approx(np.correlate(a, b, mode).tolist())


def test_effects(spark):
    x = long(spark, np.sin(np.arange(40) / 3))
    same = values(x)
    assert values(effects.tremolo(x, 100, depth=0)) == pytest.approx(same) and values(effects.gain(x, 0)) == pytest.approx(same)
    assert values(effects.delay(x, 100, 0.0, wet=0.5, dry=1)) == pytest.approx([1.5 * v for v in same])

    def loop(v, lag, fb, wet, dry):
        buffer, out = [0.0] * lag, []
        for i, a in enumerate(v):
            d = buffer[i % lag]
            out.append(dry * a + wet * d)
            buffer[i % lag] = a + fb * d
        return out

    assert values(effects.delay(x, 100, 0.05, 0.7, 0.5, 0.9)) == pytest.approx(loop(same, 5, 0.7, 0.5, 0.9))
    assert values(effects.chorus(x, 100)) == pytest.approx(loop(same, math.ceil((0.025 + 0.002) * 100) + 2, 0.2, 0.5, 1.0))
    moving = values(effects.chorus(x, 1000, depth=0.0, delay=0.004, feedback=0.0, mode="modulated"))
    assert moving == pytest.approx([a + 0.5 * b for a, b in zip(same, [0] * 4 + same, strict=False)])
    square = values(effects.tremolo(x, 100, 7, 1.0, "square"))
    assert square[0] == 0 and square[1] == pytest.approx(same[1])
    for bad in (lambda: effects.flanger(x, 100, depth=0.005, delay=0.001), lambda: effects.compress(x, 2.0), lambda: effects.delay(x, 100, feedback=1.0), lambda: effects.tremolo(x, 100, shape="saw"), lambda: effects.equalise(x, {60.0: 1.0}, 100), lambda: effects.widen(x, -1)):
        with pytest.raises(ValueError):
            bad()
    response = effects.impulse_response(100, 0.1, seed=1)
    assert len(response) == 15 and max(map(abs, response)) == 1.0 and response == effects.impulse_response(100, 0.1, seed=1)
    loud = effects.equalise(array(spark, np.sin(2 * np.pi * 50 * np.arange(400) / 1000)), {50.0: 6.0}, 1000.0, mode="peaking").first()["values"]
    assert max(loud[200:]) == pytest.approx(10 ** (6 / 20), rel=0.02)


def test_segments(spark):
    x = long(spark, range(25))
    rows = lambda **k: [(r["start"], r["own"]) for r in segment.fixed_length(x, 10, 1.0, **k).orderBy("start").collect()]
    assert rows() == [(0, 10), (10, 10), (20, 5)] and rows(pad=False) == [(0, 10), (10, 10)] and rows(min_seconds=0.6) == [(0, 10), (10, 10)]
    assert rows(overlap=0.5) == [(0, 10), (5, 10), (10, 10), (15, 10), (20, 5)] and segment.fixed_length(x, 10, 0.05).count() == 0
    quiet = np.zeros(2000)
    quiet[300:700], quiet[1200:1500] = 0.5, 0.5
    got = segment.by_silence(long(spark, quiet), 1000, -40, 0.1, 0.05, 0.0, 64, 16).orderBy("start").collect()
    assert len(got) == 2 and abs(got[0]["start"] - 300) <= 64 and abs(got[1]["end"] - 1500) <= 64
    assert segment.by_silence(long(spark, [0.0] * 100), 1000, frame=16, hop=4).count() == 0
    events = spark.createDataFrame([(0, 0, 0.02), (0, 1, 2.4), (0, 2, 9.0)], "signal_id long, event_id long, time_s double")
    counts = x.groupBy("signal_id").agg(F.count("*").alias("c"))
    got = segment.by_event(events, counts, 10, pre=0.3, post=0.5).orderBy("event_id").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 5), (21, 25)]
    assert [(r["start"], r["end"]) for r in segment.by_event(events, counts, 10, duration=0.4).orderBy("event_id").collect()] == [(0, 2), (22, 25)]
    for bad in (lambda: segment.by_silence(x, 10, 3.0), lambda: segment.fixed_length(x, 10, 1.0, overlap=1.0), lambda: segment.by_event(events, counts, 10, duration=-1)):
        with pytest.raises(ValueError):
            bad()


def test_scaling(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (4, 4.0, 5.0)], "time int, a double, b double")
    assert scaling.numeric_columns(df) == ["a", "b"]
    got = [tuple(r) for r in scaling.scale(df).select("a", "b").collect()]
    x = np.array([1.0, 2, 4])
    assert [g[0] for g in got] == pytest.approx(((x - x.mean()) / x.std()).tolist()) and [g[1] for g in got] == [0, 0, 0]
    assert [r["a"] for r in scaling.scale(df, "minmax", ["a"], feature_range=(-1.0, 1.0)).collect()] == pytest.approx([-1, -1 / 3, 1])
    assert [r["a"] for r in scaling.scale(df, "robust", ["a"]).collect()] == pytest.approx(((x - 2) / 1.5).tolist())
    with pytest.raises(ValueError):
        scaling.fit(df, ["a"], "log")


def test_assembly(spark):
    features = spark.createDataFrame([(0, i, float(i), float("nan") if i == 2 else 1.0) for i in range(50)], "signal_id long, frame long, rms double, zcr double")
    segments = spark.createDataFrame([(0, 0, 0, 15, "A"), (0, 1, 15, 30, "B"), (0, 2, 10, 60, "C")], "signal_id long, segment_id long, start long, end long, label string")
    got = assemble.vectors(features, segments, {"rms": "max", "zcr": "mean"}, bucket=8).orderBy("segment_id").collect()
    assert [(r["label"], r["rms"], r["zcr"]) for r in got] == [("A", 14, 1), ("B", 29, 1), ("C", None, None)]
    with pytest.raises(ValueError):
        assemble.vectors(features, segments, "mode")
    seq = lambda n, **k: [r["rms"] for r in assemble.sequences(features, ["rms"], n, **k).orderBy("step").collect()]
    assert seq(3) == [0, 1, 2] and seq(3, truncate="pre") == [47, 48, 49] and seq(52, padding=-1.0)[-3:] == [49, -1, -1]


def test_tabular(spark):
    got = tabular.math_range(spark, "x ** 2", 0, 1, 0.25).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0.25, 0.0625), (0.5, 0.25), (0.75, 0.5625)]
    points = spark.createDataFrame([(1, 5.0), (1, 15.0), (1, 20.0)], "k int, t double")
    spans = spark.createDataFrame([(1, 0.0, 15.0, "a"), (1, 15.0, 20.0, "b"), (1, 9.0, 9.0, "none")], "k int, lo double, hi double, name string")
    assert sorted((r["t"], r["name"]) for r in tabular.range_join(points, spans, ["k"], "t", "lo", "hi", 4.0).collect()) == [(5.0, "a"), (15.0, "b")]
    quotes = spark.createDataFrame([(1, 4.0, 10), (1, 15.0, 11)], "k int, t double, price int")
    assert sorted((r["t"], r["price"]) for r in tabular.as_of_join(points, quotes, ["k"], "t").collect()) == [(5.0, 10), (15.0, 11), (20.0, 11)]


def test_sampling_rate_and_cleaning(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.01), (0, 0.02), (1, 0.0), (1, 1.0), (1, 5.0)], "signal_id long, time double")
    got = {r["signal_id"]: r["fs"] for r in signals.sampling_rate(df).collect()}
    assert got[0] == pytest.approx(100) and got[1] == 1.0
    text = spark.createDataFrame([("1.5",), ("x",), (None,), ("nan",)], "value string")
    assert [r["value"] for r in signals.clean(text).collect()] == [1.5]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    text = plan(tabular.filter_rows(lines, "l_quantity > 10").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in text and "l_comment" not in text and "l_tax" not in text
    framed = framing.frames(long(spark, range(20)), 4, 2)
    assert plan(framed.select(*[f(F.col("samples")).alias(k) for k, f in time_features.TIME_FEATURES.items()])).count("Generate") == 1
    assert "CartesianProduct" not in plan(assemble.sequences(long(spark, range(9)).withColumnRenamed("n", "frame"), ["value"], 4))


def test_stdin(spark, monkeypatch):
    from brinewave.sources import formats

    monkeypatch.setattr("sys.stdin", io.StringIO("time,value\n0,1.5\n1,2.5\n"))
    assert [tuple(r) for r in formats.read(spark, "-").collect()] == [(0, 1.5), (1, 2.5)]


def test_dft_of_many_odd_signals(spark):
    # direct sums sample by sample, to the last bit; null numbers where there are not n known samples; a kernel, not 64 * 33 interpreted steps a row
    rng = np.random.default_rng(5)
    good = rng.standard_normal((3000, 64))
    odd = [None, [], [1.0] * 63, [1.0] * 65, [1.0] * 63 + [None]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*good.tolist(), *odd])], "i long, samples array<double>")
    found = rows.withColumn("z", A.dft(F.col("samples"), 64))
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: r["z"] for r in found.collect()}
    cos, sin = (np.array([f(2 * math.pi * i / 64) for i in range(64)]) for f in (math.cos, math.sin))
    for i in (0, 1023, 1024, 2999):
        for k, z in enumerate(got[i]):
            re = im = 0.0
            for j, x in enumerate(good[i].tolist()):
                re, im = re + x * float(cos[j * k % 64]), im + x * float(sin[j * k % 64])
            assert (z["re"], z["im"]) == (re, -im)
    assert all(len(got[3000 + i]) == 33 and all(z["re"] is None and z["im"] is None for z in got[3000 + i]) for i in range(len(odd)))
    long = spark.createDataFrame([(rng.standard_normal(1000).tolist(),)], "samples array<double>").select("samples", A.dft(F.col("samples"), 1000).alias("z")).first()
    assert np.allclose([complex(z["re"], z["im"]) for z in long["z"]], np.fft.rfft(long["samples"]))


def test_comb_gaps_and_missing_samples(spark):
    # every earlier sample of the chain echoes, weakened by its distance; missing samples, rows and signals do not
    rng = np.random.default_rng(3)
    rows = [(s, n, None if rng.random() < 0.2 else float(rng.standard_normal()), f"{s}-{n}") for s in (0, 1, None) for n in range(300) if rng.random() < 0.8]
    given = spark.createDataFrame(rows, "signal_id long, n long, value double, tag string").repartition(7)
    for lag, feedback in ((1, 0.9), (3, -0.5), (5, 0.0)):
        found = effects.comb(given, lag, feedback, 0.5, 0.7)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "Join" not in plan and found.columns == given.columns
        got = {r["tag"]: r["value"] for r in found.collect()}
        assert len(got) == len(rows)
        for s, n, v, tag in rows:
            echo = sum(feedback ** ((n - m) // lag - 1) * x for t, m, x, _ in rows if t == s is not None and x is not None and m < n and (n - m) % lag == 0)
            assert got[tag] is None if v is None else abs(got[tag] - (0.7 * v + 0.5 * echo)) < 1e-9
