"""Toxicity: the risk estimator, odd rows, held-out accuracy."""

import tracemalloc

import numpy as np
import pytest

from brinewave.llm import toxicity

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def test_fit_recovers_a_separating_direction():
    rng = np.random.default_rng(0)
    toxic = lambda n: rng.normal([1.5, 0], 0.4, (n, 2))
    clean = lambda n: rng.normal([-1.5, 0], 0.4, (n, 2))
    w, b = toxicity.fit(toxic(200), np.vstack([toxic(100), clean(900)]), 0.1)
    model = toxicity.Model({7: 0, 9: 1}, w, b)
    assert (model.score(toxic(200)) > 0.5).mean() > 0.97 and (model.score(clean(200)) < 0.5).mean() > 0.97


def brute_risk(w, b, xp, xu, prior, l2):
    """The three terms of the risk, row by row: positives as toxic, unlabelled as clean, positives as clean."""
    loss = lambda f, y: np.log1p(np.exp(-f)) if y else np.log1p(np.exp(f))
    mean = lambda rows, y: sum(loss(float(r @ w + b), y) for r in rows) / len(rows)
    return prior * mean(xp, 1), mean(xu, 0) - prior * mean(xp, 0), l2 / 2 * float(w @ w)


@pytest.mark.parametrize("sign", [1, -1])
def test_a_step_follows_the_risks_gradient(sign):
    # one step of Adam moves every weight by the rate against the sign of its gradient
    rng = np.random.default_rng(8)
    xp, xu, prior, l2, h = rng.normal(0.4, 1, (12, 5)), rng.normal(0, 1, (30, 5)), 0.3, 1e-3, 1e-6
    if sign < 0:
        prior = 1.5  # at the start both losses are log 2: the bracket is negative for a prior above 1
    zero = np.zeros(6)
    terms = lambda v: brute_risk(v[:-1], v[-1], xp, xu, prior, l2)
    gain, rest, flat = terms(zero)
    assert (rest >= 0) == (sign > 0)
    goal = (lambda v: sum(terms(v))) if sign > 0 else (lambda v: -terms(v)[1] + terms(v)[2])
    grad = np.array([(goal(zero + h * e) - goal(zero - h * e)) / (2 * h) for e in np.eye(6)])
    w, b = toxicity.fit(xp, xu, prior, l2=l2, steps=1, rate=0.05)
    assert np.append(w, b) == pytest.approx(-0.05 * np.sign(grad), abs=1e-5)


def test_risk_stays_non_negative():
    # few positives, many parameters: without the correction the bracket falls far below zero
    rng = np.random.default_rng(1)
    xp, xu = rng.normal(size=(10, 200)), rng.normal(size=(60, 200))
    w, b = toxicity.fit(xp, xu, 0.3, l2=0, steps=600)
    corrected = brute_risk(w, b, xp, xu, 0.3, 0)[1]
    w, b = plain_fit(xp, xu, 0.3, 600)
    assert corrected > -0.1 and brute_risk(w, b, xp, xu, 0.3, 0)[1] < 10 * min(corrected, -0.01)


def plain_fit(xp, xu, prior, steps, rate=0.05):
    """Gradient steps on the risk without the correction."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    w, b = np.zeros(xp.shape[1]), 0.0
    for _ in range(steps):
        fp, fu = xp @ w + b, xu @ w + b
        a, c = -prior * np.ones(len(fp)) / len(fp), sigmoid(fu) / len(fu)
        w, b = w - rate * (xp.T @ a + xu.T @ c), b - rate * (a.sum() + c.sum())
    return w, b


def test_clashing_names(spark):
    docs, labels = table(spark)
    wide = docs.selectExpr("doc_id", "text", "score", "'a' as _score", "1 as _u", "2 as held_out", "map('k', 1) as m", "3 as _c2")
    got = toxicity.clean(wide, labels)
    assert got.dtypes == wide.dtypes and {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in toxicity.clean(docs, labels).collect()}
    assert {r["_score"] for r in got.collect()} == {"a"}


def table(spark):
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}{c}" for a in ("ra", "lo", "mi", "te") for b in ("ba", "no", "lu") for c in ("m", "st", "ne")]
    bad = ["grubling", "grublast", "snarkle"]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(vocab, 60))
        if i % 4 == 0:
            words[::12] = rng.choice(bad, 5)
        rows.append((i, " ".join(words), "clash"))
        if i % 3 == 0:
            labels.append((i, 1, int(i % 4 == 0)))
    return spark.createDataFrame(rows + [(900, None, None), (901, "", None), (None, "grubling snarkle Grublast", None), (902, "lobam " * 30000, "x")], DOCS), spark.createDataFrame([*labels, (None, 0, None), (7, None, None)], LABELS)


def test_scores_and_odd_rows(spark):
    docs, labels = table(spark)
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 404
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == (i % 4 == 0) for i in range(400)) and by[None]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert by[900]["score"] == by[901]["score"] < 0.5 and by[902]["predicted"] == 0
    again = {r["doc_id"]: r["score"] for r in toxicity.report(docs.repartition(5), labels).collect()}
    assert again == pytest.approx({k: r["score"] for k, r in by.items()}, abs=1e-9)
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in by if by[i]["predicted"] == 0}
    assert {r["score"] for r in kept.collect()} == {"clash", None, "x"}


def test_nothing_to_learn(spark):
    none, empty = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert toxicity.report(none, empty).collect() == []
    got = toxicity.report(spark.createDataFrame([(1, "words", None)], DOCS), empty).first()
    assert (got["score"], got["predicted"]) == (0.0, 0)


def test_held_out_accuracy(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    got = toxicity.report(read("documents"), read("labels")).filter("held_out").join(read("labels"), "doc_id").toPandas()
    assert got[got.toxic == 0].predicted.mean() < 0.1 and got[got.toxic == 1].predicted.mean() > 0.5


def test_learning_holds_little_at_once(spark):
    # the driver's memory: samples are counted text by text, not held as counts of all their words
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = [(i, " ".join(map("".join, rng.choice(letters, (700, 7))))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], LABELS)
    tracemalloc.start()
    try:
        model = toxicity.learn(docs, labels)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert len(model.index) == 1000 and peak < 60
