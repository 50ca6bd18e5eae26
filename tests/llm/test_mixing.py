"""Mixing: targets by brute force, balance of the cube method, odd rows."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brinewave.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def targets(sizes: dict, weights: dict, total: float, cap: float = 3.0) -> dict:
    """The share of ``total`` by weight, no source above ``cap`` times its size, the excess reshared."""
    left, free, out = float(total), set(sizes), {}
    while free:
        whole = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / whole > cap * sizes[s]]
        if not over:
            out.update({s: left * weights[s] / whole for s in free})
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def cycle_weights(sources: list, pattern: tuple = (5.0, 2.0, 1.0)) -> dict:
    """Weights repeating over the sources by code point, null last."""
    order = sorted((s for s in sources if s is not None)) + [None] * (None in sources)
    return {s: pattern[i % len(pattern)] for i, s in enumerate(order)}


@settings(max_examples=200, database=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    per = {f"s{i}": n for i, n in enumerate(sizes)}
    w = cycle_weights(list(per))
    got = targets(per, w, sum(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes)) and all(got[s] <= 3 * per[s] + 1e-6 for s in per)
    free = [s for s in per if got[s] < 3 * per[s] - 1e-6]
    if free:
        rate = max(got[s] / w[s] for s in free)
        assert all(got[s] == pytest.approx(min(3 * per[s], rate * w[s]), abs=1e-6) for s in per)


def test_order_of_sources():
    assert cycle_weights(["b", None, "a", "B"]) == {"B": 5.0, "a": 2.0, "b": 1.0, None: 5.0}


def test_flight_keeps_balance_and_expectation():
    rng = np.random.default_rng(2)
    size, p = rng.integers(0, 500, 300).astype(float), np.full(300, 0.3)
    total = np.zeros(300)
    for seed in range(400):
        q = mixing.fly(size, p, seed)
        open_ = (q > 1e-9) & (q < 1 - 1e-9)
        assert open_.sum() <= 2 and q @ size == pytest.approx(p @ size) and q.sum() == pytest.approx(p.sum())
        total += q
    assert np.abs(total / 400 - 0.3).max() < 0.12


def brute_check(rows, got):
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((i, len((t or "").encode().split())) for i, t, *_ in rows if i is not None)
    per, n = Counter(), Counter()
    for i, t, s, *_ in rows:
        per[s] += len((t or "").encode().split())
    aims = targets(dict(per), cycle_weights(list(per)), sum(per.values()))
    took = Counter()
    for r in got:
        assert r["source_size"] == per[r["source"]] and r["target"] == pytest.approx(aims[r["source"]])
        assert r["taken"] <= 3 * r["size"] and (r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0)
        took[r["source"]] += r["taken"]
    return {s: abs(took[s] - aims[s]) for s in per}


def test_mix(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), f"s{min(i % 11, 6)}", "x", 1) for i in range(1500)]
    rows += [(2000, None, None, None, None), (2001, "", "s0", None, None), (None, "a\x0bb c", None, None, None), (2002, "only one", None, None, None)] + [(5, rows[5][1], "s5", "x", 1)] * 6
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, block_rows=40).collect()
    off = brute_check(rows, got)
    assert max(off.values()) <= 60
    again = mixing.mix(df.repartition(7), block_rows=40).collect()
    key = lambda rs: sorted(map(str, ((r["doc_id"], r["size"], r["taken"]) for r in rs)))
    assert key(again) == key(got)
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    taken = mixing.take(df, block_rows=40)
    assert taken.columns == df.columns and Counter(r["doc_id"] for r in taken.collect()) == +want


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).collect() == [] and mixing.take(none).collect() == []


def test_take_with_clashing_names_and_a_map(spark):
    names = ["_k1", "_k2", "_m", "_copies", "_copy", "_h1", "_h2", "_p", "_key", "size", "target", "copies", "_c3"]
    df = spark.createDataFrame([(i, "w " * (i + 1), f"s{i % 2}", *names, {"k": i}) for i in range(40)], ["doc_id", "text", "source", *names, "map"])
    rows = {r["doc_id"]: r for r in df.collect()}
    for most in (100, 0):
        got = mixing.take(df, broadcast_rows=most)
        assert got.dtypes == df.dtypes
        found = got.collect()
        assert all(r == rows[r["doc_id"]] for r in found)
        assert abs(len(found) - 40) < 40 and {r["source"] for r in found} == {"s0", "s1"}


def test_taken_words_come_near_their_targets(spark):
    rows = mixing.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    per = rows.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert ((per.taken - per.target).abs() <= 0.01 * per.target).all(), per


def test_many_sources(spark):
    rows = [(i, "w " * (1 + i % 90), f"s{i % 700:04d}" if i % 701 else None, "x", 1) for i in range(5000)]
    off = brute_check(rows, mixing.mix(spark.createDataFrame(rows, SCHEMA), broadcast_rows=0).collect())
    assert max(off.values()) <= 90 and len(off) == 701
