"""The Jaccard join against all pairs."""

from collections import defaultdict

import numpy as np
import pytest

from brinewave.llm import simjoin

SCHEMA = "doc_id long, text string, lang string, label string"


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k, percent):
    sets = [shingle_set(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return sorted(((r[0], len(s), min(least[find(i)], default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n_groups=14, big=40, vocab=300):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(vocab)]
    passage = " ".join(rng.choice(words, 40))
    rows, i = [], 0
    for g in range(n_groups):
        base = list(rng.choice(words, int(rng.choice([1, 2, 4, 8, 15, 25, 60, 150, 300]))))
        for _ in range(big if g == 0 else int(rng.integers(1, 9))):
            own = list(base if g else words[:200])
            for _ in range(int(rng.integers(0, 1 + max(1, len(own) // 12)))):
                own[int(rng.integers(len(own)))] = str(rng.choice(words)).upper()
            text = " ".join(own) + ("\n" + passage if rng.random() < 0.2 else "")
            rows.append((i, text, "en", "x"))
            i += int(rng.integers(1, 4))
    odd = [(None, rows[3][1], None, None), (5000, None, None, None), (5001, "", None, None), (5001, " \n", None, None), (5002, "one", None, None), (5003, "ONE", None, None), (5004, "é É", None, None), rows[4], rows[4]]
    return rows + odd + [(6000 + k, passage, None, None) for k in range(12)]


@pytest.mark.parametrize(("k", "percent", "how"), [(3, 90, {}), (5, 80, {"bits": 8, "groups": 4}), (2, 80, {"bits": 6, "groups": 8, "rounds": 1}), (3, 70, {"rounds": 0, "broadcast_rows": 0})])
def test_against_all_pairs(spark, monkeypatch, k, percent, how):
    monkeypatch.setattr(simjoin, "classes", lambda counts, real=simjoin.classes: (real(counts)[0], 6) if "bits" in how else real(counts))
    rows = corpus(percent + k)
    got = simjoin.report(spark.createDataFrame(rows, SCHEMA).repartition(3), k, percent, **how).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in got), key=str) == brute(rows, k, percent)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        percent, groups = int(rng.choice([60, 80, 90])), int(rng.choice([2, 4, 9]))
        rank = (rng.random(64) < rng.choice([0.1, 0.6, 1.0])).astype(np.uint8) * rng.integers(1, 4, 64).astype(np.uint8)
        kind = lambda s: rank[(s >> np.uint64(58)).astype(np.int64)]  # noqa: E731,B023
        n = int(rng.integers(1, 80))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        drop = int(rng.integers(0, 1 + len(x) // 5))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(x) // 8))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= percent * (len(x) + len(y) - both):
            a, b = (simjoin.signatures(s, kind(s), 1, percent, groups) for s in (x, y))
            assert len(np.intersect1d(a, b)), (percent, groups, len(x), len(y), both)
            limit = len(x) + len(y) - 2 * -(-percent * (len(x) + len(y)) // (100 + percent))
            differ = np.unpackbits((simjoin.bitmap(x) ^ simjoin.bitmap(y)).view(np.uint8)).sum()
            assert differ <= len(x) + len(y) - 2 * both <= limit


def test_signatures_stay_near_the_prefix():
    rng = np.random.default_rng(1)
    for n in (3_000, 20_000, 65_535, 100_000, 1_000_000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        for percent in (80, 90):
            prefix = len(x) - simjoin.least_overlap(len(x), percent) + 1
            assert len(simjoin.signatures(x, np.full(len(x), 9, np.uint8), 1, percent, 32)) <= 5 * prefix


def test_bitmaps_fold():
    x = np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64)
    large, small = simjoin.bitmap(x, 4096), simjoin.bitmap(x, 512)
    assert (simjoin.by_size([large.view(np.uint64), small.view(np.uint64)])[8] == small.view(np.uint64)).all()


def near_group(m, n=220, edits=14, seed=3):
    """Copies of one text, each with edits of its own: near the limit of 90 %, most pairs below it."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(n)]
    rows = []
    for i in range(m):
        own = list(base)
        for k in rng.choice(n, int(rng.integers(0, edits)), replace=False):
            own[int(k)] = f"x{rng.integers(10**9)}"
        rows.append((i, " ".join(own), None, None))
    return rows


def test_a_large_group_of_near_copies_below_the_limit(spark, monkeypatch):
    sent = []
    for name in ("chains", "linked_members"):
        def counted(rows, percent, real=getattr(simjoin, name)):
            out = simjoin.cut(real(rows, percent), "counted")
            sent.append((out.count(), rows.count()))
            return out
        monkeypatch.setattr(simjoin, name, counted)
    rows = near_group(2000)
    got = simjoin.report(spark.createDataFrame(rows, SCHEMA).repartition(4), 3, 90).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == fast_brute(rows, 3, 90)
    assert all(out <= members for out, members in sent)


def fast_brute(rows, k, percent):
    sets = [shingle_set(r[1], k) for r in rows]
    names = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    have = np.zeros((len(rows), len(names)), np.float32)
    for i, s in enumerate(sets):
        have[i, [names[x] for x in s]] = 1
    both, n = have @ have.T, have.sum(axis=1)
    linked = 100 * both >= percent * (n[:, None] + n[None] - both)
    label = np.arange(len(rows))
    while True:
        new = np.array([label[linked[i]].min() for i in range(len(rows))])
        if (new == label).all():
            return [(r[0], len(s), int(label[i])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]
        label = new


def test_names_that_different_sets_share_are_settled(spark, monkeypatch):
    real = simjoin.node_of
    monkeypatch.setattr(simjoin, "node_of", lambda s: (real(s)[0] % 7, *real(s)[1:]))
    rows = corpus(5)
    got = simjoin.report(spark.createDataFrame(rows, SCHEMA), 3, 80).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in got), key=str) == brute(rows, 3, 80)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(200 + i, 201 + i) for i in range(40)] + [(300, i) for i in range(301, 340)]
    got = {r["node"]: r["root"] for r in simjoin.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}


def test_distinct(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = simjoin.distinct(df, 3, 80)
    assert got.columns == df.columns
    want = {c for _, n, c in brute(rows, 3, 80) if n}
    kept = got.collect()
    full = [r for r in kept if shingle_set(r["text"], 3)]
    assert sorted(r["doc_id"] for r in full) == sorted(want) and len(kept) - len(full) == 3


def test_distinct_with_clashing_names_and_a_map(spark):
    names = ["_k1", "_k2", "_m", "_one", "_again", "n", "node", "label", "sig", "_c1"]
    rows = [(i, "one two three four" if i < 3 else f"other words here {i}", *names, {"k": i % 2}) for i in (0, 1, 2, 2, 3, 4)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names, "map"])
    for most in (10, 0):
        got = simjoin.distinct(df, 3, 80, broadcast_rows=most)
        assert got.dtypes == df.dtypes and sorted(map(str, got.collect())) == sorted(map(str, (r for r in df.collect()[:1] + df.collect()[4:])))
    again = simjoin.distinct(df.filter("doc_id = 2 or doc_id = 3"), 3, 80).collect()
    assert sorted(r["doc_id"] for r in again) == [2, 3]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simjoin.report(none).collect() == [] and simjoin.distinct(none).collect() == []
