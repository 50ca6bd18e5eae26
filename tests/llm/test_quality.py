"""Quality rules against a brute-force version."""

import re
from collections import Counter

import numpy as np

from brinewave.llm import quality

DOCS = "doc_id long, text string, quality string"
LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def table(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(vocab, int(n))) for n in rng.integers(0, 200, 40)]
    texts += [None, "", " \n\t ", "a b c d e f g h " * 40, "one line\none line\n\none line\r\n", "x" * 100000, "é ü   w\x0bv #*$", " ".join(vocab[:10]) + "\n" + " ".join(vocab[:10])]
    texts += [" ".join(f"{w} ||| $$$" for w in rng.choice(vocab, 60)) for _ in range(10)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], None), (0, texts[0], "clash")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(3, 1, 1), (None, None, None), (49, 0, 0), (999, 1, 0)], LABELS)
    return rows, docs, labels


def test_against_brute_force(spark):
    rows, docs, labels = table(spark)
    got = quality.report(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    tokens = {i: re.findall(r"\w+|[^\w\s]+", " ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")).lower()) for i, t, _ in rows}
    for i, t, _ in rows:
        r, b = by[i], brute(t)
        assert tuple(r[n] for n in quality.NAMES) == b, t
        assert r["base_failed"] == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= -0.25)
        if not tokens[i]:
            assert r["score"] == 0.0
    assert max(by[i]["score"] for i in range(48, 58)) < min(by[i]["score"] for i in range(30)) - 0.5


def test_ratio_of_counts(spark):
    rows, docs, labels = table(spark)
    counts = quality.count(docs, labels)
    seen, want = quality.Tokens(), np.zeros((2, 1 << quality.BITS))
    for i, t, _ in rows:
        b = np.bincount(quality.buckets((t or "").encode().split(), seen), minlength=1 << quality.BITS)
        want[0] += b
        want[1] += b * (i is not None and i < 30)
    assert (counts == want).all()
    assert (quality.count(docs, labels, broadcast_rows=1) == want).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality.report(none, spark.createDataFrame([], LABELS)).collect() == []
    got = quality.report(spark.createDataFrame([(1, "word " * 30, None)], DOCS), spark.createDataFrame([], LABELS)).first()
    assert got["score"] == 0.0 and got["base_failed"] and not got["kept"]
