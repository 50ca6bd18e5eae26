"""Fingerprints against a brute-force version."""

import hashlib
import re
import unicodedata

import xxhash

from brinewave.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string"


def canonical(text):
    n = unicodedata.normalize
    return re.sub(r"\s+", " ", n("NFKC", n("NFKC", text).casefold())).strip(" ")


def digest(c):
    b = c.encode()
    seed = xxhash.xxh64(b"brinewave", seed=42).intdigest()
    # a chain of hashes: the second takes the first one's value for its seed
    return f"{xxhash.xxh64(b, seed=42).intdigest():016x}{xxhash.xxh64(b, seed=seed).intdigest():016x}"


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        c, ce, cn = map(canonical, (text, edited, after))
        out.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(c), digest(ce), float(c == ce), float(c == cn)))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def report(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r[c] for c in COLUMNS) for r in fp.fingerprint_report(df).collect()), key=str)


def test_against_brute_force(spark):
    texts = ["", None, "a", "Ab  c d", "ab c d", "ﬁne STRASSE", "fine straße ", "été", "été", "x" * 9000, "\U0001f600 smile", "same", "same", "Same\n"]
    rows = [(3 * i if i != 4 else None, t, None, "s", 0, "clash") for i, t in enumerate(texts)] + [(33, "same", None, None, 1, None)] * 2
    assert report(spark, rows) == brute(rows)


def test_many_ranges(spark, monkeypatch):
    rows = [((i * 7919) % 1000, f"text {i % 13} {'word ' * (i % 5)}", "en", "s", 0, None) for i in range(400)]
    whole = fp.with_next
    monkeypatch.setattr(fp, "with_next", lambda df: whole(df, per_bucket=7))
    assert report(spark, rows) == brute(rows)


def test_groups_and_clashes(spark, monkeypatch):
    df = spark.createDataFrame([(1, "One", None, None, 0, None), (2, "one ", None, None, 0, None), (3, "two", None, None, 0, None)], SCHEMA)
    got = {r["doc_id"]: r for r in fp.fingerprint_report(df).collect()}
    assert [got[i]["group_doc_id"] for i in (1, 2, 3)] == [1, 1, 3] and [got[i]["n_copies"] for i in (1, 2, 3)] == [2, 2, 1]
    from pyspark.sql import functions as F

    monkeypatch.setattr(fp, "digest", lambda c: F.lpad(F.hex(F.length(c)), 32, "0"))
    got = {r["doc_id"]: r for r in fp.fingerprint_report(df).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]


def test_empty_and_single(spark):
    assert report(spark, []) == []
    assert report(spark, [(5, "alone", None, None, 0, None)]) == brute([(5, "alone", None, None, 0, None)])
