"""Language identification: Viterbi against all paths, mixed texts, odd rows, held-out accuracy."""

import itertools
import zlib

import numpy as np
import pytest

from brinewave.llm import langid

SCHEMA = "doc_id long, text string, lang string, spans string"
TEXTS = {
    "en": "the old house by the river was quiet and the children were playing with their friends in the garden",
    "de": "das alte haus am fluss war ruhig und die kinder spielten mit ihren freunden im garten und auf der wiese",
    "ru": "старый дом у реки был тихим и дети играли со своими друзьями в саду и на лугу",
}


def rows(n=60):
    return [(i, " ".join(np.random.default_rng(i).permutation(TEXTS[k].split())), k, None) for i, k in zip(range(n), itertools.cycle(TEXTS))]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        for _ in range(40):
            s, penalty = -rng.random((n, 3)).astype(np.float32) * 8, float(rng.uniform(0, 8))
            value = lambda p: sum(float(s[i, x]) for i, x in enumerate(p)) - penalty * sum(a != b for a, b in itertools.pairwise(p))  # noqa: E731,B023
            best = max(map(value, itertools.product(range(3), repeat=n)))
            assert value(langid.viterbi(s, penalty)) == pytest.approx(best, abs=1e-4)


def test_spans_of_mixed_text(spark):
    model = langid.learn(spark.createDataFrame(rows(), SCHEMA))
    assert model.langs == ["de", "en", "ru"]
    text = f"{TEXTS['en']} {TEXTS['de']} {TEXTS['ru']}"
    got = langid.identify(spark.createDataFrame([(1, text, None, "clash")], SCHEMA), model).first()
    assert [s["lang"] for s in got["spans"]] == ["en", "de", "ru"]
    assert abs(got["spans"][1]["start"] - len(TEXTS["en"]) - 1) <= 12 and text[got["spans"][2]["start"] :].startswith("старый")
    assert 0.3 < got["score"] < 0.6


def test_odd_rows_and_held_out(spark):
    odd = [(100, None, "en", "x"), (101, "", None, None), (102, "12 34 ½ ___ !!", "en", None), (None, "the house", None, None), (103, TEXTS["de"] * 2000, "de", None)]
    df = spark.createDataFrame(rows() + odd + [odd[0]], SCHEMA)
    got = langid.report(df).collect()
    assert len(got) == 66
    by = {r["doc_id"]: r for r in got}
    for i in (100, 101, 102):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["spans"]) == ("und", 0.0, [])
    assert by[None]["lang_pred"] == "en" and by[103]["lang_pred"] == "de" and by[103]["score"] == 1.0
    for r in rows():
        assert by[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) and by[r[0]]["lang_pred"] == r[2]


def test_nothing_to_learn(spark):
    assert langid.report(spark.createDataFrame([], SCHEMA)).collect() == []
    got = langid.report(spark.createDataFrame([(1, "some words", None, None)], SCHEMA)).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
