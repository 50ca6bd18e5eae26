"""Packing: round trip of the ids, capacity, gapless offsets, few sequences, odd rows."""

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from brinewave.llm import packing
from brinewave.llm.common import cut

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string"


def ids_of(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, got, limit):
    tok = Tokenizer.from_file(PATH)
    want = sorted((str(i), k, s, len(ids[s : s + limit]), zlib.crc32(np.array(ids[s : s + limit], "<u4").tobytes())) for i, t, *_ in rows for ids in [ids_of(tok, t)] for k, s in enumerate(range(0, len(ids), limit)))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences), math.ceil(sum(w[3] for w in want) / limit)


def test_round_trip(spark):
    odd = [None, "", "It's <|endoftext|> É é  x　y \x1c z \x85q", "İSTANBUL ΣΑΣ ﬁ", "日本語 1234 a b", "word " * 900, "don't we'll 'S o'clock", "́ leading mark"]
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect()]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(odd + docs)] + [(7, "same", None)] * 5
    df = spark.createDataFrame(rows, SCHEMA)
    used, least = check(rows, packing.report(df, PATH, limit=128, shard_rows=40).collect(), 128)
    assert used <= least + 2


def test_empty_table(spark):
    assert packing.report(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_bred_packings_are_whole_and_near_the_least():
    rng = np.random.default_rng(0)
    for seed in range(10):
        sizes = [int(x) for x in rng.integers(1, 600, 90)]
        plain = packing.Packing(sizes, 1000).fit(rng.permutation(90).tolist())
        bins, made = packing.breed(sizes, 1000, seed, [], generations=60)
        fill = np.bincount(bins, sizes)
        assert len(bins) == 90 and fill.max() <= 1000 and len(fill) <= len(plain.bins) and made >= 1
        assert len(fill) == math.ceil(sum(sizes) / 1000) or made == 60
        assert packing.breed(sizes, 1000, seed, [], generations=60) == (bins, made)


def test_one_crossover_at_least():
    assert packing.breed([5], 10, 1, [])[1] == packing.breed([5, 5, 5], 10, 1, [[0, 0, 1]])[1] == 1


def test_every_shard_of_the_tables_is_bred(spark):
    rows = packing.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH).toPandas()
    short = rows[rows.length < 4096]
    assert len(short) and (short.generations >= 4).all()  # two islands, two epochs
    assert rows.sequence_id.nunique() <= math.ceil(rows.length.sum() / 4096) + 1


def test_mutation_keeps_every_item_once():
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 60, 80)]
    a = packing.Packing(sizes, 100).fit(list(range(80)))
    for _ in range(20):
        a = packing.mutate(a, rng)
        assert sorted(i for own in a.bins for i in own) == list(range(80))
        assert a.room == [100 - sum(sizes[i] for i in own) for own in a.bins] and min(a.room) >= 0


def test_other_tokenizers_get_whole_texts(spark):
    other = public_tokenizers.path("byte_bpe_50k.json")
    with open(other) as f, open(PATH) as g:
        assert not packing.by_letter_runs(f.read()) and packing.by_letter_runs(g.read())
    rows = spark.createDataFrame([(1, "Some  words\there, don't", None), (2, None, None)], SCHEMA)
    with open(other) as f:
        got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in cut(packing.pieces(rows, f.read(), with_ids=True), "t").collect()}
    assert got == {i: ids_of(Tokenizer.from_file(other), t) for i, t, _ in rows.collect()}


def test_a_very_long_text(spark):
    rows = [(1, "word and, others 12 " * 100_000, None), (2, "x", None)]
    used, least = check(rows, packing.report(spark.createDataFrame(rows, SCHEMA), PATH).collect(), 4096)
    assert used == least


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 60, 80)]
    a = packing.Packing(sizes, 100).fit(list(range(80)))
    b = packing.Packing(sizes, 100).fit(list(range(79, -1, -1)))
    child = packing.cross(a, b, rng)
    assert sorted(i for own in child.bins for i in own) == list(range(80))
    assert child.room == [100 - sum(sizes[i] for i in own) for own in child.bins] and min(child.room) >= 0


def test_ids_come_back(spark):
    rows = spark.createDataFrame([(1, "some words here", None)], SCHEMA)
    with open(PATH) as f:
        got = cut(packing.pieces(rows, f.read(), with_ids=True), "t").first()
    assert np.frombuffer(got["ids"], "<u4").tolist() == ids_of(Tokenizer.from_file(PATH), "some words here")


def test_ids_of_strings_that_are_not_met_again_are_forgotten():
    tok = Tokenizer.from_file(PATH)
    seen = packing.Ids(tok, most=1_000)
    for k in range(20):
        texts = [" ".join(f"{w}x{k}, Often" for w in range(i, i + 50)) for i in range(0, 1_000, 50)]
        got = [np.frombuffer(d, "<u4").tolist() for d in seen.encode(pa.array([*texts, None, " often,\x1cof't "]))]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in [*texts, "", " often,\x1cof't "]]
        assert len(seen.runs.young) + len(seen.runs.old) <= 2 * (1_000 + 1_100)
        assert "often" in seen.runs.young or "often" in seen.runs.old


def test_plain_runs_go_to_the_model_at_once():
    tok = Tokenizer.from_file(PATH)
    met = []

    class Counted:
        model, pre_tokenizer = tok.model, tok.pre_tokenizer

        def encode_batch_fast(self, runs, **how):
            met.extend(runs)
            return tok.encode_batch_fast(runs, **how)

    rng = np.random.default_rng(3)
    letters = [c for c in packing.LETTERS for _ in range(20 if c in "aeinorst" else 1)]
    words = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 30, 2_000)]
    texts = [" ".join(words), "ÀÉÎÕÜ ß ÿ ÷ × µ ª º é e\u0301 ﬁ Ω ıİ", "don't L'été, ça?! x2y a-b", "x" * 700, "é" * 700]
    seen = packing.Ids(Counted())
    got = [np.frombuffer(d, "<u4").tolist() for d in seen.encode(pa.array(texts))]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(met).isdisjoint(w.lower() for w in words) and "e\u0301" in met


def test_ranges_of_texts_are_whole_and_bounded():
    texts = pa.array(["x" * 30, None, "", "y" * 500, "z" * 40, "z" * 60])
    ranges = list(packing.by_bytes(texts, 100))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(6)) and len(ranges) > 2
    assert list(packing.by_bytes(pa.array([None, "a"]), 100)) == [(0, 2)]


def test_a_worker_gets_few_texts_at_once(spark, monkeypatch):
    docs = spark.range(0, 12, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 200000 + id) AS text")
    sizes = []

    def met(df, name):
        if name == "pieces":
            run = lambda batches: (pa.RecordBatch.from_pydict({"size": [b.nbytes]}) for b in batches)
            sizes.extend(r["size"] for r in docs.mapInArrow(run, "size long").collect())
        return cut(df, name)

    monkeypatch.setattr(packing, "cut", met)
    assert packing.report(docs, PATH).select("doc_id").distinct().count() == 12
    assert sum(sizes) > 12_000_000 and max(sizes) < 6_000_000
