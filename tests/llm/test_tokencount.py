"""Token counts against a unigram tokenizer library and against all paths."""

import itertools

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from brinewave.llm import tokencount as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    pieces = tc.vocabulary(PATH)
    low = min(pieces.values())
    vocab = [("<unk>", low), *pieces.items(), *((f"<0x{b:02X}>", low) for b in range(256))]
    return tc.Counter(pieces), Tokenizer(Unigram(vocab, unk_id=0, byte_fallback=True))


def same(library, text):
    counter, tok = library
    want = len(tok.encode(tc.SPACE + text.replace(" ", tc.SPACE)).tokens) if text else 0
    assert counter.count(text)[0] == want, text


def test_against_the_library(library, spark):
    for text in ["", "a", "Hello  world\n\tx é 😀 ½ ", "    four", "line\r\nline", "▁▁x", "日本語 текст", "a" * 500, "the " * 3000, "\n\n\n"]:
        same(library, text)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect():
        same(library, r["text"])


@settings(max_examples=300, database=None, deadline=None)
@given(st.text(alphabet="abcdetion \n\t.é😀▁XQ0", max_size=40))
def test_random_texts(library, text):
    same(library, text)


def test_against_all_paths():
    pieces = {"a": -1.0, "b": -2.0, "ab": -3.0, "ba": -2.0, "aba": -3.0, tc.SPACE: -1.0, tc.SPACE + "a": -2.0}
    counter = tc.Counter(pieces)
    for n in range(1, 7):
        for text in map("".join, itertools.product("ab", repeat=n)):
            full = tc.SPACE + text

            def paths(i):
                if i == len(full):
                    yield ()
                for j in range(i + 1, len(full) + 1):
                    if full[i:j] in pieces:
                        yield from ((full[i:j], *p) for p in paths(j))

            best = max(sum(pieces[x] for x in p) for p in paths(0))
            got, score = counter.count(text)
            assert score == best and got in {len(p) for p in paths(0) if sum(pieces[x] for x in p) == best}


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (None, "Hello world", None), (3, "Hello world", None), (3, "Hello world", None), (4, "word " * 100000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in tc.counts(df, PATH).collect()), key=str)
    hello, long = (tc.Counter(tc.vocabulary(PATH)).count(t)[0] for t in ("Hello world", "word " * 100000))
    assert hello == 6 and got == sorted([(1, 0), (2, 0), (None, hello), (3, hello), (3, hello), (4, long)], key=str)
    assert tc.counts(df.limit(0), PATH).collect() == []
