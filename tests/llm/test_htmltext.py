"""Main text: decoding against all paths, blocks of odd markup, held-out pages, the given pages."""

import html
import itertools
import re

import numpy as np
import pytest

from brinewave.llm import htmltext as ht


@pytest.fixture(scope="module")
def chain():
    return ht.learn()


def test_decode_against_all_paths():
    rng = np.random.default_rng(0)
    for n in range(0, 8):
        chain = ht.Chain(rng.normal(size=len(ht.NAMES)), rng.normal(size=(2, 2)), rng.normal(size=2))
        rows = [list(rng.choice(len(ht.NAMES), 4, replace=False)) for _ in range(n)]
        value = lambda p: (chain.first[p[0]] if p else 0) + sum(chain.weights[rows[i]].sum() * x for i, x in enumerate(p)) + sum(chain.pairs[a, b] for a, b in itertools.pairwise(p))  # noqa: E731,B023
        assert value(chain.decode(rows)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=n))))


def test_training_learns_labels():
    f = ht.ID["in:article"], ht.ID["in:nav"]
    pages = [([[f[i % 2]] for i in range(k, k + 6)], [1 - i % 2 for i in range(k, k + 6)]) for k in range(8)]
    chain = ht.train(pages, steps=120)
    assert chain.decode(pages[0][0]) == pages[0][1] and chain.decode(pages[1][0]) == pages[1][1]


def texts(page):
    return [t for t, _ in ht.blocks(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>c\n\n d<p>e<br>f<div>g</div>h &amp; i &#233; &nbsp;j</p>") == ["a bc d", "e f", "g", "h & i é j"]
    assert texts("x < y <3 <!-- no <p> --> z <!doctype q> w <script>if (a</p>b) {}</SCRIPT>v<style>p</style>") == ["x < y <3 z w v"]
    assert texts("<ul><li>one<li>two<ul><li>in</ul><li>three</ul><table><tr><td>a<td>b<tr><th>c</table>") == ["one", "two", "in", "three", "a", "b", "c"]
    assert texts('<div title="a > b">x</div><p title=\'"\'>y</p></p></nav><textarea>t</textarea><title>T</title>z') == ["x", "y", "z"]
    assert texts("<p") == [] and texts("<p>a<!-- open") == ["a"] and texts("<a href='x>y") == ["y"] and texts("<script>x") == []
    assert texts("<noscript>n</noscript><select><option>o</select><button>b</button>k") == ["k"]
    assert texts("<html><head><title>T</title><meta x><body><p>a") == ["a"] and texts("<head><script>1</script>b<p>c") == ["b", "c"]
    assert texts("a<!-->b<!-- c -->d") == ["abd"]
    assert len(texts("<div>" * 20000 + "deep")) == 1 and len(texts("<p>w" * 30000)) == 30000


def test_formulas_and_objects_give_text(chain):
    texts = lambda page: [t for t, _ in ht.blocks(page)]
    assert texts("<p>so <math><semantics><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow><annotation>a=2</annotation></semantics></math> holds.</p>") == ["so a=2 holds."]
    found = ht.blocks("<object data=x.pdf><p>fallback text</p></object><p>k</p>")
    assert [t for t, _ in found] == ["fallback text", "k"] and [ht.ID["in:object"] in f for _, f in found] == [True, False]
    body = "Many words of an article stand in this paragraph, and it goes on. " * 3
    assert "fallback" in ht.main_text(f"<article><h1>Title</h1><p>{body}</p><object><p>{body}fallback.</p></object><p>{body}</p></article>", chain)


def test_copyright_is_looked_for_in_the_whole_block():
    assert all(ht.ID["copyright"] in ht.shape("a " * n + "Copyright 2020", "p", 0, 0, 1) for n in (0, 100, 5000))
    assert ht.ID["copyright"] not in ht.shape("a " * 5000, "p", 0, 0, 1)


def test_held_out_pages(chain):
    right = [ht.main_text(page, chain) == "\n".join(kept) for page, kept in ht.labelled_pages(150, seed=77)]
    assert np.mean(right) > 0.93


def test_given_pages(chain, spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in ht.extract(pages, chain).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        want = [" ".join(html.unescape(re.sub(r"<(?!/?(h1|p)\b)[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", article)]
        assert got[r["page_id"]]["text"] == "\n".join(filter(None, want))
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_odd_rows(chain, spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (None, "u", "plain", None), (3, "u", "<article><p>Some real words stand here and they say something.</p></article>", None)] * 2, "page_id long, url string, html string, text string")
    got = ht.extract(df, chain).collect()
    assert len(got) == 8 and {(r["page_id"], r["text"], r["n_chars"]) for r in got if r["page_id"] in (1, 2, 3)} == {(1, "", 0), (2, "", 0), (3, "Some real words stand here and they say something.", 50)}
    assert ht.extract(df.limit(0), chain).collect() == []
