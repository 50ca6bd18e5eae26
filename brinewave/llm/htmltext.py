"""Main text of web pages by a linear-chain conditional random field.

A page is read once, tag by tag, into its leaf blocks: the runs of text between
the starts and ends of block elements, with their ancestors. Scripts, styles and
other elements whose content is no page text give no blocks. Features of a block
are its own tag, its ancestors' tags, what their classes, ids and roles speak of,
and its text's length, links, punctuation and place. A two-label chain with
these features is trained by maximum likelihood on labelled pages, by default on
pages made by ``labelled_pages`` from many layouts, and decoded by Viterbi.

Character references are decoded, white space inside a block is one space, ends
are trimmed, the blocks kept stand in page order with one newline between.
Null and empty pages give the empty text. Equal pages get equal texts; nothing is
cut short. An empty table gives an empty result. Only page_id, url and html are
looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by their kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style iframe noframes noembed xmp title textarea".split())
HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
UNSEEN = set("head template noscript svg canvas select datalist audio video button annotation annotation-xml".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# A formula is part of its paragraph.
INLINE |= set("math semantics annotation annotation-xml maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
ANCESTORS = "article main section nav header footer aside form figure figcaption table ul ol dl blockquote pre address details dialog menu object".split()
OWN = "p h1 h2 h3 h4 h5 h6 li td th div section article blockquote pre dt dd figcaption body label".split()
# Words of classes, ids and roles, by what they speak of.
TOPICS = {
    "content": "article content post entry story body main text prose hentry articlebody maincontent",
    "nav": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc sitemap tabs links",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner adsense dfp",
    "comment": "comment comments commentlist disqus reply replies respond discussion thread reviews",
    "side": "sidebar side aside related recommended recommendations widget trending popular more complementary teaser rail",
    "foot": "footer foot copyright legal contentinfo colophon bottom",
    "head": "header head masthead logo topbar brand site top hero",
    "notice": "cookie cookies consent gdpr notice popup modal newsletter subscribe subscription signup alert dialog overlay privacy paywall",
    "social": "share sharing social follow",
    "meta": "byline author date meta tags tag category timestamp dateline",
    "form": "login search form searchform register input",
}
TOPIC_OF = {w: k for k, v in TOPICS.items() for w in v.split()}
LENGTHS, LINKS = (1, 2, 5, 10, 20, 50), (0.0, 0.3, 0.7)
NAMES = (
    ["bias", *(f"in:{t}" for t in ANCESTORS), *(f"own:{t}" for t in OWN), "own:other", *(f"of:{t}" for t in TOPICS), "hidden", "linked"]
    + [*(f"words:{n}" for n in LENGTHS), *(f"links:{x}" for x in LINKS), "links:all", "sentence", "copyright", "capital", "bars"]
    + ["first", "last", "start", "end"]
)
ID = {n: i for i, n in enumerate(NAMES)}
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TAG_END = re.compile(r"""[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(100_000)
def topics(name: str, attributes: str) -> tuple[int, ...]:
    """The features that an element lends to the blocks inside it."""
    out = {ID[f"in:{name}"]} if f"in:{name}" in ID else set()
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            out |= {ID[f"of:{t}"] for w in HUMP.findall(value) + re.findall(r"\w+", value) if (t := TOPIC_OF.get(w.lower()))}
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            out.add(ID["hidden"])
    return tuple(sorted(out))


def blocks(page: str) -> list[tuple[str, list[int]]]:
    """(text, features) of the leaf blocks of a page, in order."""
    found: list[tuple[str, list[int], str, int]] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    around: Counter = Counter()
    text: list[str] = []
    linked = depth_a = unseen = 0
    opened: Counter = Counter()

    def flush() -> None:
        nonlocal linked
        if text:
            clean = " ".join(entities.unescape("".join(text)).split())
            if clean:
                own = next((n for n, _ in reversed(stack) if n not in INLINE), "body")
                found.append((clean, [f for f, n in around.items() if n], own, linked))
            text.clear()
        linked = 0

    def pop() -> str:
        nonlocal depth_a, unseen
        name, lent = stack.pop()
        opened[name] -= 1
        for f in lent:
            around[f] -= 1
        depth_a -= name == "a"
        unseen -= name in UNSEEN
        return name

    def close(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        """Pop to the nearest open element of the names, if any before the scope."""
        if any(opened[n] for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    while len(stack) > i:
                        pop()
                    return
                if stack[i][0] in scope:
                    return

    def put(piece: str) -> None:
        nonlocal linked
        if opened["head"] and stack[-1][0] == "head" and piece.strip():
            close(("head",))
        if not unseen:
            text.append(piece)
            if depth_a:
                linked += len(piece)

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            put(page[at:])
            break
        if lt > at:
            put(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after.isalpha() and after.isascii():
            name = NAME.match(page, lt + 1)[0]
            end = TAG_END.match(page, lt + 1 + len(name))
            stop = end.end() if end else (page.find(">", lt) + 1 or size)
            attributes = page[lt + 1 + len(name) : stop - 1]
            name, at = name.lower(), stop
            if name in RAW:
                ended = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
                at = (page.find(">", ended.start()) + 1 or size) if ended else size
                if name == "textarea":
                    flush()
                continue
            if opened["head"] and name not in HEAD:
                close(("head",))  # its end may be left out
            if name not in INLINE:
                flush()
                if name in CLOSES_P:
                    close(("p",), ("table", "button"))
                if name in CLOSED_BY_LIKE:
                    close(CLOSED_BY_LIKE[name], SCOPES.get(name, ()))
            elif name in ("br", "img", "wbr"):
                put(" " if name != "wbr" else "")
            if name not in VOID and not attributes.endswith("/"):
                lent = topics(name, attributes.strip())
                stack.append((name, lent))
                opened[name] += 1
                for f in lent:
                    around[f] += 1
                depth_a += name == "a"
                unseen += name in UNSEEN
        elif after == "/" and NAME.match(page, lt + 2):
            name = NAME.match(page, lt + 2)[0].lower()
            at = page.find(">", lt) + 1 or size
            if name not in INLINE:
                flush()
            if opened[name]:
                close((name,))
        elif page.startswith("<!--", lt):
            done = page.find("-->", lt + 2)
            at = done + 3 if done >= 0 else size
        elif after in ("!", "?", "/"):
            at = page.find(">", lt) + 1 or size
        else:
            put("<")
            at = lt + 1
    flush()
    n = len(found)
    return [(t, [*lent, *shape(t, own, links, i, n)]) for i, (t, lent, own, links) in enumerate(found)]


def shape(text: str, own: str, links: int, i: int, n: int) -> list[int]:
    """Features of a block's own tag, text and place."""
    words = text.count(" ") + 1
    out = [ID["bias"], ID.get(f"own:{own}", ID["own:other"]), ID[f"words:{max(x for x in LENGTHS if x <= words)}"]]
    share = links / len(text)
    out.append(ID["links:all"] if share > LINKS[-1] else ID[f"links:{min(x for x in LINKS if share <= x)}"])
    if text[-1] in ".!?…。！？\"”»":
        out.append(ID["sentence"])
    if "©" in text or "copyright" in text.lower():
        out.append(ID["copyright"])
    if text[0].isupper():
        out.append(ID["capital"])
    if " | " in text or "»" in text or "›" in text:
        out.append(ID["bars"])
    out += [ID[k] for k, yes in (("first", i == 0), ("last", i == n - 1), ("start", 10 * i < n), ("end", 10 * (i + 1) > 9 * n)) if yes]
    return out


@dataclass
class Chain:
    """Weights: of features for label 1 over 0, of label pairs, of the first label."""

    weights: np.ndarray
    pairs: np.ndarray
    first: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The most likely labels; of equal paths the one with label 0 later."""
        w, (aa, ab, ba, bb), (f0, f1) = self.weights.tolist(), self.pairs.ravel().tolist(), self.first.tolist()
        back: list[tuple[int, int]] = []
        s0, s1 = f0, f1
        for i, fs in enumerate(rows):
            e = sum([w[f] for f in fs])
            if i:
                from0, from1 = (0 if s0 + aa >= s1 + ba else 1), (0 if s0 + ab >= s1 + bb else 1)
                s0, s1 = max(s0 + aa, s1 + ba), max(s0 + ab, s1 + bb)
                back.append((from0, from1))
            s1 += e
        if not rows:
            return []
        out = [int(s1 > s0)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], l2: float = 1e-3, steps: int = 150, rate: float = 0.1) -> Chain:
    """Maximum likelihood by Adam; a page is (features of its blocks, their labels)."""
    pages = [p for p in pages if p[0]]
    n, t = len(pages), max(len(x) for x, _ in pages)
    x, y, real = np.zeros((n, t, len(NAMES)), np.float32), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (rows, labels) in enumerate(pages):
        real[i, : len(rows)], y[i, : len(rows)] = True, labels
        for j, fs in enumerate(rows):
            x[i, j, fs] = 1
    w = np.zeros(len(NAMES) + 6)
    m, v = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(2)[y] * real[..., None]
    seen_pairs = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
    for step in range(1, steps + 1):
        pairs, first = w[-6:-2].reshape(2, 2), w[-2:]
        emit = np.stack([np.zeros((n, t)), x @ w[:-6]], -1)
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = emit[:, 0] + first
        for j in range(1, t):
            alpha[:, j] = np.logaddexp.reduce(alpha[:, j - 1, :, None] + pairs, axis=1) + emit[:, j]
        for j in range(t - 2, -1, -1):
            nxt = np.logaddexp.reduce(pairs + (emit[:, j + 1] + beta[:, j + 1])[:, None, :], axis=2)
            beta[:, j] = np.where(real[:, j + 1, None], nxt, 0.0)
        z = np.logaddexp.reduce(alpha[:, 0] + beta[:, 0], axis=1)
        gamma = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        both = np.exp(alpha[:, :-1, :, None] + pairs + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
        grad = np.concatenate([
            np.einsum("nt,ntk->k", gamma[..., 1] - hot[..., 1], x), (both.sum((0, 1)) - seen_pairs).ravel(), (gamma[:, 0] - hot[:, 0]).sum(0),
        ]) / n + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Chain(w[:-6], w[-6:-2].reshape(2, 2), w[-2:])


def labelled_pages(n: int = 400, seed: int = 0) -> list[tuple[str, list[str]]]:
    """Made pages of many layouts, each with the texts of its article's blocks."""
    rng = np.random.default_rng(seed)
    syllables = "ba do ki lu me no pa ri so tu ve xa zo qui fle gra stom ble nt sch que er os".split()
    pick = lambda options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))

    def phrase(low: int, high: int, end: str = "") -> str:
        return (" ".join(word() for _ in range(int(rng.integers(low, high + 1)))) + end).capitalize()

    def sentence_text(low: int, high: int) -> str:
        return " ".join(phrase(1, 18, pick([".", ".", ".", "!", "?"])) for _ in range(int(rng.integers(low, high + 1))))

    def links(k: int, wrap: str) -> str:
        return "".join(wrap.format(f'<a href="/{word()}">{phrase(1, 3)}</a>') for _ in range(k))

    def menu() -> str:
        body = pick([lambda k: f"<ul>{links(k, '<li>{}</li>')}</ul>", lambda k: links(k, "{} | "), lambda k: links(k, "<div>{}</div>"), lambda k: f"<p>{links(k, '{} ')}</p>"])(int(rng.integers(2, 9)))
        return pick(["<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="nav">{}</div>', '<div role="navigation">{}</div>', "<div>{}</div>"]).format(body)

    def notice() -> str:
        body = f"{pick(['<p>{}</p>', '{}', '<span>{}</span>']).format(sentence_text(1, 2))} <button>{phrase(1, 2)}</button>"
        return pick(['<div class="cookie-notice">{}</div>', '<div id="consent">{}</div>', '<div role="alert" class="notice">{}</div>', '<div class="newsletter-signup">{}</div>', '<div class="modal popup">{}</div>']).format(body)

    def advert() -> str:
        body = pick(["{}", "<p>{}</p>", '<a href="/buy">{}</a>']).format(pick([sentence_text(1, 2), phrase(2, 8)]))
        return pick(['<div class="ad">{}</div>', '<div class="advert banner">{}</div>', '<aside class="sponsored">{}</aside>', '<div id="ads">{}</div>', '<section class="promo">{}</section>']).format(body)

    def side() -> str:
        body = f"<h3>{phrase(1, 3)}</h3>" + pick([f"<ul>{links(4, '<li>{}</li>')}</ul>", f"<p>{sentence_text(1, 3)}</p>", links(3, "<p>{}</p>")])
        return pick(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div class="widget related">{}</div>', '<section class="related">{}</section>', '<div role="complementary">{}</div>']).format(body)

    def form() -> str:
        return f'<form action="/s"><label>{phrase(1, 4)}</label><input name="q">{pick(["", f"<p>{sentence_text(1, 1)}</p>"])}<button>{phrase(1, 1)}</button></form>'

    def comments() -> str:
        item = lambda: pick(['<div class="comment"><b>{1}</b><p>{0}</p></div>', "<li><p>{0}</p></li>", "<article class=\"comment\"><header>{1}</header><p>{0}</p></article>", "<div>{1}: {0}</div>"]).format(sentence_text(1, 3), word())
        body = f"<h3>{phrase(1, 2)}</h3>" * chance(0.6) + "".join(item() for _ in range(int(rng.integers(1, 6))))
        return pick(['<div class="comments">{}</div>', '<section id="comments">{}</section>', '<ol class="commentlist">{}</ol>', '<div id="discussion">{}</div>']).format(body)

    def share() -> str:
        return pick(['<div class="share">{}</div>', '<ul class="social">{}</ul>']).format(links(3, "{} "))

    def foot() -> str:
        body = pick(["&copy; {} &middot; {}", "<p>&copy; {} {}</p>", "<p>{} {}</p>"]).format(f"{word()}.example.com", sentence_text(1, 2)) + menu() * chance(0.3)
        return pick(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer" role="contentinfo">{}</div>']).format(body)

    def top() -> str:
        body = pick([f"<h1>{phrase(1, 3)}</h1>", f'<div class="logo">{phrase(1, 2)}</div>', f"<p>{phrase(2, 6)}</p>"]) + menu() * chance(0.5)
        return pick(["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div role="banner">{}</div>']).format(body)

    pages = []
    for _ in range(n):
        kept: list[str] = []

        def good(text: str, kept: list[str] = kept) -> str:
            kept.append(text)
            return text

        title, bare = phrase(3, 14), chance(0.15)
        inner = [pick(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", '<h2 class="title">{}</h2>']).format(good(title))] if chance(0.4 if bare else 0.9) else []
        inner += [pick(['<p class="byline">{}</p>', '<div class="meta">{}</div>', "<time>{}</time>"]).format(phrase(1, 4))] if chance(0.2) else []
        if inner and inner[-1].startswith("<time>"):
            inner.pop()
        for _ in range(int(pick([1, 1, 2, 3] if bare else range(1, 12)))):
            kind = rng.random()
            if kind < 0.7:
                t = good(sentence_text(1, 8) if chance(0.8) else phrase(1, 5, pick([".", "", "!"])))
                inner.append(pick(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p><b>{}<br>", "<div>{}</div>", "<p>{}</p>"]).format(t))
                if chance(0.15):
                    words = t.split()
                    words[len(words) // 2] = f'<a href="/x">{words[len(words) // 2]}</a>'
                    inner[-1] = inner[-1].replace(t, " ".join(words))
            elif kind < 0.78:
                inner.append(pick(["<h2>{}</h2>", "<h3>{}</h3>"]).format(good(phrase(1, 8))))
            elif kind < 0.85:
                inner.append("<ul>" + "".join(f"<li>{good(phrase(2, 15, pick(['', '.'])))}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.9:
                inner.append(f"<blockquote>{pick(['{}', '<p>{}</p>']).format(good(sentence_text(1, 3)))}</blockquote>")
            elif kind < 0.93:
                inner.append("<table>" + "".join(f"<tr><td>{good(phrase(1, 3))}</td><td>{good(phrase(1, 5))}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.95:
                inner.append(f"<figure><img src=a.png><figcaption>{good(phrase(3, 10, '.'))}</figcaption></figure>")
            else:
                inner.append(pick([advert, share, side, notice])())
        inner += [share()] * chance(0.2) + [comments()] * chance(0.2)
        wrap = pick(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div id="post" class="entry">{}</div>', '<main><article class="post">{}</article></main>', '<div class="story-body">{}</div>', '<section role="main">{}</section>'])
        body = [f() for f in (top, menu, notice, advert, form) if chance(0.45)] + [wrap.format("".join(inner))] + [f() for f in (comments, side, advert, form, notice) if chance(0.35)] + [foot()] * chance(0.85)
        if bare:
            body = [wrap.format("".join(inner))]
        script = f"<script>var t=\"</p>\";{word()}(1);</script>" * chance(0.5)
        pages.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style>{script}</head><body>{''.join(body)}</body></html>", kept))
    return pages


def learn(pages: list[tuple[str, list[str]]] | None = None) -> Chain:
    """A chain trained on labelled pages: (html, texts of the blocks to keep)."""
    rows = []
    for page, kept in labelled_pages() if pages is None else pages:
        good, found = set(kept), blocks(page)
        rows.append(([f for _, f in found], [int(t in good) for t, _ in found]))
    return train(rows)


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(t for (t, _), keep in zip(found, chain.decode([f for _, f in found]), strict=True) if keep)


def extract(df: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = df.sparkSession.sparkContext.broadcast(chain or learn())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(p.as_py() or "", chain) for p in part["html"]]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = {c: df.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return df.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
