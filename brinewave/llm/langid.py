"""Language identification with spans of mixed-language text.

The script of a word's first letter narrows its candidate languages to those
that used the script in training. Letter n-grams of the word then give each
candidate a log posterior, bounded below so that no single word decides.
Viterbi over the words, with a penalty for every switch of language, labels the
spans; the document gets the language with most letters, scored by its share.

The n-gram table is learnt on the driver from a bounded sample: for each
language ``per_lang`` documents, chosen by a hash of id and text, and of each a
slice of ``slice_chars`` code points at a hashed place. Every text is labelled
whole. Null texts and texts without a letter are ``und`` with score 0 and no
spans; so is every text if no row can be learnt from. Equal texts get equal
labels; ties go to the language first by code point. Other columns than doc_id,
text and (to learn) lang are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewave.llm.common import is_held_out

# First code points of the Unicode ranges that tell scripts apart.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Hiragana"), (0x30A0, "Katakana"), (0x3100, "Other"),
    (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Katakana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
STARTS, SCRIPTS = [a for a, _ in SCRIPT_RANGES], [b for _, b in SCRIPT_RANGES]
WORDS = re.compile(r"[^\W\d_]+")
GRAMS = (2, 3, 4)


def script(word: str) -> str:
    return SCRIPTS[bisect_right(STARTS, ord(word[0])) - 1]


def grams(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of the words, and the word that each is of."""
    marked = "".join([f"<{w.lower()}>" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w.lower()) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        whole = owner[: len(h)] == owner[n - 1 :]
        buckets.append((h[whole] >> np.uint64(64 - bits - 20)).astype(np.int64) & ((1 << bits) - 1))
        owners.append(owner[: len(h)][whole])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # log probabilities, language x n-gram bucket
    allowed: dict[str, np.ndarray]  # by script, which languages use it
    bits: int = 18
    floor: float = 8.0
    penalty: float = 12.0

    def scores(self, words: list[str]) -> np.ndarray:
        """Log posteriors of words, one row each, at least -floor."""
        buckets, owner = grams(words, self.bits)
        # n-grams overlap: divided by their lengths' number, each letter counts about once
        s = np.stack([np.bincount(owner, row[buckets], len(words)) for row in self.table], axis=1) / len(GRAMS)
        if not all(ok.all() for ok in self.allowed.values()):
            for i, w in enumerate(words):
                ok = self.allowed.get(script(w))
                if ok is not None:
                    s[i, ~ok] = -1e9
        s -= s.max(axis=1, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
        return np.maximum(s, -self.floor).astype(np.float32)


def sample(df: DataFrame, per_lang: int, slice_chars: int, seed: int) -> DataFrame:
    """(lang, text): per language ``per_lang`` slices at most, by hash."""
    rows = df.filter(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.xxhash64("doc_id", F.lit(seed)).alias("_u"), "text")
    share = rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), 2.0 * per_lang / F.col("count")).alias("_share"))
    span = float(1 << 20)
    rows = rows.join(F.broadcast(share), "lang").filter(F.pmod("_u", F.lit(1 << 20)) < F.col("_share") * span)
    offset = F.pmod(F.xxhash64("_u"), F.greatest(F.lit(1), F.char_length("text") - slice_chars)).cast("int")
    rows = rows.select("lang", "_u", F.substring("text", offset + 1, F.lit(slice_chars)).alias("text"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "text"))
    return rows.withColumn("_n", order).filter(F.col("_n") <= per_lang).select("lang", "text")


def learn(df: DataFrame, per_lang: int = 500, slice_chars: int = 4_000, seed: int = 7, bits: int = 18) -> Model:
    """A model from the rows outside the held-out fold."""
    counts: dict[str, np.ndarray] = {}
    used: dict[str, Counter] = {}
    for lang, text in sample(df, per_lang, slice_chars, seed).collect():
        if words := WORDS.findall(text):
            counts[lang] = counts.get(lang, 0) + np.bincount(grams(words, bits)[0], minlength=1 << bits)
            used.setdefault(lang, Counter()).update(map(script, words))
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, 1 << bits)), {}, bits)
    total = np.stack([counts[k] for k in langs])
    total[:, total.sum(axis=0) < 2] = 0
    kinds = int((total.sum(axis=0) > 0).sum()) + 1
    table = np.log((total + 0.5) / (total.sum(axis=1, keepdims=True) + 0.5 * kinds)).astype(np.float32)
    scripts = {s for k in langs for s in used[k]}
    allowed = {s: np.array([used[k][s] >= 0.01 * sum(used[k].values()) for k in langs]) for s in scripts}
    return Model(langs, table, {s: v for s, v in allowed.items() if v.any()}, bits)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of states through (words x states) scores; the first state wins a tie."""
    n, k = scores.shape
    total = scores.sum(axis=0, dtype=np.float64)
    b = int(total.argmax())
    gain = np.cumsum(scores.astype(np.float64) - scores[:, b : b + 1], axis=0)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0.0)
    # No stretch gains half a penalty by another language: then one language is best throughout.
    if (gain - np.vstack([np.zeros((1, k)), low[:-1]])).max() <= penalty / 2:
        return np.full(n, b)
    best = scores[0].astype(np.float64)
    back = np.empty((n, k), dtype=np.int32)
    own = np.arange(k)
    for i in range(1, n):
        j = int(best.argmax())
        stay = best >= best[j] - penalty
        back[i] = np.where(stay, own, j)
        best = np.where(stay, best, best[j] - penalty) + scores[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


class Words(dict):
    """Word -> row of the score table; rows of new words are filled by score()."""

    def __init__(self, model: Model, most: int):
        self.model, self.most, self.new = model, most, []
        self.rows = np.zeros((0, len(model.langs)), dtype=np.float32)

    def __missing__(self, word: str) -> int:
        # what looks like a word without a letter (a fraction, say) has row -1
        n = self[word] = len(self.rows) + len(self.new) if any(map(str.isalpha, word)) else -1
        if n >= 0:
            self.new.append(word)
        return n

    def score(self) -> None:
        if self.new:
            self.rows = np.vstack([self.rows, self.model.scores(self.new)])
            self.new = []

    def tidy(self) -> None:
        """Forget all words once there are many; they are scored again when met."""
        if len(self) > self.most:
            self.clear()
            self.rows = self.rows[:0]


def label(text: str, ids: np.ndarray, words: Words) -> tuple[str, float, list]:
    """The document's language, its share of the letters, and its spans."""
    real = ids >= 0
    model = words.model
    if not real.any():
        return "und", 0.0, []
    path = viterbi(words.rows[ids[real]], model.penalty)
    changes = np.flatnonzero(np.diff(path))
    if not len(changes):
        return model.langs[path[0]], 1.0, [(0, len(text), model.langs[path[0]])]
    places = [m.span() for m, r in zip(WORDS.finditer(text), real, strict=True) if r]
    weight = np.bincount(path, [b - a for a, b in places], len(model.langs))
    firsts = [0, *(changes + 1)]
    spans = [(places[a][0], places[b - 1][1], model.langs[path[a]]) for a, b in zip(firsts, [*firsts[1:], len(path)], strict=True)]
    best = int(weight.argmax())
    return model.langs[best], float(weight[best] / weight.sum()), spans


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def identify(df: DataFrame, model: Model, slice_rows: int = 500) -> DataFrame:
    """doc_id, lang_pred, score, spans array<struct<start, end, lang>> of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Words(model, max(20_000, 1_200_000 // max(4, len(model.langs))))
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                texts = [t.as_py() or "" for t in part["text"]]
                ids = [np.array([words[w] for w in WORDS.findall(t)] if model.langs else [], np.int32) for t in texts]
                words.score()
                out = [label(t, i, words) for t, i in zip(texts, ids, strict=True)]
                words.tidy()
                columns = [part["doc_id"], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
                spans = pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in o[2]] for o in out], SPANS)
                yield pa.RecordBatch.from_arrays([*columns, spans], ["doc_id", "lang_pred", "score", "spans"])

    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    return df.select("doc_id", "text").mapInArrow(run, schema)


def report(df: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans; learnt from the same table's other folds."""
    rows = identify(df, learn(df, **how))
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
