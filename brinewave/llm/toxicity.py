"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy learns from confirmed toxic documents and unlabelled
text with the class-prior-corrected risk

    pi * E_P[l(f, 1)] + max(0, E_U[l(f, 0)] - pi * E_P[l(f, 0)]),

l the logistic loss and pi the share of toxic rows among the labelled ones (of
the folds learnt from). Where the bracket turns negative, a step climbs out of
it instead. Features are words and word beginnings, lower-cased; a feature's
value is the square root of its share of the document's words against 1 %, at
most 1. The ``n_features`` that tell toxic from unlabelled text best (by a
likelihood ratio, ties by code point) are kept.

Fitting uses a bounded sample: at most ``positives`` toxic and ``unlabelled``
other documents, chosen by a hash of the id, and of each a slice of
``slice_chars`` code points at a hashed place. Every text is scored whole.

Null texts, empty texts and texts without a letter score 0. Without toxic rows to learn
from, or words to learn from, every score is 0. Equal texts get equal scores. An empty table gives an
empty result. Only doc_id and text of the documents and doc_id and toxic of the
labels are looked at; repeated labels count as often as they occur.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import is_held_out, plainly_named

WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
#: A word's share of the document at which its feature is full.
FULL = 0.01


def features(word: str, bits: int) -> list[int]:
    """Hash buckets of the word and its beginnings."""
    names = [f"0 {word}", *(f"{k} {word[:k]}" for k in PREFIXES if len(word) >= k)]
    return [xxhash.xxh64_intdigest(n) >> (64 - bits) for n in names]


def present(texts: Iterable[str], bits: int, most: int = 50_000) -> np.ndarray:
    """In how many texts each bucket occurs; of at most ``most`` words the features are remembered."""
    seen: dict[str, bytes] = {}
    out = np.zeros(1 << bits, np.int64)
    for text in texts:
        words = set(WORDS.findall(text.lower()))
        if len(seen) > most:
            seen.clear()
        flat = b"".join(seen.get(w) or seen.setdefault(w, array("i", features(w, bits)).tobytes()) for w in words)
        out[np.unique(np.frombuffer(flat, np.int32))] += 1
    return out


@dataclass
class Model:
    index: dict[int, int]  # of each bucket kept its weight's number
    weights: np.ndarray
    bias: float
    bits: int = 20

    def ids(self, word: str) -> tuple[int, ...]:
        return tuple(i for f in features(word, self.bits) if (i := self.index.get(f)) is not None)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.index:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))


NOTHING = Model({}, np.zeros(0), 0.0)


class Seen(dict):
    """Word -> its features; forgets all once there are many words."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most = model, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.model.ids(word)
        return out


def counted(texts: Iterable[str | None], seen: Seen) -> tuple[np.ndarray, np.ndarray]:
    """How often each text has each feature of the model, and its number of words."""
    texts = list(texts)
    x, sizes = np.zeros((len(texts), len(seen.model.index))), np.zeros(len(texts))
    for i, text in enumerate(texts):
        words = WORDS.findall((text or "").lower())
        sizes[i] = len(words)
        for ids in filter(None, map(seen.__getitem__, words)):
            for j in ids:
                x[i, j] += 1
    return x, sizes


def values(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The features' values, in place of the counts."""
    counts /= np.maximum(n_words, 1)[:, None]
    counts /= FULL
    np.minimum(1.0, counts, out=counts)
    return np.sqrt(counts, out=counts)


def fit(xp: np.ndarray, xu: np.ndarray, prior: float, l2: float = 5e-4, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam on full batches."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    w = np.zeros(xp.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        fp, fu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gain, back, up = -prior * sigmoid(-fp) / len(fp), -prior * sigmoid(fp) / len(fp), sigmoid(fu) / len(fu)
        a, b = (gain + back, up) if rest >= 0 else (-back, -up)
        grad = np.append(xp.T @ a + xu.T @ b + l2 * w[:-1], a.sum() + b.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def select(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, n_features: int, least: int = 5) -> np.ndarray:
    """The buckets whose presence (in how many of n texts) tells the two sets apart best, by KL divergence."""
    names = np.flatnonzero(in_p + in_u >= least)
    p, q = (in_p[names] + 0.5) / (n_p + 1), (in_u[names] + 0.5) / (n_u + 1)
    worth = p * np.log(p / q) + (1 - p) * np.log((1 - p) / (1 - q))
    return names[np.lexsort((names, -worth.round(12)))][:n_features]


def slices(rows: DataFrame, most: int, slice_chars: int) -> list[str]:
    """At most ``most`` texts of rows (_u, text), those of the smallest _u, cut to a hashed slice."""
    offset = F.pmod(F.xxhash64("_u"), F.greatest(F.lit(1), F.char_length("text") - slice_chars)).cast("int")
    return [r["text"] for r in rows.select("_u", F.substring("text", offset + 1, F.lit(slice_chars)).alias("text")).orderBy("_u", "text").limit(most).collect()]


def learn(docs: DataFrame, labels: DataFrame, positives: int = 1_500, unlabelled: int = 4_000, slice_chars: int = 6_000, n_features: int = 1_000, seed: int = 11, bits: int = 20) -> Model:
    """A model from the rows outside the held-out fold."""
    known = labels.filter(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    n, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return NOTHING
    chosen = known.filter("toxic = 1").select("doc_id").distinct().withColumn("_u", F.xxhash64("doc_id", F.lit(seed))).orderBy("_u").limit(positives)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~is_held_out(F.col("doc_id")))
    texts_p = slices(rows.join(F.broadcast(chosen), "doc_id"), positives, slice_chars)
    share = min(1.0, 2.0 * unlabelled / max(1, docs.count()))
    u = F.xxhash64("doc_id", F.lit(seed + 1))
    texts_u = slices(rows.withColumn("_u", u).filter(F.pmod("_u", F.lit(1 << 20)) < share * (1 << 20)), unlabelled, slice_chars)
    if not texts_p or not texts_u:
        return NOTHING
    index = {int(f): i for i, f in enumerate(select(present(texts_p, bits), len(texts_p), present(texts_u, bits), len(texts_u), n_features))}
    if not index:
        return NOTHING
    seen = Seen(Model(index, NOTHING.weights, 0.0, bits), 50_000)
    xp, xu = (values(*counted(texts, seen)) for texts in (texts_p, texts_u))
    texts_p.clear()
    texts_u.clear()
    return Model(index, *fit(xp, xu, toxic / n), bits)


def scores(df: DataFrame, model: Model, keep: list[str], slice_rows: int = 500) -> DataFrame:
    """The columns ``keep`` of ``df`` and the score (0 to 1) of every row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen = Seen(model)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                x, sizes = counted((text.as_py() for text in part["text"]), seen)
                out = np.where(sizes > 0, model.score(values(x, sizes)), 0.0)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(out, pa.float64())], [*keep, "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    return df.select(*columns).mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = scores(docs, learn(docs, labels, **how), ["doc_id"])
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The documents that score below the threshold, all columns kept, whatever their names."""
    plain = plainly_named(docs, "doc_id", "text")
    kept = scores(plain, learn(plain, labels, **how), plain.columns).filter(F.col("score") < threshold)
    return kept.drop("score").toDF(*docs.columns)
