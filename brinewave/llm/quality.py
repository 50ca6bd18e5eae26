"""Quality rules: base counts, and a likelihood ratio of hashed n-grams.

Words and runs of punctuation, lower-cased, give 1- and 2-grams that are hashed
into 2**bits buckets. Over all documents they are counted twice: in the corpus
as it is, and in the trusted documents (quality 1). A document's score is the
mean over its n-grams of log p(trusted) - log p(corpus), smoothed; it is kept if
no base rule fails and the score reaches ``threshold``. A text without n-grams
scores 0. Without trusted documents every score is 0.

Null texts are empty texts. Equal texts get equal rows. Repeated labels mark a
document once. An empty table gives an empty result. Only doc_id and text (and
doc_id and quality of the labels) are looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = re.compile(r"\w+|[^\w\s]+")
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
ODD = np.uint64(0x9E3779B97F4A7C15)
BITS = 16


class Tokens(dict):
    """Word -> the 64-bit hashes of its tokens; forgets all once there are many words."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        low = word.decode("utf-8", "surrogatepass").lower()
        out = self[word] = tuple(xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in TOKENS.findall(low))
        return out


def buckets(words: list[bytes], seen: Tokens, bits: int = BITS) -> np.ndarray:
    """The bucket of every 1- and 2-gram."""
    flat = [h for w in words for h in seen[w]]
    h = np.array(flat, np.uint64)
    pairs = (h[:-1] * ODD) ^ (h[1:] + np.uint64(1))
    return np.concatenate([h >> np.uint64(64 - bits), (pairs * ODD) >> np.uint64(64 - bits)]).astype(np.int64)


def count(docs: DataFrame, labels: DataFrame, bits: int = BITS, broadcast_rows: int = 1_000_000) -> np.ndarray:
    """2 x 2**bits counts: over all documents, over the trusted ones.

    Every task sends at most one row per bucket; the trusted ids are broadcast up
    to ``broadcast_rows`` rows and joined by a shuffle beyond.
    """
    trusted = labels.filter("quality = 1").select("doc_id").distinct().withColumn("_t", F.lit(True))
    few = trusted.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted) if few else trusted, "doc_id", "left").select("text", F.col("_t").isNotNull().alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Tokens(), np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for text, good in zip(batch["text"], batch["_t"], strict=True):
                found = np.bincount(buckets((text.as_py() or "").encode("utf-8", "surrogatepass").split(), seen, bits), minlength=1 << bits)
                total[0] += found
                if good.as_py():
                    total[1] += found
        met = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[0][met]), pa.array(total[1][met])], ["bucket", "n_all", "n_good"])

    sums = rows.mapInArrow(run, "bucket int, n_all long, n_good long").groupBy("bucket").agg(F.sum("n_all"), F.sum("n_good"))
    out = np.zeros((2, 1 << bits))
    for b, n, good in sums.collect():
        out[:, b] = n, good
    return out


def ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log p(trusted) - log p(corpus) by bucket."""
    if not counts[1].any():
        return np.zeros(counts.shape[1])
    p = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * counts.shape[1])
    return np.log(p[1]) - np.log(p[0])


def repeated(words: np.ndarray, window: int = 8) -> int:
    """How many words lie in windows that occur twice or more; words are 64-bit hashes."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ words[k : k + n]) * ODD
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts_of(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else []
    hashes = {w: xxhash.xxh64_intdigest(w) for w in set(words)} if len(words) > 8 else {}
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated(np.fromiter((hashes[w] for w in words), np.uint64, len(words))) if hashes else 0,
    )


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, weights: np.ndarray, threshold: float, bits: int = BITS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, weights = Tokens(), shared.value
        for batch in batches:
            base, score = [], []
            for text in batch["text"]:
                text = text.as_py() or ""
                words = text.encode("utf-8", "surrogatepass").split()
                base.append(counts_of(text, words))
                found = buckets(words, seen, bits)
                score.append(float(weights[found].mean()) if len(found) else 0.0)
            columns = [pa.array([b[i] for b in base], pa.int64()) for i in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, pa.array(score, pa.float64())], ["doc_id", *NAMES, "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES) + ", score double")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def report(docs: DataFrame, labels: DataFrame, threshold: float = -0.25) -> DataFrame:
    """judge() with the ratios of these very documents."""
    return judge(docs, ratios(count(docs, labels)), threshold)
