"""A training corpus from the documents table, stage by stage.

Toxic documents go, one document of each group of near duplicates stays (five
words, similarity 0.8), personal data is rewritten, sources are mixed to their
target weights (a document taken twice is there twice), and what is left is
packed into sequences of at most 4096 tokens. All stages but the last return the
columns of documents; n_chars follows the text. Each takes (spark, docs, sf_dir).

In every stage null texts are empty texts, a null id is an id of its own that
comes last, equal rows are treated alike, further columns are kept whatever their
names, and an empty table gives an empty result. What a stage does with repeated
rows and ties is said below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewave.llm import mixing, packing, pii, simjoin, toxicity
from brinewave.llm.common import cut, drop_cut, read

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Equal texts score alike; empty texts score 0 and stay."""
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents that of the smallest id stays; of rows that are equal in all columns one. Documents without words all stay."""
    return simjoin.distinct(docs, words=5, percent=80)


def rewrite_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mentions become their kind, disclosing words a general word or nothing; of overlapping mentions the first, the longest of those, counts."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it. Equal rows are told apart by their number; a null source is one of its own."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of each row of ``docs``; a document that is there twice is packed twice, an empty one as its end id."""
    return packing.report(docs, public_tokenizers.path(TOKENIZER)).drop("generations")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", rewrite_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the learning stages nor the sampling; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
