"""Document fingerprints: a canonical exact digest, with DataFrame functions only.

A text is canonical after NFKC, case folding, NFKC again, and folding every run
of Unicode white space into one space without ends. Its fingerprint is 128 bits
wide: two xxHash64 of the canonical UTF-8 bytes, the second seeded by a constant.
Documents of equal fingerprint are compared byte by byte; should two different
canonical texts ever share one, the later ones (in byte order) get a suffix.

Null and empty texts are the empty text. Equal rows get equal rows. An empty
table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brinewave.llm.common import cut

ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"
ICU_CHARACTER = "com.ibm.icu.lang.UCharacter"
SECOND_SEED = "brinewave"


def canonical(text: Column) -> Column:
    """NFKC, case folding and white space folding; plain ASCII needs only the last two."""

    def nfkc(c: Column) -> Column:
        return F.java_method(F.lit(ICU_NORMALIZER), F.lit("compose"), c, F.lit(True))

    folded = nfkc(F.java_method(F.lit(ICU_CHARACTER), F.lit("foldCase"), nfkc(text), F.lit(True)))
    plain = F.octet_length(text) == F.char_length(text)
    return F.btrim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits."""
    return F.concat(
        F.lpad(F.lower(F.hex(F.xxhash64(canon))), 16, "0"),
        F.lpad(F.lower(F.hex(F.xxhash64(F.lit(SECOND_SEED), canon))), 16, "0"),
    )


def collisions(df: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(fingerprint, canon, rank) of canonical texts after the first in buckets that hold several.

    Only texts whose fingerprint occurs twice travel; that key set is broadcast
    up to ``broadcast_rows`` keys and joined by a shuffle beyond.
    """
    rows = df.select(canonical(F.coalesce("text", F.lit(""))).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    again = rows.groupBy("fingerprint").count().filter("count > 1").select("fingerprint")
    few = again.limit(broadcast_rows + 1).count() <= broadcast_rows
    same = rows.join(F.broadcast(again) if few else again, "fingerprint", "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("fingerprint").orderBy("canon")) - 1
    return same.withColumn("rank", rank).filter("rank > 0")


def resolved(rows: DataFrame, clash: DataFrame | None, canon: str, fingerprint: str) -> DataFrame:
    """``rows`` with the suffix of clashing canonical texts added to ``fingerprint``."""
    if clash is None:
        return rows
    clash = clash.select(F.col("fingerprint").alias("_f"), F.col("canon").alias("_c"), "rank")
    met = rows.join(clash, (F.col(fingerprint) == F.col("_f")) & (F.col(canon) == F.col("_c")), "left")
    return met.withColumn(fingerprint, F.concat_ws("-", fingerprint, F.col("rank").cast("string"))).drop("_f", "_c", "rank")


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    canon = canonical(F.coalesce("text", F.lit("")))
    rows = df.select("doc_id", canon.alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    clash = collisions(df)
    return resolved(rows, clash if clash.limit(1).count() else None, "canon", "fingerprint").drop("canon")


def groups(prints: DataFrame) -> DataFrame:
    """fingerprint, group_doc_id (the smallest id of equal canonical texts), n_copies."""
    return prints.groupBy("fingerprint").agg(F.min("doc_id").alias("group_doc_id"), F.count("*").alias("n_copies"))


def with_next(df: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """(doc_id, text, next_text): the next document by id, after the last the first.

    Null ids come first; rows of one id are ordered by a hash of their text, then by
    the text. Rows are dealt into ranges of (id, hash), one window each: as many as the
    session shuffles into where rows are few, more where a range would hold over
    ``per_bucket`` rows, without an upper limit. The bounds come from a range
    partitioning of ids and hashes alone, so that texts travel once; also a large
    group of equal ids spreads over ranges. Every range gets the first row of the
    following one.
    """
    spark = df.sparkSession
    text = F.coalesce("text", F.lit(""))
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("k"), F.xxhash64(text).alias("h"))
    base = df.select("doc_id", text.alias("text"), order.alias("_o"))
    n = base.count()
    ranges = max(1, min(n // 1_000, int(spark.conf.get("spark.sql.shuffle.partitions"))), n // per_bucket)
    light = base.select("_o").repartitionByRange(ranges, "_o").groupBy(F.spark_partition_id().alias("b")).agg(F.min("_o").alias("o"))
    bounds = sorted((r["o"]["k"], r["o"]["h"]) for r in light.collect())
    step = int(len(bounds) ** 0.5) + 1

    def array(values: list) -> Column:
        return F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("h")) for k, h in values])

    # a row's range has the last bound that is not above it: among every step-th first, then among the step after that
    met = lambda a: F.size(F.filter(a, lambda x: x <= F.col("_o")))
    block = (met(array(bounds[::step])) - 1) * step if bounds else F.lit(0)
    base = base.withColumn("_b", (block + met(F.slice(array(bounds), block + 1, step)) - 1).cast("int") if bounds else F.lit(0))
    follow = [((i - 1) % len(bounds), k, h) for i, (k, h) in enumerate(bounds)]
    heads = spark.createDataFrame(follow, "_to int, _k long, _h long").select("_to", F.struct(F.col("_k").alias("k"), F.col("_h").alias("h")).alias("_o"))
    tails = base.join(F.broadcast(heads), "_o").groupBy("_to").agg(F.min("text").alias("text"))
    rows = base.select("doc_id", "text", "_o", "_b", F.lit(0).alias("_end"))
    ends = tails.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("struct<k:bigint,h:bigint>").alias("_o"), F.col("_to").alias("_b"), F.lit(1).alias("_end"))
    window = Window.partitionBy("_b").orderBy("_end", "_o", "text")
    return rows.unionByName(ends).withColumn("next_text", F.lead("text").over(window)).filter("_end = 0").select("doc_id", "text", "next_text")


def with_groups(rows: DataFrame, prints: DataFrame, most: int = 100_000, least: int = 1_000) -> DataFrame:
    """``rows`` with their fingerprint's group_doc_id and n_copies.

    Groups of more copies than ``least``, and than a share of one in ``most`` of all
    documents (so at most ``most`` groups), are broadcast, so that no task gets a
    group whole; the others are joined by a shuffle.
    """
    met = groups(prints)
    hot = F.broadcast(met.filter(F.col("n_copies") > max(least, prints.count() // most)).select(F.col("fingerprint").alias("_f"), F.col("group_doc_id").alias("_g"), F.col("n_copies").alias("_n")))
    known = rows.join(hot, F.col("fingerprint") == F.col("_f"), "left")
    rest = known.filter("_f is null").drop("_f", "_g", "_n").join(met, "fingerprint")
    return rest.unionByName(known.filter("_f is not null").withColumnsRenamed({"_g": "group_doc_id", "_n": "n_copies"}).drop("_f"))


def fingerprint_report(df: DataFrame) -> DataFrame:
    """The fingerprint and group of every text, that of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document. For an exact digest likeness is
    1 for equal canonical bytes and else 0.
    """
    clash = collisions(df)
    clash = clash if clash.limit(1).count() else None
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(df).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("ce"), canonical(F.col("next_text")).alias("cn"),
    )
    rows = rows.withColumns({"fingerprint": digest(F.col("c")), "edited_fingerprint": digest(F.col("ce")), "next_fingerprint": digest(F.col("cn"))})
    same = lambda f, c: F.when(F.col("fingerprint") == F.col(f), (F.col("c") == F.col(c)).cast("double")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"near_edited": same("edited_fingerprint", "ce"), "near_next": same("next_fingerprint", "cn")})
    rows = resolved(resolved(rows, clash, "c", "fingerprint"), clash, "ce", "edited_fingerprint")
    rows = cut(rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"), "prints")
    return with_groups(rows, rows.select("doc_id", "fingerprint"))
