"""Personal data: fixed patterns, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers.
The values found are the protected entities. Corpus co-occurrence then says how
strongly a word reveals an entity of its document: over all documents,

    PMI(e, t) = log2(n_et * N / (n_e * (n_t + 1))),   IC(e) = log2(N / n_e),

with n_e, n_t and n_et the documents that have e, t and both. PMI / IC is the
disclosure of t: near 1 if t occurs only beside e. The one document added to n_t
is what protects against chance: few documents speak for less than many, and none
are too few to be looked at. Words that disclose at least ``generalise_at`` become
a generalisation of their shape, those from ``remove_at`` on go, wherever they
stand in the documents that hold the entity. A word is a run of three letters or
more between mentions.

Entities of the very same documents disclose and are disclosed alike, and so do
words: they are counted as one class. So a text with very many entities or words
of its own gives few pairs. Work on one text grows little faster than its length,
whatever it holds: places are summed up in blocks, and a text is cut in blocks
before pieces of it are taken.

DataFrame functions only. Null texts are empty texts, with no spans. Equal rows
get equal rows; ids may repeat or be null (texts are told apart by 128 bits of
hash). An empty table gives an empty result. Extra columns are kept by
``sanitise``, whatever their names, and not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import cut, drop_cut, plainly_named

#: Each pattern starts only where a maximal run starts (or the last match ended)
#: and grows lazily over one character class, so that it reads a text once.
LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{DOMAIN}++\.{DOMAIN}[A-Za-z0-9.-]*?(?!{DOMAIN}|\.{DOMAIN})",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]*?(?![0-9]|[ -][0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
TERM = r"\p{L}{3,}"


def luhn(digits: Column) -> Column:
    """Whether the Luhn checksum of a string of digits holds."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """What a match of the kind must fulfil besides its pattern."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False),
        "phone": (n >= 9) & (n <= 15),
    }[kind]


def scanned(items: Column, value, combine, result, none: Column) -> Column:
    """The arrays ``result(state, item)`` along an array, joined.

    An item's state is what ``combine`` (associative, from 0 on) makes of the values
    of the items before it. Accumulators are copied at each step, so the scan goes in
    blocks of the array's cube root: blocks are summed up, their states follow, then
    each block is scanned by itself.
    """

    def whole(of: Column) -> Column:
        items, block = of["items"], of["block"]
        last = lambda k: F.least((k + 1) * block, F.size(items)) - 1

        def summed(k: Column) -> Column:
            return F.aggregate(F.sequence(k * block, last(k)), F.lit(0), lambda acc, i: combine(acc, value(F.get(items, i))))

        def follow(acc: Column, x: Column) -> Column:
            return F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        def scan(at: Column, k: Column) -> Column:
            def one(acc: Column, i: Column) -> Column:
                found = result(acc["at"], F.get(items, i))
                return F.struct(combine(acc["at"], value(F.get(items, i))).alias("at"), F.when(F.size(found) > 0, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

            return F.aggregate(F.sequence(k * block, last(k)), F.struct(at.alias("at"), none.alias("out")), one, lambda acc: acc["out"])

        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), summed)
        states = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), follow, lambda acc: acc["out"])
        return F.when(F.size(items) > 0, F.flatten(F.transform(states, scan))).otherwise(none)

    sized = lambda x: F.struct(x.alias("items"), F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(x))).cast("int")).alias("block"))
    return named(items, lambda x: named(sized(x), whole))


def named(value: Column, use) -> Column:
    """``use`` of a value that it may mention often; the value is made once, and copied."""
    return F.transform(F.array(value), use)[0]


def parted(text: Column, pattern: str) -> Column:
    """array<struct<gap, value>>: a pattern's leftmost matches and what stands before each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("value"))


def matches(text: Column, pattern: str, keep=None) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost matches, by code points.

    ``keep`` says by a match's value whether it is listed; many that are not cost little.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def found(at: Column, pair: Column) -> Column:
        start = at + F.char_length(pair["gap"])
        one = F.array(F.struct(start.alias("start"), (start + F.char_length(pair["value"])).alias("end"), pair["value"].alias("value")))
        return one if keep is None else F.when(keep(pair["value"]), one).otherwise(none)

    return scanned(parted(text, pattern), lambda p: F.char_length(p["gap"]) + F.char_length(p["value"]), lambda x, y: x + y, found, none)


def _passing(kind: str):
    return lambda value: passes(kind, value)


def _labelled(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value")))


def _tagged(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), F.lit(f"[{kind.upper()}]").alias("tag")))


#: What a text must hold before a pattern is tried.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def base_spans(df: DataFrame) -> DataFrame:
    """``df`` with array columns email, ip, card and phone of struct<start, end, value>."""
    text = F.coalesce(df["text"], F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    spans = {k: F.when(F.contains(text, F.lit(HINTS[k])), matches(text, p, _passing(k))).otherwise(none) for k, p in PATTERNS.items()}
    return df.withColumns({f"_{k}": v for k, v in spans.items()})


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with a 128-bit key of the row's id and text."""
    t, i = F.coalesce(df["text"], F.lit("")), F.coalesce(df["doc_id"].cast("string"), F.lit("null"))
    return df.withColumns({"_h1": F.xxhash64(t, i), "_h2": F.xxhash64(F.lit("second"), i, t)})


def mentions() -> Column:
    """array<struct<kind, start, end, value>> of all base spans."""
    return F.flatten(F.array(*[_labelled(k) for k in KINDS]))


def between(text: Column) -> Column:
    """The text with a space for every code point of an e-mail address, so that places stay.

    Other mentions hold no letters, so no word lies in or reaches into one.
    """
    pattern = PATTERNS["email"]
    blanked = F.transform(parted(text, pattern), lambda p: F.concat(p["gap"], F.repeat(F.lit(" "), F.char_length(p["value"]))))
    whole = F.concat(F.array_join(blanked, ""), F.element_at(F.split(text, pattern, -1), -1))
    return F.when(F.contains(text, F.lit("@")), whole).otherwise(text)


def words(text: Column) -> Column:
    """The distinct words of a text without its mentions, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def alike(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """(name, n, _class): in how many documents each value stands; values of the very same documents share a class.

    ``rows`` has a document (_h1, _h2, _m: how often it occurs) once for each of its values.
    """
    bits = [F.bit_xor(F.xxhash64("_h1", "_h2", "_m", F.lit(i))).alias(f"_b{i}") for i in (1, 2)]
    met = rows.groupBy(name, *more).agg(F.sum("_m").alias("n"), F.count("*").alias("_d"), *bits)
    return met.select(name, *more, "n", F.concat_ws(":", *more, "_d", "n", "_b1", "_b2").alias("_class"))


def disclosures(df: DataFrame, held: DataFrame, generalise_at: float, broadcast_rows: int = 50_000) -> DataFrame:
    """(_h1, _h2, term, disclosure) above the lower threshold; counts are over all rows of ``df``.

    ``held`` has each document with mentions once: _h1, _h2, _m, its entities and words.
    Small tables are broadcast up to ``broadcast_rows`` rows, shuffled beyond.
    """

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.limit(broadcast_rows + 1).count() <= broadcast_rows else table

    total = F.lit(float(df.count()))
    key = ["_h1", "_h2", "_m"]
    entities = held.select(*key, F.explode("entities").alias("entity"))
    having = cut(alike(entities, "entity").withColumnRenamed("n", "n_e"), "entities")
    # n_et is at most n_e, so a word of more documents than this cannot disclose an entity.
    most = lambda n: n * F.pow(total / n, 1 - generalise_at) * (1 + 1e-9)
    largest = having.agg(F.max("n_e")).first()[0] or 0
    if not largest:
        drop_cut(having)
        return held.select("_h1", "_h2", F.lit("").alias("term"), F.lit(0.0).alias("disclosure")).limit(0)
    text = between(F.coalesce(F.col("text"), F.lit("")))
    # The words of a text once, counted over all texts; only words of documents with mentions travel further.
    seen = df.select(F.explode(words(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    own = held.select(*key, F.explode("words").alias("term"))
    seen = cut(seen.filter(F.col("n_t") + 1 <= most(F.lit(float(largest)))).join(own.select("term").distinct(), "term", "left_semi"), "seen")
    own = cut(own.join(small(seen), "term"), "own")
    terms = cut(alike(own, "term", "n_t").select("term", "n_t", F.col("_class").alias("_tclass")), "classes")
    e = entities.join(small(having), "entity").select(*key, "n_e", F.col("_class").alias("_eclass")).distinct()
    t = own.join(small(terms.select("term", "_tclass")), "term").select(*key, "n_t", "_tclass").distinct()
    rows = cut(e.join(t, key).filter(F.col("n_t") + 1 <= most(F.col("n_e"))), "possible")
    met = rows.groupBy("_eclass", "_tclass", "n_e", "n_t").agg(F.sum("_m").alias("n_et"))
    pmi = F.log2(F.col("n_et") * total / (F.col("n_e") * (F.col("n_t") + 1)))
    ic = F.log2(total / F.col("n_e"))
    worst = met.select("_eclass", "_tclass", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("disclosure")).filter(F.col("disclosure") >= generalise_at)
    worst = cut(worst, "worst")
    reached = rows.join(small(worst), ["_eclass", "_tclass"]).groupBy(*key, "_tclass").agg(F.max("disclosure").alias("disclosure"))
    named = own.join(small(terms.select("term", "_tclass")), "term").join(reached, [*key, "_tclass"])
    out = cut(named.select("_h1", "_h2", "term", "disclosure"), "disclosures")
    for table in (having, seen, own, terms, rows, worst):
        drop_cut(table)
    return out


def disclosing(df: DataFrame, generalise_at: float = 0.8) -> DataFrame:
    """(_h1, _h2, _worst): the disclosing words of each document that has any, with their disclosure."""
    found = base_spans(keyed(df.select("doc_id", "text")))
    text = between(F.coalesce(F.col("text"), F.lit("")))
    entities = F.array_distinct(F.transform(mentions(), lambda m: F.concat(m["kind"], F.lit(":"), m["value"])))
    found = found.filter(" or ".join(f"size(_{k}) > 0" for k in KINDS)).select("_h1", "_h2", entities.alias("entities"), words(text).alias("words"))
    held = cut(found.groupBy("_h1", "_h2").agg(F.count("*").alias("_m"), F.first("entities").alias("entities"), F.first("words").alias("words")), "held")
    rows = disclosures(df, held, generalise_at)
    out = cut(rows.groupBy("_h1", "_h2").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("_worst")), "terms")
    drop_cut(rows)
    drop_cut(held)
    return out


def all_spans(df: DataFrame, **how) -> DataFrame:
    """``df`` with its base spans and, in _term, the disclosing words (empty if none)."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,disclosure:double>>")
    worst = F.col("_worst")
    text = between(F.coalesce(F.col("text"), F.lit("")))
    rows = base_spans(keyed(df)).join(disclosing(df, **how), ["_h1", "_h2"], "left")
    rows = rows.withColumn("_rest", F.when(worst.isNotNull(), text))
    found = F.transform(
        matches(F.col("_rest"), TERM, lambda w: F.map_contains_key(worst, F.lower(w))),
        lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lower(w["value"]).alias("value"), worst[F.lower(w["value"])].alias("disclosure")),
    )
    return rows.withColumn("_term", F.when(worst.isNotNull(), found).otherwise(none))


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def report(df: DataFrame, **how) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans, all spans as text, n_term."""
    rows = all_spans(df.select("doc_id", "text"), **how)
    base = F.concat(*[listed(k, F.col(f"_{k}")) for k in KINDS])
    return rows.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed("term", F.col("_term"))), ",").alias("spans"),
        F.size("_term").cast("long").alias("n_term"),
    )


#: Code points of the blocks in which a text is cut before pieces of it are taken.
BLOCK = 4096


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text cut in blocks."""

    def part(k: Column) -> Column:
        first = F.greatest(start - k * BLOCK, F.lit(0))
        return F.substring(F.get(blocks, k), first + 1, F.least(end - k * BLOCK, F.lit(BLOCK)) - first)

    ks = F.sequence(F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int"))
    return F.when(start < end, F.array_join(F.transform(ks, part), "")).otherwise("")


def rewritten(text: Column, spans: Column) -> Column:
    """The text with the tags of spans (array<struct<start, less, tag>>) in their places; a later span within an earlier one is left out."""
    none = F.array().cast("array<struct<at:int,start:int,tag:string>>")

    def fresh(at: Column, s: Column) -> Column:
        return F.when(s["start"] >= at, F.array(F.struct(at.alias("at"), s["start"].alias("start"), s["tag"].alias("tag")))).otherwise(none)

    def join(of: Column) -> Column:
        blocks, cuts = of["blocks"], of["cuts"]
        body = F.array_join(F.transform(cuts, lambda c: F.concat(piece(blocks, c["at"], c["start"]), c["tag"])), "")
        return F.concat(body, piece(blocks, F.array_max(F.transform(of["spans"], lambda s: -s["less"])), F.char_length(of["text"])))

    whole = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), scanned(spans, lambda s: -s["less"], F.greatest, fresh, none).alias("cuts"), spans.alias("spans"), text.alias("text"))
    return F.when(F.size(spans) > 0, named(whole, join)).otherwise(text)


def sanitise(df: DataFrame, remove_at: float = 0.95, **how) -> DataFrame:
    """``df`` with its texts rewritten: entities by their kind, words by their shape or nothing.

    Overlapping spans are replaced once, by the tag of the first, the longest where several start. Null texts stay null.
    """
    plain = plainly_named(df, "doc_id", "text")
    rows = all_spans(plain, **how)
    tags = [_tagged(k) for k in KINDS]
    word = lambda s: F.when(s["disclosure"] >= remove_at, F.lit("")).otherwise(F.lit("[WORD]"))
    tags.append(F.transform("_term", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), word(s).alias("tag"))))
    rows = rows.withColumn("_all", F.array_sort(F.concat(*tags)))
    return rows.withColumn("text", rewritten(F.col("text"), F.col("_all"))).select(*plain.columns).toDF(*df.columns)
