"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

A document is its token ids and one end id. Documents longer than a sequence are
cut into whole sequences and a rest; nothing else is cut. Rests and short
documents are dealt into shards of bounded size. In each shard several islands
breed packings. A herd starts from best fits of the documents, by turns in random
order and longest first with some disorder. A crossover puts whole well-filled bins of one parent into the other, removes the
bins that hold duplicates, and best-fits the documents so displaced, longest
first; a mutation dissolves a share of the worst-filled bins and a few others in
the same way. After each epoch an island's elite moves to the next island of its
shard; every epoch crosses once at least, and stops once a packing needs no more
bins than the documents' sum does. The best packing of a shard stands; its
worst-filled bins are dissolved and their documents packed again across shards,
until one shard is left or the levels are used up. ``generations`` says how many
crossovers the shard that placed a piece went through (0: a whole sequence).

Where the tokenizer's settings are the ones that LETTER_RUNS describes, white
space never lies inside a token, so the parts between are tokenized apart and
the ids of those met lately kept in a bounded memory; runs of lower-case Latin-1
letters go to the tokenizer's model without its normalizer and pre-tokenizer, which only spell
their bytes. Other tokenizers get whole texts. A special
token's string in a text is that token. Null texts are empty: one end id. Equal
documents are packed each. An empty table gives an empty result. Only doc_id and
text are looked at.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise
from struct import Struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinewave.llm.common import batches_of, cut, drop_cut

PARTS = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
WHOLE = 1 << 60  # sequence ids of whole sequences start here, those of a level at level << 52


#: Letters whose lower case is one letter and stays in place, then punctuation without apostrophes:
#: the tokenizer, too, takes such a part's letters and punctuation apart.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
LETTERS = "".join(c for c in map(chr, range(256)) if SIMPLE.fullmatch(c))
MARKS = "".join(c for c in map(chr, range(256)) if SIMPLE.fullmatch(f"a{c}") and c not in LETTERS)
PLAIN = re.compile("[a-zß-öø-ÿ]+")  # NFC and lower case leave it as it is, and it is one part for the model
RARE_SPACE = re.compile(r"[\x1c-\x1f]")
pack_ids = [Struct(f"<{n}I").pack for n in range(12)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return pack_ids[len(ids)](*ids) if len(ids) < len(pack_ids) else np.array(ids, "<u4").tobytes()


def parts_of(text: str) -> list[str]:
    """The parts between white space; str.split() also splits at four control characters."""
    return PARTS.findall(text) if RARE_SPACE.search(text) else text.split()


# The settings of a tokenizer whose tokens end at white space and where letters meet punctuation.
LETTER_RUNS = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": ["Split", "ByteLevel"],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def by_letter_runs(tokenizer_json: str) -> bool:
    """Whether a tokenizer has the settings that LETTER_RUNS names."""
    found = json.loads(tokenizer_json)
    steps = (found.get("normalizer") or {}).get("normalizers") or []
    cuts = (found.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if [x["type"] for x in steps] != LETTER_RUNS["normalizer"] or [x["type"] for x in cuts] != LETTER_RUNS["pre_tokenizer"]:
        return False
    tokens = found.get("added_tokens") or []
    return (
        steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and cuts[0]["pattern"] == {"Regex": LETTER_RUNS["split"]} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or SIMPLE.fullmatch(t["content"]) or len(parts_of(t["content"])) != 1 for t in tokens)
    )


class Recent:
    """Strings -> bytes that ``make`` gives; once ``most`` were met, those not met since the last time are forgotten."""

    def __init__(self, make: Callable[[list[str]], list[bytes]], most: int):
        self.make, self.most = make, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, keys: list[str]) -> list[bytes]:
        """The bytes of distinct strings."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        if None in found:
            new = []
            for k, v in zip(keys, found, strict=True):
                if v is None:
                    if (v := old.get(k)) is None:
                        new.append(k)
                    else:
                        young[k] = v
            young.update(zip(new, self.make(new), strict=True))
            found = list(map(young.__getitem__, keys))
        return found


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Parts of ``data``, by where they start and how long they are, joined."""
    before = np.cumsum(length) - length
    return data[np.repeat(start - before, length) + np.arange(length.sum())]


class Ids:
    """The bytes of texts' ids. The table holds about 2 * ``most`` strings and those of two calls."""

    def __init__(self, tokenizer, most: int = 100_000, whole: bool = False):
        self.tokenizer, self.whole, self.model = tokenizer, whole, tokenizer.model
        self.runs = Recent(self.made, most)
        self.spelt = {} if whole else {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS}

    def made(self, runs: list[str]) -> list[bytes]:
        """The ids of runs. Plain ones go to the tokenizer's model at once, spelt as its pre-tokenizer spells them."""
        out, other, tokens = [b""] * len(runs), [], self.model.tokenize
        for i, run in enumerate(runs):
            if PLAIN.fullmatch(run):
                out[i] = packed([t.id for t in tokens(run if run.isascii() else run.translate(self.spelt))])
            else:
                other.append(i)
        for at in range(0, len(other), 5_000):
            own = other[at : at + 5_000]
            for i, e in zip(own, self.tokenizer.encode_batch_fast([runs[i] for i in own], add_special_tokens=False), strict=True):
                out[i] = packed(e.ids)
        return out

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of whole texts; each distinct run of their parts is looked up once."""
        texts = texts.fill_null("")
        if self.whole:
            yield from (np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts.to_pylist())
            return
        if pc.any(pc.match_substring_regex(texts, RARE_SPACE.pattern)).as_py():
            lists = pa.array(map(parts_of, texts.to_pylist()), pa.list_(texts.type))
        else:
            lists = pc.utf8_split_whitespace(texts)  # empty parts have no ids
        coded = lists.flatten().dictionary_encode()
        parts, index, place = coded.dictionary, coded.indices.to_numpy(), np.asarray(lists.offsets)
        simple = pc.match_substring_regex(parts, f"^(?:{SIMPLE.pattern})$")
        first = pc.if_else(simple, pc.utf8_rtrim(pc.utf8_lower(parts), MARKS), parts)
        runs = pa.concat_arrays([first, pc.if_else(simple, pc.utf8_ltrim(parts, LETTERS), "")]).dictionary_encode()
        known = self.runs.values(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start, both = np.cumsum(length) - length, runs.indices.to_numpy().reshape(2, -1)
        data = gathered(np.frombuffer(b"".join(known), "<u4"), start[both.T.ravel()], length[both.T.ravel()])
        length = length[both].sum(axis=0)
        start = np.cumsum(length) - length
        for a, b in pairwise(place.tolist()):
            own = index[a:b]
            yield gathered(data, start[own], length[own]).tobytes()


def by_bytes(texts: pa.Array, most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each."""
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    return pairwise([0, *(np.flatnonzero(np.diff(size // most)) + 1).tolist(), len(texts)])


_KEPT: dict[int, Ids] = {}


def kept(tokenizer_json: str) -> Ids:
    """The worker's table for this tokenizer; it lives as long as the worker does."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _KEPT:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _KEPT.clear()
        _KEPT[key] = Ids(Tokenizer.from_str(tokenizer_json), whole=not by_letter_runs(tokenizer_json))
    return _KEPT[key]


def pieces(df: DataFrame, tokenizer_json: str, limit: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's pieces."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last = kept(shared.value), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, stop in by_bytes(batch["text"]):
                part = batch.slice(first, stop - first)
                rows, place = [], []
                for i, data in enumerate(seen.encode(part["text"])):
                    data += last
                    for k, start in enumerate(range(0, len(data), 4 * limit)):
                        own = data[start : start + 4 * limit]
                        place.append(i)
                        rows.append((k, start // 4, len(own) // 4, zlib.crc32(own), own))
                columns = [part["doc_id"].take(pa.array(place, pa.int64()))]
                columns += [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if with_ids:
                    columns.append(pa.array([r[4] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    kinds = [df.schema["doc_id"].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=False)])
    return df.select("doc_id", "text").mapInArrow(run, schema)


class Packing:
    """Bins as lists of items. Bins are kept by their room, and a bit for every room tells which there are."""

    __slots__ = ("bins", "by_room", "limit", "open", "room", "sizes")

    def __init__(self, sizes: list[int], limit: int, bins: Iterable[list[int]] = ()):
        self.sizes, self.limit = sizes, limit
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.open = 0
        for own in bins:
            free = limit - sum([sizes[i] for i in own])
            self.by_room.setdefault(free, []).append(len(self.bins))
            self.open |= 1 << free
            self.bins.append(own)
            self.room.append(free)

    def fit(self, items: list[int]) -> Packing:
        """Put the items, in this order, where they leave least room."""
        sizes, bins, room, by_room, open_ = self.sizes, self.bins, self.room, self.by_room, self.open
        for i in items:
            n = sizes[i]
            if large := open_ >> n:
                free = n + (large & -large).bit_length() - 1
                own = by_room[free]
                k = own.pop()
                if not own:
                    open_ ^= 1 << free
                bins[k].append(i)
                free -= n
            else:
                k, free = len(bins), self.limit - n
                bins.append([i])
                room.append(free)
            room[k] = free
            if own := by_room.setdefault(free, []):
                own.append(k)
            else:
                own.append(k)
                open_ |= 1 << free
        self.open = open_
        return self

    def refit(self, kept: list[list[int]], displaced: list[int]) -> Packing:
        """A packing of the bins ``kept`` (copied) and the displaced items, longest first."""
        return Packing(self.sizes, self.limit, [list(g) for g in kept]).fit(sorted(displaced, key=lambda i: (-self.sizes[i], i)))

    def fullest(self) -> list[int]:
        """The bins from the best filled on."""
        return np.argsort(self.room, kind="stable").tolist()

    def worth(self) -> tuple[int, int]:
        """Few bins first, then bins as full or as empty as can be."""
        return -len(self.bins), sum([(self.limit - r) ** 2 for r in self.room])


def cross(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """``b`` with half of the better-filled bins of ``a`` put in whole."""
    best = a.fullest()[: max(1, len(a.bins) // 2)]
    given = [a.bins[k] for k in rng.permutation(best)[: max(1, len(best) // 2)].tolist()]
    inside = set().union(*given)
    whole = [own for own in b.bins if inside.isdisjoint(own)]
    return b.refit(given + whole, [i for own in b.bins if not inside.isdisjoint(own) for i in own if i not in inside])


def mutate(a: Packing, rng: np.random.Generator) -> Packing:
    """``a`` with a share of its worst-filled bins, and a few others, dissolved and fitted again."""
    n = len(a.bins)
    gone = set(a.fullest()[n - max(1, int(n * rng.uniform(0.05, 0.5))) :]) | set(rng.integers(0, n, 1 + n // 40).tolist())
    return a.refit([own for k, own in enumerate(a.bins) if k not in gone], [i for k in sorted(gone) for i in a.bins[k]])


def breed(sizes: list[int], limit: int, seed: int, elite: list[list[int]], generations: int = 10, population: int = 4) -> tuple[list[int], int]:
    """The bin of every item in the best packing that an island finds, and how many crossovers it took.

    ``elite`` has packings to start from, each as the bin of every item. One
    crossover is made at least.
    """
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // limit)
    herd = []
    for bin_of in elite:
        bins: dict[int, list[int]] = {}
        for i, k in enumerate(bin_of):
            bins.setdefault(k, []).append(i)
        herd.append(Packing(sizes, limit, bins.values()))
    while len(herd) < population - (1 if elite else 0):
        # by turns in random order and longest first, with some disorder
        order = rng.permutation(len(sizes)) if len(herd) % 2 else np.argsort(rng.normal(0, limit / 20, len(sizes)) - sizes)
        herd.append(Packing(sizes, limit).fit(order.tolist()))
    made = 0
    while made < generations and (not made or len(herd[0].bins) > least):
        herd.sort(key=Packing.worth, reverse=True)
        # of two drawn the better one is the parent that gives
        a, b = sorted(rng.choice(len(herd), 2, replace=False).tolist())
        child = cross(herd[a], herd[b], rng)
        herd[-1] = max(child, mutate(child, rng), key=Packing.worth) if len(child.bins) > least else child
        made += 1
        herd.sort(key=Packing.worth, reverse=True)
    out = [0] * len(sizes)
    for k, items in enumerate(herd[0].bins):
        for i in items:
            out[i] = k
    return out, made


def island_epoch(limit: int, level: int, epoch: int):
    """A column function (sizes, shard, island, elite) -> the bin of every item and the number of crossovers."""

    @F.pandas_udf("bins array<int>, made int")
    def run(sizes: pd.Series, shard: pd.Series, island: pd.Series, elite: pd.Series) -> pd.DataFrame:
        seeds = [zlib.crc32(repr((level, epoch, int(a), int(b))).encode()) for a, b in zip(shard, island, strict=True)]
        found = [breed([int(x) for x in s], limit, seed, [list(map(int, x)) for x in e]) for s, seed, e in zip(sizes, seeds, elite, strict=True)]
        return pd.DataFrame({"bins": [b for b, _ in found], "made": [n for _, n in found]})

    return run


def evolve(shards: DataFrame, limit: int, level: int, islands: int, epochs: int) -> DataFrame:
    """(shard, bins, generations): the best packing that any island of the shard found, the crossovers of all."""
    island = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")
    state = shards.select("shard", "sizes", island, F.array().cast("array<array<int>>").alias("elite"), F.lit(0).alias("_made"))
    own = None
    for epoch in range(epochs):
        before = own
        state = state.withColumn("_x", island_epoch(limit, level, epoch)("sizes", "shard", "island", "elite"))
        own = cut(state.select("shard", "sizes", "island", F.col("_x.bins").alias("bins"), (F.col("_made") + F.col("_x.made")).alias("made")), f"epoch{level}-{epoch}")
        if before is not None:
            drop_cut(before)
        moved = own.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("bins").alias("guest"))
        state = own.join(moved, ["shard", "island"]).select("shard", "sizes", "island", F.array("bins", "guest").alias("elite"), F.col("made").alias("_made"))
    return own.groupBy("shard").agg(F.min_by("bins", F.struct(F.array_max("bins"), F.col("island"))).alias("bins"), F.sum("made").alias("generations"))


def pack(rows: DataFrame, limit: int = 4096, shard_rows: int = 1_500, islands: int = 2, epochs: int = 2, levels: int = 3, dissolve: float = 0.97) -> DataFrame:
    """``rows`` of pieces with sequence_id, offset and generations; ``rows`` must be a written table."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    whole = rows.filter(F.col("length") >= limit).withColumns({"sequence_id": F.lit(WHOLE) + F.col("_row"), "generations": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    out, left = [whole], rows.filter(F.col("length") < limit)
    item = F.struct("length", *[c for c in rows.columns if c != "length"])
    for level in range(1, levels + 1):
        n = left.count()
        n_shards = max(1, -(-n // shard_rows))
        dealt = left.groupBy(F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(n_shards)).alias("shard")).agg(F.sort_array(F.collect_list(item)).alias("items"))
        shards = cut(dealt.withColumn("sizes", F.transform("items", lambda x: x["length"].cast("int"))), f"shards{level}")
        evolved = evolve(shards.select("shard", "sizes"), limit, level, islands, epochs)
        placed = shards.select("shard", "items").join(evolved, "shard")
        flat = placed.select("shard", "generations", F.explode(F.arrays_zip("items", "bins")).alias("_x"))
        flat = flat.select("shard", "generations", F.col("_x.bins").cast("long").alias("_bin"), "_x.items.*")
        bins = flat.withColumn("sequence_id", F.lit(level << 52) + F.col("shard").cast("long") * (1 << 24) + F.col("_bin"))
        bins = cut(bins.drop("shard", "_bin"), f"bins{level}")
        drop_cut(shards)
        drop_cut(evolved)
        fill = bins.groupBy("sequence_id").agg(F.sum("length").alias("_fill"))
        final = level == levels or n_shards == 1
        poor = fill.filter(F.col("_fill") < (0 if final else dissolve * limit)).select("sequence_id")
        out.append(offsets(bins if final else bins.join(poor, "sequence_id", "left_anti")))
        if final:
            break
        left = bins.join(poor, "sequence_id", "left_semi").drop("sequence_id", "generations")
    done = out[0]
    for part in out[1:]:
        done = done.unionByName(part)
    return done.drop("_row")


def offsets(bins: DataFrame) -> DataFrame:
    """The place of every piece in its sequence; a sequence is bounded by its limit."""
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_row").rowsBetween(Window.unboundedPreceding, -1)
    return bins.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def report(df: DataFrame, tokenizer_path: str, limit: int = 4096, end_id: int = 1, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, generations of every piece."""
    with open(tokenizer_path, encoding="utf-8") as f, batches_of(df.sparkSession, 2_000, 1 << 22):
        rows = cut(pieces(df, f.read(), limit, end_id), "pieces")
    return pack(rows, limit, **how).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "generations")
