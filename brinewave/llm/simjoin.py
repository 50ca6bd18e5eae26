"""Near duplicates: an exact Jaccard join on word shingles by token-combination prefixes.

A document's set has its distinct shingles of ``words`` words (fewer words: the
whole sequence), as 64-bit hashes. Documents with equal sets are one node. Two
nodes link if 100 * intersection >= ``percent`` * union. The steps:

1. In how many documents words occur is counted over all documents in 2**``bits``
   buckets, a table of fixed size. A shingle is no more frequent than its rarest
   word; by that word's count shingles are ordered from rare to frequent. Any
   order that all documents share is right; a good one makes few candidates.
2. A set's prefix are its first n - ceil(percent * n / 100) + 1 shingles: linked
   sets share one there. Rare shingles are indexed alone. Where a prefix holds
   frequent ones it is extended by one shingle for each of a number of hash groups;
   then linked sets share one shingle more than there are groups, so a rare one or
   two frequent ones of a group, and pairs of frequent shingles of a group are
   indexed. The number of groups follows the size class (a power of two) of the
   larger of two sets, so that pairs stay a small multiple of the prefix however
   long a text is; a set is indexed in each class that a larger partner can have.
   (Sets too small for that index their prefix alone, those near the limit both.)
3. In an index bucket all members are first compared with one leader, chosen anew
   in each round; links found join nodes to components, and buckets within one
   component are done. So a large group of near copies takes a few comparisons a
   member, not one a pair. Rounds end when one links less than a tenth of all sets.
4. What then still shares a bucket across components is compared without exception,
   in blocks of bounded size: sizes and parity bitmaps (their difference bounds the
   sets' difference from below) tell which pairs may link. A block gives the chains
   that such pairs make, at most one row a member. The chains' components, each in
   blocks of bounded size again, get their members' whole sets; there pairs are
   verified, and a block gives the links that join its members, again at most one
   row a member.
5. Components grow by alternating large-star and small-star steps.

Null texts and texts without words have empty sets: they link with nothing and
are their own component. Repeated rows and ids are fine; a component is named by
its smallest id that is not null. An empty table gives an empty result. Only
doc_id and text are looked at; ``distinct`` keeps all columns, whatever their names
and kinds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import batches_of, cut, drop_cut, plainly_named

ODD = np.uint64(0x9E3779B97F4A7C15)
BITMAP, LARGEST = 8, 64  # longs of a bitmap, of small and of large sets
BLOCK = 1 << 12


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes(dict):
    """Word -> 64-bit hash; forgets all once there are many words."""

    def __init__(self, most: int = 300_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def word_hashes(text: str, seen: Hashes) -> np.ndarray:
    return np.array([seen[w] for w in text.encode("utf-8", "surrogatepass").lower().split()], np.uint64)


def shingles(words: np.ndarray, k: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles' hashes in order, and each one's frequency class: that of its rarest word."""
    k = min(k, len(words))
    if not k:
        return words, np.zeros(0, np.uint8)
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * ODD + words[i : n + i])
    if rank is None:
        return np.unique(out), np.zeros(0, np.uint8)
    own = rank[bucket(words, len(rank))]
    least = own[:n].copy()
    for i in range(1, k):
        np.minimum(least, own[i : n + i], out=least)
    out, first = np.unique(out, return_index=True)
    return out, least[first]


def bucket(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - size.bit_length())).astype(np.int64)


def least_overlap(n: int, percent: int) -> int:
    """Fewest shingles that a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def groups_of(size_class: int, percent: int, least: int) -> int:
    """Hash groups for sets whose larger one has 2**size_class to twice as many shingles."""
    return max(least, (1 << size_class) * (100 - percent) // 100)


def signatures(s: np.ndarray, kind: np.ndarray, often: int, percent: int, groups: int) -> np.ndarray:
    """What a set is indexed by; ``kind`` has its shingles' frequency classes, frequent from ``often`` on.

    A class has ``groups`` hash groups at least.
    """
    n = len(s)
    if not n:
        return s
    order = np.lexsort((s, kind))
    s, kind = s[order], kind[order]
    plain = n - least_overlap(n, percent) + 1
    largest = n * 100 // percent
    out = []
    for c in range(n.bit_length() - 1, largest.bit_length()):
        g = groups_of(c, percent, groups)
        small = -(-(g + 1) * 100 // percent)  # sets from here on share g + 1 shingles at least
        if n <= small * 100 // percent + 1:  # this set or a partner may be too small for pairs
            out.append(mix(s[:plain] ^ np.uint64(0x5151 + c)))
        if n < small:
            continue
        if kind[plain - 1] < often:
            out.append(mix(s[:plain] ^ np.uint64(0xA7A7)))
            continue
        p, rare = s[: plain + g], kind[: plain + g] < often
        out.append(mix(p[rare] ^ np.uint64(0xA7A7)))
        rest = p[~rare]
        group = (rest >> np.uint64(7)) % np.uint64(g)
        by = np.argsort(group, kind="stable")
        rest, group = rest[by], group[by]
        at, d = np.arange(len(rest)), 0
        while len(at):
            d += 1
            at = at[at + d < len(rest)]
            at = at[group[at] == group[at + d]]
            out.append(mix(mix(rest[at] ^ np.uint64(0xC3C3 + c)) + rest[at + d] * ODD))
    return np.unique(np.concatenate(out))


def bitmap(s: np.ndarray, places: int | None = None) -> np.ndarray:
    """Parities of the set's shingles in as many places as its size asks for.

    Twice the places fold to once: a bitmap is the XOR of its halves' longs.
    """
    if places is None:
        places = 64 * min(LARGEST, max(BITMAP, 1 << max(0, (len(s) - 1).bit_length() - 6)))
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def node_of(s: np.ndarray) -> tuple[int, int, int]:
    """A 64-bit name of the set, and 128 bits to tell whether it is unique."""
    a = int(np.bitwise_xor.reduce(mix(s + np.uint64(11))))
    b = int(np.add.reduce(mix(s ^ np.uint64(0x7777))))
    name = xxhash.xxh64_intdigest(f"{a}:{b}:{len(s)}")
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (name, a, b))


def frequencies(rows: DataFrame, bits: int) -> np.ndarray:
    """In how many documents the words of each bucket occur.

    Tasks send their counts in compressed blocks, summed in two steps.
    """
    span = min(BLOCK, 1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total, n = Hashes(), np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                met = bucket(np.unique(word_hashes(text.as_py() or "", seen)), 1 << bits)
                np.add.at(total, met, 1)
                n += len(met)
        if n:
            parts = total.reshape(-1, span)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([n % 256] * len(parts), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["block", "part", "counts"])

    def add(_: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(span, np.int64)
        for c in table["counts"]:
            total += np.frombuffer(zlib.decompress(c.as_py()), np.int64)
        return pa.table({"block": table["block"][:1], "part": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "block int, part int, counts binary"
    some = rows.select("text").mapInArrow(run, schema).groupBy("block", "part").applyInArrow(add, schema)
    out = np.zeros(1 << bits, np.int64)
    for r in some.groupBy("block").applyInArrow(add, schema).collect():
        out[r["block"] * span : (r["block"] + 1) * span] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out


def classes(counts: np.ndarray, least: int = 256) -> tuple[np.ndarray, int]:
    """Half octaves of the counts, and the class from which a word is frequent."""
    octaves = lambda c: np.round(2 * np.log2(1 + c)).astype(np.uint8)
    return octaves(counts), int(octaves(np.array(max(least, 8 * counts.mean()))))


def described(rows: DataFrame, keep: list[str], order: tuple[np.ndarray, int], words: int, percent: int, groups: int) -> DataFrame:
    """``keep`` and n, node, _a, _b, bits, sigs of every row."""
    from pyspark.sql import types as T

    shared = rows.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, (rank, often) = Hashes(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(word_hashes(t.as_py() or "", seen), words, rank) for t in part["text"]]
                names = [node_of(s) for s, _ in sets]
                columns = [pa.array((len(s) for s, _ in sets), pa.int64()), *(pa.array([x[i] for x in names], pa.int64()) for i in range(3))]
                lists = [(bitmap(s) for s, _ in sets), (signatures(s, kind, often, percent, groups).view(np.int64) for s, kind in sets)]
                columns += [pa.array(list(x), pa.list_(pa.int64())) for x in lists]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), *columns], [*keep, "n", "node", "_a", "_b", "bits", "sigs"])

    extra = [T.StructField(c, T.LongType()) for c in ("n", "node", "_a", "_b")] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("bits", "sigs")]
    return rows.select(*keep, "text").mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *extra]))


def may_link(n1: Column, n2: Column, percent: int) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def folded(b: Column, size: Column) -> Column:
    """A bitmap folded to ``size`` longs, which is its own size or half of it."""
    half = F.floor(F.size(b) / 2).cast("int")
    return F.when(F.size(b) > size, F.zip_with(F.slice(b, F.lit(1), half), F.slice(b, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(b)


def differ(b1: Column, b2: Column) -> Column:
    """In how many places the bitmaps of sets of like size differ, the larger folded."""
    size = F.least(F.size(b1), F.size(b2))
    return F.aggregate(F.zip_with(folded(b1, size), folded(b2, size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def may_differ(n1: Column, n2: Column, percent: int) -> Column:
    """In how many shingles linked sets of these sizes can differ at most."""
    both = n1 + n2
    return both - 2 * F.ceil(both * percent / (100.0 + percent) - 1e-9)


class Forest:
    """Which rows of a block belong together; at most one link a row joins them."""

    def __init__(self, same: np.ndarray):
        """Rows of equal ``same`` belong together from the start."""
        self.root = np.unique(same, return_index=True)[1][np.unique(same, return_inverse=True)[1]]
        self.links: list[tuple[int, int]] = []

    def apart(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose rows do not belong together yet."""
        new = self.root[x] != self.root[y]
        return x[new], y[new]

    def join(self, x: np.ndarray, y: np.ndarray, linked: Callable[[int, int], bool] | None = None) -> None:
        """Join the pairs' rows, those that are ``linked`` if that is asked."""
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while i in parent:
                i = parent[i]
            return i

        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            a, b = find(int(self.root[i])), find(int(self.root[j]))
            if a != b and (linked is None or linked(i, j)):
                parent[max(a, b)] = min(a, b)
                self.links.append((i, j))
        if parent:
            for a in sorted(parent):
                parent[a] = find(a)
            old = np.fromiter(parent, np.int64, len(parent))
            new = np.arange(len(self.root))
            new[old] = np.fromiter(parent.values(), np.int64, len(parent))
            self.root = new[self.root]


def neighbours(key: np.ndarray, forest: Forest, label: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of equal key (in sorted order) that labels, sizes and the forest leave open."""
    at, d = np.arange(len(key)), 0
    while len(at):
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        x, y = forest.apart(at, at + d)
        ok = (label[x] != label[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
        if ok.any():
            yield x[ok], y[ok]


def most_apart(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """In how many shingles linked sets of these sizes can differ at most."""
    both = n1 + n2
    return both - 2 * -(-both * percent // (100 + percent))


def by_size(bits: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Bitmaps in every number of longs that some row has, each row's folded down; rows of smaller ones are zero."""
    sizes = sorted({len(b) for b in bits}, reverse=True)
    out: dict[int, np.ndarray] = {}
    for size in sizes:
        table = np.zeros((len(bits), size), np.uint64)
        for i, b in enumerate(bits):
            if len(b) == size:
                table[i] = b
        if out:
            larger = out[last]
            while larger.shape[1] > size:
                larger = larger[:, : larger.shape[1] // 2] ^ larger[:, larger.shape[1] // 2 :]
            table |= larger
        out[size], last = table, size
    return out


def blockwise(keys: list[str], work: Callable[[pa.Table, np.ndarray], np.ndarray], rows: int, size: int) -> Callable:
    """A mapInArrow function: ``work`` gets whole blocks (rows of equal keys, in sorted order) and their numbers.

    Blocks are gathered up to ``rows`` rows or ``size`` bytes; work gives pairs of nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            columns = [table[c].to_numpy() for c in keys]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            stop = table.num_rows if last else (int(new[-1]) if len(new) else 0)
            held[:] = [] if last else table.slice(stop).combine_chunks().to_batches()
            if stop:
                number = np.zeros(table.num_rows, np.int64)
                number[new] = 1
                out = work(table.slice(0, stop).combine_chunks(), np.cumsum(number)[:stop])
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0], pa.int64()), pa.array(out[:, 1], pa.int64())], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows or sum(b.get_total_buffer_size() for b in held) >= size:
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def chains(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the nodes of each block as pairs do that size and bitmap allow.

    ``rows`` (sig, i, j, node, n, label, bits) are sorted by block (sig, i, j). All pairs
    of a block are looked at; at most one row a member leaves it.
    """

    def work(table: pa.Table, block: np.ndarray) -> np.ndarray:
        node, n, label = (table[c].to_numpy() for c in ("node", "n", "label"))
        lists = table["bits"].combine_chunks()
        ends, flat = np.asarray(lists.offsets), lists.values.to_numpy().view(np.uint64)
        bits = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        longs, maps = np.fromiter(map(len, bits), np.int64, len(bits)), by_size(bits)
        forest = Forest(np.arange(len(node)))
        for x, y in neighbours(block, forest, label, n, percent):
            most, size = most_apart(n[x], n[y], percent), np.minimum(longs[x], longs[y])
            ok = np.zeros(len(x), bool)
            for k, m in maps.items():
                at = np.flatnonzero(size == k)
                for part in np.array_split(at, 1 + len(at) * k // (1 << 20)):
                    ok[part] = np.bitwise_count(m[x[part]] ^ m[y[part]]).sum(axis=1, dtype=np.int64) <= most[part]
            forest.join(x[ok], y[ok])
        pairs = np.array(forest.links, np.int64).reshape(-1, 2)
        return np.stack([node[pairs[:, 0]], node[pairs[:, 1]]], axis=1)

    return rows.select("sig", "i", "j", "node", "n", "label", "bits").mapInArrow(blockwise(["sig", "i", "j"], work, 20_000, 1 << 26), "a long, b long")


def linked_members(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the nodes of each block, verified on whole sets.

    ``rows`` (chain, i, j, node, label, items) are sorted by block (chain, i, j). Long
    bitmaps made of the sets leave few pairs to compare but those that link.
    """

    def work(table: pa.Table, block: np.ndarray) -> np.ndarray:
        node, label = table["node"].to_numpy(), table["label"].to_numpy()
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table["items"]]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        found: list[np.ndarray] = []
        edges = np.flatnonzero(np.diff(block)) + 1
        for start, stop in zip([0, *edges], [*edges, len(block)], strict=True):
            if stop - start > 1 and len(np.unique(label[start:stop])) > 1:
                found += one(node[start:stop], label[start:stop], n[start:stop], sets[start:stop])
        return np.array(found, np.int64).reshape(-1, 2)

    def one(node: np.ndarray, label: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> list:
        places = 1 << min(17, max(9, int(16 * n.max() - 1).bit_length()))
        maps = np.stack([bitmap(s, places).view(np.uint64) for s in sets])
        forest = Forest(label)

        def linked(i: int, j: int) -> bool:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)

        for x, y in neighbours(np.zeros(len(node), np.int64), forest, label, n, percent):
            ok = np.zeros(len(x), bool)
            for part in np.array_split(np.arange(len(x)), 1 + len(x) * maps.shape[1] // (1 << 20)):
                ok[part] = np.bitwise_count(maps[x[part]] ^ maps[y[part]]).sum(axis=1, dtype=np.int64) <= most_apart(n[x[part]], n[y[part]], percent)
            forest.join(x[ok], y[ok], linked)
        return [(node[i], node[j]) for i, j in forest.links]

    return rows.select("chain", "i", "j", "node", "label", "items").mapInArrow(blockwise(["chain", "i", "j"], work, 20_000, 1 << 26), "a long, b long")


def in_blocks(members: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Every member in each of its group's blocks: ``sizes`` (key, nb) says into how many parts a group is dealt.

    A block (i, j) has the parts i and j, so that each pair of members meets in one.
    """
    rows = members.join(sizes, key).withColumn("_k", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.withColumns({"i": F.least("_k", "_o"), "j": F.greatest("_k", "_o")}).drop("nb", "_k", "_o")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs of nodes."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("_x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch["_x"], batch["_y"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of (u, v) edges; the root is the smallest node reached."""

    def cut_edges(e: DataFrame) -> tuple[DataFrame, tuple]:
        e = cut(e.filter("u <> v").distinct(), "edges")
        return e, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges, mark = cut_edges(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        before, (edges, after) = edges, cut_edges(small)
        drop_cut(before)
        if after == mark:
            break
        mark = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, n, bits, label) after joining what the links (a, b) join."""
    la, lb = (labels.select(F.col("node").alias(x), F.col("label").alias(y)) for x, y in (("a", "u"), ("b", "v")))
    roots = components(links.join(la, "a").join(lb, "b").select("u", "v"))
    met = labels.join(roots.select(F.col("node").alias("label"), "root"), "label", "left")
    out = cut(met.select("node", "n", "bits", F.coalesce("root", "label").alias("label")), "labels")
    drop_cut(roots)
    drop_cut(labels)
    return out


def after_leaders(labels: DataFrame, index: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, round_: int) -> tuple[DataFrame, int]:
    """Labels after comparing members with their buckets' leaders, and how many were linked."""
    members = index.join(labels.select("node", "n", "label"), "node")
    who = F.struct(F.xxhash64("node", F.lit(round_)).alias("h"), "node", "n", "label")
    lead = members.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(who).alias("lead")).filter("low < high")
    near = members.join(lead.select("sig", F.col("lead.node").alias("lnode"), F.col("lead.n").alias("ln"), F.col("lead.label").alias("llabel")), "sig")
    near = near.filter((F.col("label") != F.col("llabel")) & may_link(F.col("n"), F.col("ln"), percent)).select("node", "lnode").distinct()
    for x, y in (("node", "x"), ("lnode", "y")):
        near = near.join(labels.select(F.col("node").alias(x), F.col("n").alias(f"n{y}"), F.col("bits").alias(f"b{y}")), x)
    near = near.withColumn("d", differ(F.col("bx"), F.col("by"))).filter(F.col("d") <= may_differ(F.col("nx"), F.col("ny"), percent))
    near = near.select("node", "d", F.least("node", "lnode").alias("a"), F.greatest("node", "lnode").alias("b"))
    # of its buckets' leaders a node is compared with the nearest, in this round
    pairs = cut(near.groupBy("node").agg(F.min(F.struct("d", "a", "b")).alias("p")).select("p.a", "p.b").distinct(), f"pairs{round_}")
    linked = 0
    if pairs.limit(1).count():
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        with batches_of(pairs.sparkSession, 100):
            links = cut(verify(pairs, sets, percent).filter("linked"), f"links{round_}")
        drop_cut(sets)
        if linked := links.count():
            labels = relabel(labels, links)
        drop_cut(links)
    drop_cut(pairs)
    return labels, linked


def linked_nodes(nodes: DataFrame, index: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int, rounds: int, block_rows: int = 2_000, block_items: int = 1_000_000) -> DataFrame:
    """(node, label) of the indexed nodes; linked nodes share a label."""
    labels = cut(nodes.select("node", "n", "bits", F.col("node").alias("label")), "labels")
    most = labels.count() // 10
    for round_ in range(rounds):
        labels, linked = after_leaders(labels, index, sets_of, percent, round_)
        if linked <= most:
            break
    # what still shares a bucket across components, block by block
    members = index.join(labels.select("node", "label"), "node")
    mixed = members.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("m")).filter("l < h")
    mixed = mixed.select("sig", F.ceil(F.col("m") / block_rows).cast("int").alias("nb"))
    blocks = in_blocks(members.drop("label"), mixed, "sig").join(labels, "node").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    with batches_of(labels.sparkSession, 2_000):
        chain = components(chains(blocks, percent).toDF("u", "v"))
    if chain.limit(1).count():
        named = chain.select("node", F.col("root").alias("chain"))
        named = cut(named.unionByName(named.select(F.col("chain").alias("node"), "chain").distinct()).join(labels.drop("bits"), "node"), "chains")
        sets = sets_of(named.select("node"))
        parts = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_items)).cast("int").alias("nb")
        blocks = in_blocks(named, named.groupBy("chain").agg(parts), "chain").join(sets, "node")
        with batches_of(labels.sparkSession, 100):
            links = cut(linked_members(blocks.repartition("chain", "i", "j").sortWithinPartitions("chain", "i", "j"), percent), "links")
        drop_cut(sets)
        drop_cut(named)
        if links.limit(1).count():
            labels = relabel(labels, links)
        drop_cut(links)
    drop_cut(chain)
    return labels


def join(df: DataFrame, words: int = 5, percent: int = 80, bits: int = 20, groups: int = 32, rounds: int = 3, broadcast_rows: int = 500_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n (the set's size), node and label of every row; n is 0 and label null for empty sets."""
    if not 50 < percent <= 100:
        raise ValueError("percent must lie above 50, up to 100")
    text = df.select(*dict.fromkeys([*keep, "doc_id", "text"]))
    with batches_of(df.sparkSession, 500):
        order = classes(frequencies(text, bits))
        whole_docs = cut(described(text, list(dict.fromkeys([*keep, "doc_id"])), order, words, percent, groups), "described")
    clashes: list[DataFrame] = []
    docs = whole_docs
    while True:
        names = docs.filter("n > 0").groupBy("node").agg(F.min("_a").alias("a"), F.max("_a").alias("b"), F.min("_b").alias("c"), F.max("_b").alias("d"))
        clash = cut(names.filter("a <> b or c <> d").select("node"), "clash")
        if not clash.limit(1).count():
            drop_cut(clash)
            break
        clashes.append(clash)
        docs = settled(docs, [clash], len(clashes))
    entries = docs.select(F.explode("sigs").alias("sig"), "node")
    shared = entries.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("sig")
    index = cut(entries.join(shared, "sig").distinct(), "index")
    met = docs.join(index.select("node").distinct(), "node", "left_semi")
    least = F.lit(-(2**63)).cast("long")
    nodes = cut(met.groupBy("node").agg(F.min("n").alias("n"), F.min("bits").alias("bits"), F.min(F.coalesce("doc_id", least)).alias("_id")), "nodes")
    docs = cut(docs.drop("sigs", "bits", "_a", "_b"), "docs")
    drop_cut(whole_docs)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                found = [shingles(word_hashes(t.as_py() or "", seen), words)[0] for t in batch["text"].slice(at, 200)]
                names = [node_of(s) for s in found]
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in names], pa.int64()) for i in range(3)), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "_a", "_b", "items"])

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, items): the whole sets of some nodes, read from one document of each."""
        wanted = cut(wanted.join(nodes.select("node", "_id"), "node"), "wanted")
        ids = wanted.select("_id").distinct()
        few = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
        source = text.withColumn("_id", F.coalesce("doc_id", least)).join(F.broadcast(ids) if few else ids, "_id", "left_semi")
        # an id may have several documents, so a node several rows
        with batches_of(df.sparkSession, 500):
            sets = settled(source.select("text").mapInArrow(whole, "node long, _a long, _b long, items binary"), clashes).select("node", "items")
            out = cut(sets.join(F.broadcast(wanted.select("node")) if few else wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
        drop_cut(wanted)
        return out

    labels = linked_nodes(nodes, index, sets_of, percent, rounds).select("node", "label")
    for table in (index, nodes, *clashes):
        drop_cut(table)
    return docs.join(labels, "node", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "node")))


def settled(rows: DataFrame, clashes: list[DataFrame], first: int = 1) -> DataFrame:
    """``rows`` with new names for nodes in ``clashes``, made of the set's 128 bits; only names that different sets share change."""
    for salt, clash in enumerate(clashes, first):
        rows = rows.join(F.broadcast(clash.withColumn("_clash", F.lit(True))), "node", "left")
        rows = rows.withColumn("node", F.when(F.col("_clash"), F.xxhash64("node", "_a", "_b", F.lit(salt))).otherwise(F.col("node"))).drop("_clash")
    return rows


def report(df: DataFrame, words: int = 5, percent: int = 80, **how) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = join(df, words, percent, **how)
    least = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(least, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct(df: DataFrame, words: int = 5, percent: int = 80, broadcast_rows: int = 500_000, **how) -> DataFrame:
    """``df`` with one row of each component, that of the smallest id; rows with empty sets all stay.

    Only the keys of rows that go travel (and of equal rows of which one stays); they
    are broadcast up to ``broadcast_rows`` keys, and joined by a shuffle beyond.
    """
    from brinewave.llm.mixing import row_keys

    key = ["_k1", "_k2"]
    plain = plainly_named(df, "doc_id", "text")
    keyed = plain.select("*", *row_keys(plain))
    rows = join(keyed, words, percent, keep=("doc_id", *key), broadcast_rows=broadcast_rows, **how)
    rows = rows.filter("n > 0").groupBy(*key, "label").agg(F.count("*").alias("_m"), F.min("doc_id").alias("_id"))
    rows = cut(rows, "keys")
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", *key)).alias("best"))
    best = best.select(*(F.col(f"best.{k}").alias(k) for k in key), F.lit(True).alias("_best"))
    decided = rows.join(best, key, "left").select(*key, F.coalesce("_best", F.lit(False)).alias("_again"), "_m")
    decided = cut(decided.filter("not _again or _m > 1").drop("_m"), "decided")
    drop_cut(rows)
    few = decided.limit(broadcast_rows + 1).count() <= broadcast_rows
    met = keyed.join(F.broadcast(decided) if few else decided, key, "left")
    out = met.filter("_again is null")
    if decided.filter("_again").limit(1).count():
        out = out.unionByName(met.filter("_again").dropDuplicates(key))
    return out.select(*plain.columns).toDF(*df.columns)
