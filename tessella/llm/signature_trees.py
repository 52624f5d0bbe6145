"""Similarity join of shingle sets with signature trees.

A document's set holds its distinct n-word shingles (64-bit hashes).  Two
documents link when ``shared / all >= threshold`` (a fraction, compared in
whole numbers).

1. Equal sets collapse to one representative each.
2. Blocking without loss: sets fall into size groups; linked sets of a group
   differ in at most H shingles, so of more than H parts of the hash space at
   least one holds the same shingles in both.  Representatives that share a
   part are candidates, and candidates' components are the buckets of the join;
   parts that very many share count only for sets that have little else.
3. In a bucket the sets stand in the leaves of signature trees, one tree for
   each doubling of the size, similar sets together.  Each node holds the OR and
   the AND of its sets' token bitmaps, as wide as its tree's sets need, and its
   size range.  Two nodes are traversed together only while their greatest
   possible overlap reaches the least that a link needs, and while they are not
   known to lie in one component.  In leaves the bitmaps are compared set by
   set, and what is left is counted exactly.
4. A bucket of more than ``CHUNK_SHINGLES`` is worked on twice.  First it is
   dealt by hash into chunks, each with the bucket's root beside its own sets,
   and each chunk is joined for itself.  Then its sets are dealt again, those of
   a component that is already large into chunks of their own, and pairs of
   chunks meet, but for those that lie in one component already.  So a group of
   near copies of any size, once it hangs together, costs no pairs of chunks.

A document with fewer words than a shingle has its whole word sequence as its
only shingle.  Nulls, empties and ties: a null text or one without words has
an empty set, links with nothing and is its own class; a null identifier sorts
first and comes back as null; rows with one identifier are separate documents;
an empty table gives no rows; columns other than the identifier and the text
are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import common, textkit
from tessella.llm.blobs import planes, planes_back
from tessella.llm.components import components

WORDS, THRESHOLD = 3, Fraction(9, 10)
LEAF, FANOUT = 64, 8
CHUNK_SHINGLES = 2_000_000
#: A part with more members than this is frequent; most sets need not be compared through their frequent parts.
FREQUENT = 8
#: Bytes of a part's key that are kept; two parts that fall together cost a comparison, no more.
KEY_BYTES = 7
SETS = "doc_id long, dup int, n_shingles long, set_a long, set_b long"
BLOBS = "shard int, known boolean, docs binary, dups binary, groups binary, slacks binary, counts binary, keys binary, weights binary"
SHARED = "key long, doc_id long, dup int, `group` int, slack int, n long"
BLOB_TYPES = pa.schema([("shard", pa.int32()), ("known", pa.bool_()), *[(c, pa.binary()) for c in ("docs", "dups", "groups", "slacks", "counts", "keys", "weights")]])
#: Part keys of a task that go out together, at least and at most.
LEAST_KEYS, MOST_KEYS = 1 << 18, 1 << 22
MEMBERS = "bucket long, side int, base long, doc_id long, dup int, shingles binary"
LINKS = "a_doc long, a_dup int, b_doc long, b_dup int"


def shingle_sets(part: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, their bounds)."""
    hashes, _, _, bounds = textkit.word_hashes(*textkit.buffers(part.column("text")), lower=True)
    grams, at = textkit.ngrams(hashes, bounds, n)
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < n))
    row = np.repeat(np.arange(len(counts)), np.diff(at))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            whole[has] = textkit.mix(whole[has] + hashes[bounds[short[has]] + k] * textkit.POW[k + 1])
        grams = np.concatenate([grams, textkit.mix(whole + counts[short].astype(np.uint64))])
        row = np.concatenate([row, short])
    by = np.lexsort((grams, row))
    grams, row = grams[by], row[by]
    if len(grams):
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])])
        grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(counts) + 1))


class Sizes:
    """Size groups and their numbers of parts for a threshold."""

    def __init__(self, threshold: Fraction, most: int = 1 << 40):
        self.t = threshold
        edges = [1]
        # each group must reach over the next one only: a step of more than 1 / threshold
        step = max(Fraction(3, 2), 1 / threshold + Fraction(1, 4))
        while edges[-1] <= most:
            edges.append(max(edges[-1] + 1, int(edges[-1] * step)))
        self.edges = np.array(edges)
        self.reach = [int((e - 1) / threshold) for e in edges[1:]]  # the largest size that links with the group's largest
        self.parts = []
        self.spare = []
        for e in edges[1:]:
            differ = int((e - 1) * (1 - threshold) / threshold)
            empty = math.exp(-float(threshold / (1 - threshold) / step)) if threshold < 1 else 0.0
            spare = 1 + math.ceil(2 * empty * differ)
            self.parts.append(differ + 1 + spare)
            self.spare.append(spare)
        for g in range(len(self.reach) - 1):
            if self.reach[g] >= self.edges[g + 2]:
                raise ValueError("a size group reaches too far")

    def groups(self, n: int) -> list[int]:
        g = int(np.searchsorted(self.edges, n, "right")) - 1
        return [g, g - 1] if g and n <= self.reach[g - 1] else [g]


def part_keys(shingles: np.ndarray, sizes: Sizes) -> list[tuple[int, int, np.ndarray]]:
    """(group, slack, keys): one key for each part of the set, in each of its size groups.

    Linked sets agree in ``spare + 1`` parts or more.  So a set with at most
    ``spare`` empty parts agrees in at least ``slack``, one or more, that are
    not empty.  A set with more empty parts gives keys for them too, and its
    slack is 1.
    """
    out = []
    for g in sizes.groups(len(shingles)):
        count = sizes.parts[g]
        edge = np.searchsorted(shingles, (np.arange(1, count, dtype=np.uint64)) * np.uint64(((1 << 64) - 1) // count))
        bounds = np.concatenate([[0], edge, [len(shingles)]])
        total = np.concatenate([[np.uint64(0)], np.cumsum(textkit.mix(shingles ^ textkit.POW[9]))])
        value = total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)
        salt = np.arange(count, dtype=np.uint64) + np.uint64(g << 40)
        keys = textkit.mix(value + textkit.mix(salt))
        full = np.diff(bounds) > 0
        empty = count - int(full.sum())
        out.append((g, 1, keys) if empty > sizes.spare[g] else (g, sizes.spare[g] + 1 - empty, keys[full]))
    return out


class Parts:
    """The part keys of a chunk of sets: an entry is a set in one of its size groups."""

    def __init__(self, docs: np.ndarray, dups: np.ndarray, shingles: np.ndarray, bounds: np.ndarray, sizes: Sizes):
        entries, keys = [], []
        for row in np.flatnonzero(np.diff(bounds) > 0).tolist():
            for g, slack, own in part_keys(shingles[bounds[row] : bounds[row + 1]], sizes):
                entries.append((row, g, slack, len(own)))
                keys.append(own)
        row, self.group, self.slack, count = np.array(entries, np.int64).reshape(-1, 4).T
        self.doc, self.dup = docs[row].astype(np.int64), dups[row].astype(np.int64)
        self.key = (np.concatenate(keys) if keys else np.zeros(0, np.uint64)) >> np.uint64(64 - 8 * KEY_BYTES)
        self.entry = np.repeat(np.arange(len(row)), count)

    @staticmethod
    def together(parts: list[Parts]) -> Parts:
        out = Parts.__new__(Parts)
        for name in ("group", "slack", "doc", "dup", "key"):
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        before = np.cumsum([0, *(len(p.group) for p in parts)])
        out.entry = np.concatenate([p.entry + n for p, n in zip(parts, before, strict=False)])
        return out

    def blobs(self, shards: int) -> Iterator[dict]:
        """Rows by shard.

        A key that is frequent within the chunk goes once, with its count; the
        entries that have it go to any shard, marked as known, so that no key
        gathers more than a few rows a chunk.
        """
        by = np.argsort(self.key, kind="stable")
        key = self.key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(key)))
        often = np.zeros(len(key), bool)
        often[by] = np.repeat(times > FREQUENT, times)
        weight = np.ones(len(key), np.int64)
        weight[by[first]] = np.where(times > FREQUENT, times, 1)
        lead = np.zeros(len(key), bool)
        lead[by[first]] = True
        spread = ((self.key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % shards
        yield from self._rows(np.flatnonzero(~often | lead), spread, np.where(often, weight, 0), False, shards)
        yield from self._rows(np.flatnonzero(often), (self.entry + self.doc[self.entry]) % shards if len(key) else spread, weight, True, shards)

    def _rows(self, which: np.ndarray, shard: np.ndarray, weight: np.ndarray, known: bool, shards: int) -> Iterator[dict]:
        by = which[np.lexsort((which, shard[which]))]
        edge = np.searchsorted(shard[by], np.arange(shards + 1))
        for s in range(shards):
            own = by[edge[s] : edge[s + 1]]
            if not len(own):
                continue
            entry = self.entry[own]  # ascending, as the keys of an entry stand together
            new = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
            e = entry[new]
            yield {
                "shard": s,
                "known": known,
                "docs": planes(self.doc[e].view(np.uint64), 8),
                "dups": planes(self.dup[e].astype(np.uint64), 4),
                "groups": planes(self.group[e].astype(np.uint64), 1),
                "slacks": planes(self.slack[e].astype(np.uint64), 4),
                "counts": planes(np.diff(np.append(new, len(own))).astype(np.uint64), 4),
                "keys": planes(self.key[own], KEY_BYTES),
                "weights": planes(weight[own].astype(np.uint64), 4),
            }


def shared_parts(blobs: list[dict]) -> pa.RecordBatch:
    """Entries and keys of one shard, for keys that two or more have; a count over FREQUENT means no more than that."""

    def column(name: str, width: int) -> np.ndarray:
        return np.concatenate([np.repeat(planes_back(b[name], width), planes_back(b["counts"], 4).astype(np.int64)) for b in blobs])

    key = np.concatenate([planes_back(b["keys"], KEY_BYTES) for b in blobs])
    weight = np.concatenate([planes_back(b["weights"], 4) for b in blobs]).astype(np.int64)
    known = np.repeat([b["known"] for b in blobs], [int(planes_back(b["counts"], 4).sum()) for b in blobs])
    # a row of weight 0 is one entry, one with a weight stands for as many, which come as known rows
    distinct, which = np.unique(key, return_inverse=True)
    n = np.bincount(which, np.where(known, 0, np.maximum(weight, 1)), len(distinct)).astype(np.int64)[which]
    keep = known | ((weight == 0) & (n > 1))
    n = np.where(known, FREQUENT + 1, n)[keep]
    arrays = [key[keep].view(np.int64), column("docs", 8)[keep].view(np.int64), column("dups", 4)[keep].astype(np.int32), column("groups", 1)[keep].astype(np.int32), column("slacks", 4)[keep].astype(np.int32), n]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["key", "doc_id", "dup", "group", "slack", "n"])


def candidate_edges(shared: DataFrame) -> DataFrame:
    """(a, b) that join the representatives which may link, from the parts that several share.

    Parts of at most ``FREQUENT`` members give their few pairs, and a pair must
    agree in as many of them as its slacks demand, less the frequent parts that
    either has.  A part of more members, such as one that holds nothing but a
    passage that many documents share, joins its members to one of them; but a
    set whose frequent parts are fewer than its slack stays out of these, for
    with each of its partners it agrees in other parts, too.
    """
    marked = shared.withColumn("f", F.count_if(F.col("n") > FREQUENT).over(Window.partitionBy("rep", "group")))

    members = marked.where(F.col("n") <= FREQUENT).groupBy("group", "key").agg(F.sort_array(F.collect_list(F.struct("rep", "slack", "f"))).alias("m"))
    need = lambda x, y: F.greatest(F.lit(1), F.greatest(x["slack"], y["slack"]) - F.least(x["f"], y["f"]))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x["rep"].alias("b"), y["rep"].alias("a"), need(x, y).alias("need")))))
    agreed = members.select("group", F.explode(pairs).alias("p")).groupBy("group", "p.a", "p.b", "p.need").agg(F.count("*").alias("times"))
    rare = agreed.where("times >= need").select("a", "b")

    often = marked.where((F.col("n") > FREQUENT) & (F.col("f") >= F.col("slack"))).select("key", "rep")
    hubs = often.groupBy("key").agg(F.min("rep").alias("hub"))
    kept = often.join(hubs, "key").where("hub != rep").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    return rare.union(kept).distinct()


def set_names(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set; an empty set's are not used."""
    some = np.flatnonzero(np.diff(bounds) > 0)
    a, b = np.zeros(len(bounds) - 1, np.uint64), np.zeros(len(bounds) - 1, np.uint64)
    if len(some):
        a[some] = textkit.mix(np.add.reduceat(textkit.mix(shingles + np.uint64(1)), bounds[some]))
        b[some] = textkit.mix(np.add.reduceat(textkit.mix(shingles ^ textkit.POW[5]), bounds[some]))
    return a, b


class Node:
    __slots__ = ("least", "most", "any", "all", "kids", "items", "one")

    def __init__(self, least, most, any_, all_, kids, items):
        self.least, self.most, self.any, self.all, self.kids, self.items, self.one = least, most, any_, all_, kids, items, False


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a smaller width: a bit stands where any of those that fall on it stands."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words))


class Join:
    """Signature trees over the sets of one bucket, and the links found among them.

    ``base`` numbers the components that the sets are known to lie in.
    """

    def __init__(self, sets: list[np.ndarray], threshold: Fraction, base: list[int] | None = None):
        self.sets, self.t = sets, threshold
        self.size = np.array([len(s) for s in sets])
        self.root = list(range(len(sets)))
        if base is not None:
            first: dict[int, int] = {}
            self.root = [first.setdefault(b, i) for i, b in enumerate(base)]
        self.links: list[tuple[int, int]] = []
        # bitmaps as wide as the sets of their doubling of the size need
        self.group = np.frexp(self.size)[1]
        self.maps: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(sets)
        for g in np.unique(self.group).tolist():
            own = np.flatnonzero(self.group == g)
            bits = min(max(64, 1 << (int(2 * self.size[own].max()) - 1).bit_length()), 1 << 15)
            at = np.concatenate([sets[i] for i in own]) & np.uint64(bits - 1)
            maps = np.zeros((len(own), bits // 64), np.uint64)
            np.bitwise_or.at(maps, (np.repeat(np.arange(len(own)), self.size[own]), (at >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (at & np.uint64(63)))
            for row, i in enumerate(own.tolist()):
                self.maps[i] = maps[row]

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def need(self, total):
        """The least overlap of linked sets whose sizes add up to ``total``."""
        num, den = self.t.numerator, self.t.denominator
        return -(-num * total // (num + den))

    def tree(self, items: list[int]) -> Node:
        # sets that share their least hashes are likely similar
        items = sorted(items, key=lambda i: (self.sets[i][:2].tolist(), i))
        level = []
        for k in range(0, len(items), LEAF):
            own = np.array(items[k : k + LEAF])
            maps = np.stack([self.maps[i] for i in own.tolist()])
            level.append(Node(int(self.size[own].min()), int(self.size[own].max()), np.bitwise_or.reduce(maps), np.bitwise_and.reduce(maps), None, own))
        while len(level) > 1:
            up = []
            for k in range(0, len(level), FANOUT):
                kids = level[k : k + FANOUT]
                up.append(Node(min(x.least for x in kids), max(x.most for x in kids), np.bitwise_or.reduce([x.any for x in kids]), np.bitwise_and.reduce([x.all for x in kids]), kids, np.concatenate([x.items for x in kids])))
            level = up
        return level[0]

    def apart(self, a: Node, b: Node) -> bool:
        """No set of a can link with one of b."""
        if a.most * self.t.denominator < b.least * self.t.numerator or b.most * self.t.denominator < a.least * self.t.numerator:
            return True
        w = min(len(a.any), len(b.any))
        a_any, a_all, b_any, b_all = (folded(x, w) for x in (a.any, a.all, b.any, b.all))
        overlap = min(a.most - int(np.bitwise_count(a_all & ~b_any).sum()), b.most - int(np.bitwise_count(b_all & ~a_any).sum()))
        return overlap < self.need(a.least + b.least)

    def joined(self, a: Node, b: Node) -> bool:
        """All sets of both lie in one component."""
        for x in (a, b):
            if not x.one:
                first = self.find(int(x.items[0]))
                x.one = all(self.find(int(i)) == first for i in x.items)
                if not x.one:
                    return False
        return self.find(int(a.items[0])) == self.find(int(b.items[0]))

    def traverse(self, a: Node, b: Node) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if self.joined(a, b):
                continue
            if a is b:
                if a.kids is None:
                    self.compare(a, b)
                else:
                    stack += [(x, y) for i, x in enumerate(a.kids) for y in a.kids[i + 1 :]]
                    stack += [(x, x) for x in a.kids]  # on top: what a node holds is joined before it meets others
            elif not self.apart(a, b):
                if a.kids is None and b.kids is None:
                    self.compare(a, b)
                elif b.kids is None or a.kids is not None and len(a.items) >= len(b.items):
                    stack += [(x, b) for x in a.kids]
                else:
                    stack += [(a, y) for y in b.kids]

    def compare(self, a: Node, b: Node) -> None:
        """Two leaves, set by set."""
        w = min(len(a.any), len(b.any))
        left = [folded(self.maps[i], w) for i in a.items.tolist()]
        right = np.stack([folded(self.maps[i], w) for i in b.items.tolist()])
        for row, i in enumerate(a.items.tolist()):
            others, maps = (b.items[row + 1 :], right[row + 1 :]) if a is b else (b.items, right)
            if not len(others):
                continue
            n, size = len(self.sets[i]), self.size[others]
            most = np.minimum(n - np.bitwise_count(left[row] & ~maps).sum(axis=1, dtype=np.int64), size - np.bitwise_count(maps & ~left[row]).sum(axis=1, dtype=np.int64))
            for j in others[most >= self.need(n + size)].tolist():
                x, y = self.find(i), self.find(j)
                if x != y and self.shared(i, j) >= self.need(n + len(self.sets[j])):
                    self.root[max(x, y)] = min(x, y)
                    self.links.append((i, j))

    def shared(self, i: int, j: int) -> int:
        both = np.concatenate([self.sets[i], self.sets[j]])
        both.sort(kind="stable")
        return int((both[1:] == both[:-1]).sum())


def join_bucket(sides: list[int], sets: list[np.ndarray], threshold: Fraction, base: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that span the components of a bucket's sets; where there are two sides, of the sets of one with those of the other."""
    join = Join(sets, threshold, base)
    kinds = sorted(set(zip(sides, join.group.tolist(), strict=True)))
    trees = [(side, join.tree([i for i in range(len(sets)) if sides[i] == side and join.group[i] == g])) for side, g in kinds]
    for k, (side, a) in enumerate(trees):
        for other, b in trees[k:]:
            if len(set(sides)) == 1 or side != other:
                join.traverse(a, b)
    return join.links


def similarity_classes(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(doc_id, dup, n_shingles, component_id, rank) for each of ``docs(doc_id, text)``.

    ``component_id`` is the least identifier that links reach, the document's
    own included; a null identifier counts as ``common.NULL_ID`` here.
    """
    rows = common.keyed(docs)
    spark = docs.sparkSession
    common.small_batches(spark)
    n_parts = common.shuffle_partitions(spark)
    sizes = Sizes(threshold)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.regrouped(batches, "text", 4 << 20, 4 << 20):
            shingles, bounds = shingle_sets(part, words)
            a, b = set_names(shingles, bounds)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("dup"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["doc_id", "dup", "n_shingles", "set_a", "set_b"])

    every = common.materialize(rows.mapInArrow(sets, SETS), "sets")
    full = every.where("n_shingles > 0")
    chosen = common.materialize(full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "dup")).alias("rep"), F.first("n_shingles").alias("n")), "representatives")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Parts] = []
        size = 0
        # a block that is large against the number of shards: its rows stay worth their overhead
        enough = min(MOST_KEYS, max(LEAST_KEYS, 512 * n_parts))
        for part in textkit.regrouped(batches, "text", 4 << 20, 4 << 20):
            shingles, bounds = shingle_sets(part, words)
            docs, dups = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "dup"))
            held.append(Parts(docs, dups, shingles, bounds, sizes))
            size += len(held[-1].key)
            if size >= enough:
                yield from as_batches(Parts.together(held).blobs(n_parts))
                held, size = [], 0
        if held:
            yield from as_batches(Parts.together(held).blobs(n_parts))

    def as_batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        some: list[dict] = []
        for row in rows:
            some.append(row)
            if len(some) == 256:
                yield pa.RecordBatch.from_pylist(some, schema=BLOB_TYPES)
                some = []
        if some:
            yield pa.RecordBatch.from_pylist(some, schema=BLOB_TYPES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard after the other; a partition's rows come sorted by shard."""
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["shard"] != held[0]["shard"]:
                    yield shared_parts(held)
                    held = []
                held.append(row)
        if held:
            yield shared_parts(held)
        textkit.release()

    # both joins of whole texts sort and merge at every size: neither side's size is bounded
    blobs = rows.join(chosen.select("rep.doc_id", "rep.dup").hint("merge"), ["doc_id", "dup"], "left_semi").mapInArrow(parts, BLOBS)
    shared = common.materialize(blobs.repartition(n_parts, "shard").sortWithinPartitions("shard").mapInArrow(count, SHARED), "shared-parts")
    # where no identifier comes twice, it alone is the node of the graph: a number, not a pair
    alone = not every.where("dup != 0").limit(1).count()

    def node(doc: str, dup: str) -> Column:
        return F.col(doc) if alone else F.struct(F.col(doc).alias("doc_id"), F.col(dup).alias("dup"))

    def parts_of(column: str) -> tuple[Column, Column]:
        return (F.col(column), F.lit(0)) if alone else (F.col(f"{column}.doc_id"), F.col(f"{column}.dup"))

    buckets = components(candidate_edges(shared.withColumn("rep", node("doc_id", "dup"))))
    common.discard(spark, shared.scratch_path)
    nodes = chosen.select(node("rep.doc_id", "rep.dup").alias("node"), "n")
    whole = buckets.select("node", "root").union(buckets.select(F.col("root").alias("node"), "root").distinct())
    sized = common.materialize(whole.join(nodes, "node"), "bucket-members")
    common.discard(spark, buckets.scratch_path)
    totals = sized.groupBy("root").agg(F.sum("n").alias("total")).select("root", F.ceil(F.col("total") / CHUNK_SHINGLES).cast("int").alias("chunks"))

    def join_members(asked: DataFrame) -> DataFrame:
        """(a, b) of the links found in the tasks that ``asked(node, bucket, side, base)`` lists."""
        doc, dup = parts_of("node")
        listed = asked.select(doc.alias("doc_id"), dup.alias("dup"), F.struct("bucket", "side", "base").alias("task")).groupBy("doc_id", "dup").agg(F.collect_list("task").alias("tasks"))
        found = rows.join(listed.hint("merge"), ["doc_id", "dup"]).select("doc_id", "dup", "text", "tasks").mapInArrow(members, MEMBERS).repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(join, LINKS)
        return found.select(node("a_doc", "a_dup").alias("a"), node("b_doc", "b_dup").alias("b"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.regrouped(batches, "text", 4 << 20, 4 << 20):
            shingles, bounds = shingle_sets(part, words)
            lists = part.column("tasks")
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            tasks = [lists.flatten().field(k) for k in range(3)]
            raw = shingles.tobytes()
            k = 0
            while k < len(row):  # 16 MB at a time
                size = np.cumsum(bounds[row[k : k + 2000] + 1] - bounds[row[k : k + 2000]])
                end = k + max(1, int(np.searchsorted(size, 2 << 20)))
                own = row[k:end]
                payload = [raw[8 * s : 8 * e] for s, e in zip(bounds[own].tolist(), bounds[own + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(t.slice(k, len(own)) for t in tasks), part.column("doc_id").take(pa.array(own)), part.column("dup").take(pa.array(own)), pa.array(payload, pa.binary())], ["bucket", "side", "base", "doc_id", "dup", "shingles"])
                k = end

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets one after the other; a partition's rows come sorted by bucket."""
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[1], x[3], x[4]))
            base = None if held[0][2] is None else [x[2] for x in held]
            found = join_bucket([x[1] for x in held], [np.frombuffer(x[5], np.uint64) for x in held], threshold, base)
            a, b = ([held[pair[k]] for pair in found] for k in range(2))
            columns = [pa.array([x[3] for x in a], pa.int64()), pa.array([x[4] for x in a], pa.int32()), pa.array([x[3] for x in b], pa.int64()), pa.array([x[4] for x in b], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["a_doc", "a_dup", "b_doc", "b_dup"])

        for batch in batches:
            for item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and item[0] != held[0][0]:
                    yield flush()
                    held = []
                held.append(item)
        if held:
            yield flush()

    # first every chunk for itself; the root stands in all chunks of its bucket
    dealt = sized.join(totals, "root")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    everywhere = F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(chunk))
    first = dealt.select("node", "root", F.explode(everywhere).alias("chunk"))
    first = first.select("node", F.xxhash64("root", "chunk").alias("bucket"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("base"))
    links = common.materialize(join_members(first), "links")
    if totals.where("chunks > 1").limit(1).count():
        second = common.materialize(join_members(chunk_pairs(dealt.where("chunks > 1"), components(links))), "more-links")
        links = links.union(second)
    roots = components(links)
    named = chosen.select("set_a", "set_b", node("rep.doc_id", "rep.dup").alias("node")).join(roots, "node", "left").select("set_a", "set_b", F.coalesce("root", "node").alias("root"))
    linked = full.join(named, ["set_a", "set_b"])
    single = every.where("n_shingles = 0").withColumn("root", node("doc_id", "dup"))
    columns = ["doc_id", "dup", "n_shingles", parts_of("root")[0].alias("component_id"), (node("doc_id", "dup") == F.col("root")).alias("first")]
    return linked.select(*columns).unionByName(single.select(*columns))


def chunk_pairs(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(node, bucket, side, base): the pairs of chunks that ``members(node, root, n, chunks)`` of large buckets have still to meet in.

    ``joined(node, root)`` are the components so far.  A component with more
    than half a chunk of shingles has chunks of its own; the others of a bucket
    are mixed.  A bucket that is one component has no pairs.
    """
    own = members.join(joined.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = own.groupBy("root", "part").agg(F.sum("n").alias("total"))
    parts = parts.withColumn("large", 2 * F.col("total") > CHUNK_SHINGLES)
    buckets = parts.groupBy("root").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("large"), 0).otherwise(F.col("total"))).alias("small")).where("parts > 1")
    parts = parts.join(buckets, "root").withColumn("chunks", F.ceil(F.when(F.col("large"), F.col("total")).otherwise(F.col("small")) / CHUNK_SHINGLES).cast("int"))
    placed = own.select("node", "root", "part").join(parts.select("root", "part", "large", "chunks"), ["root", "part"])
    number = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("node")).otherwise(F.col("part"))), F.col("chunks"))
    placed = common.materialize(placed.select("node", "root", F.xxhash64("part").alias("base"), F.when(F.col("large"), F.xxhash64("part")).alias("pure"), F.xxhash64(F.when(F.col("large"), F.xxhash64("part")), number).alias("chunk")), "chunked")
    chunks = placed.groupBy("root", "chunk").agg(F.first("pure").alias("pure"))  # few rows a bucket
    other = chunks.select("root", F.col("chunk").alias("other"), F.col("pure").alias("other_pure"))
    meet = chunks.join(other, "root").where("chunk <= other and not coalesce(pure = other_pure, false)")
    bucket = F.xxhash64("root", "chunk", "other")
    left = meet.select("root", "chunk", bucket.alias("bucket"), F.lit(0).alias("side"))
    right = meet.where("chunk < other").select("root", F.col("other").alias("chunk"), bucket.alias("bucket"), F.lit(1).alias("side"))
    return placed.join(left.union(right), ["root", "chunk"]).select("node", "bucket", "side", "base")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_classes(common.documents(spark, sf_dir))
    return found.select(common.original_id().alias("doc_id"), "n_shingles", common.original_id("component_id").alias("component_id"))


#: The query's rows by counting what every two documents share, and following links.
ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
  items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
  shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS total, count(*) AS c FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90 GROUP BY a.doc_id, b.doc_id),
  links AS (SELECT a, b FROM shared WHERE 100 * c >= 90 * (total - c)),
  edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s"""
