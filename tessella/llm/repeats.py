"""Repeated windows across a corpus, found through shared anchors.

Every window of fixed length has an anchor, the least hash among its short
grams.  Neighbouring windows mostly share it, so a text falls into a chain of
*stretches*, runs of windows with one anchor.  Equal windows have equal anchors
at equal places, hence two windows need to be compared only if their stretches
have the same anchor.

1. ``scan`` makes the stretches of a chunk of documents.  Stretches with equal
   contents collapse to the earliest, per chunk and then per task (``Seen``),
   so that a passage with any number of copies sends about one row a task.
2. One shuffle by anchor collapses the rest and finds the anchors that lie in
   stretches with different contents.  ``hot_anchors`` looks for anchors that
   would fill a task, in a sample of the documents: their stretches are dealt
   by anchor and contents.  The sample steers where rows go, never the result.
3. Only the stretches of those anchors go, with their contents, to ``resolve``,
   which compares them window by window, a bounded block at a time.  Hot
   anchors, and others with over ``HOT`` stretches, are dealt out by window
   instead, after the same collapse, so that no anchor becomes one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common, textkit

HOT = 50_000
BLOCK_BYTES = 2 << 20
CHUNK_BYTES = 3 << 20
#: An anchor is hot with this share of a task's mean load; it must then be seen ``SEEN_HOT`` times in the sample.
HOT_SHARE, SEEN_HOT, SAMPLE_DOCS, CHARS_A_STRETCH = 0.25, 16, 500, 24
STRETCH = "anchor long, content long, doc_id long, dup int, pos long, len int, known boolean, hot boolean"
PAYLOAD = "bucket long, doc_id long, dup int, pos long, len int, head int, payload binary"
SPANS = "doc_id long, dup int, pos long, len long"


@dataclass
class Stretches:
    """Runs of windows of a chunk: row, first window's place in it, number of windows, anchor's hash and contents' hash."""

    row: np.ndarray
    pos: np.ndarray
    len: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def stretches(gram: np.ndarray, bounds: np.ndarray, length: int, k: int, content: Callable) -> Stretches:
    """Cut rows of units with ``bounds`` into stretches; ``gram`` has the hash of the k units from each place on."""
    none = np.zeros(0, np.int64)
    counts = np.diff(bounds) - length + 1
    some = counts > 0
    if not some.any():
        return Stretches(none, none, none, none, none)
    least = textkit.sliding_argmin(gram, length - k + 1)
    edge = np.zeros(len(least) + 1, np.int32)
    np.add.at(edge, bounds[:-1][some], 1)
    np.add.at(edge, bounds[:-1][some] + counts[some], -1)
    at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    anchor = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    new[np.searchsorted(at, bounds[:-1][some])] = True
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    start = at[first]
    row = np.searchsorted(bounds, start, "right") - 1
    return Stretches(row, start - bounds[row], n, gram[anchor[first]], content(start, n + length - 1))


def earliest(order: tuple[np.ndarray, ...], key: np.ndarray) -> np.ndarray:
    """Whether each element is the first of its key in the order given (most significant last, as for lexsort)."""
    by = np.lexsort((*order, key))
    out = np.zeros(len(key), bool)
    if len(key):
        sorted_key = key[by]
        out[by[np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])]] = True
    return out


class Seen:
    """Keys that a task has passed on, and from which place.

    A table of fixed size in which a later key takes the place of an earlier
    one: what is forgotten costs a row more, never a result.
    """

    BITS = 18

    def __init__(self):
        self.key = np.zeros(1 << self.BITS, np.uint64)
        self.place = np.full((3, 1 << self.BITS), np.iinfo(np.int64).max)

    def later(self, key: np.ndarray, *place: np.ndarray) -> np.ndarray:
        """Whether a key was passed on from an earlier place (doc, dup, pos) before; the others are remembered."""
        slot = (key >> np.uint64(64 - self.BITS)).astype(np.int64)
        before = np.zeros(len(key), bool)
        for own, held in zip(place[::-1], self.place[::-1], strict=True):
            before = (held[slot] < own) | ((held[slot] == own) & before)
        out = (self.key[slot] == key) & before
        new = np.flatnonzero(~out)
        self.key[slot[new]] = key[new]
        for own, held in zip(place, self.place, strict=True):
            held[slot[new]] = own[new]
        return out


def hot_anchors(docs: DataFrame, scan: Callable, chunk: int) -> np.ndarray:
    """The anchors that hold more than ``HOT_SHARE`` of what a task gets on average, ascending: a few for each task at most.

    They are looked for in documents drawn by hash, as many as it takes to see
    such an anchor ``SEEN_HOT`` times.
    """
    n = common.shuffle_partitions(docs.sparkSession)
    chars, count = docs.agg(F.sum(F.length("text").cast("long")), F.count("*")).first()
    if not chars:
        return np.zeros(0, np.uint64)
    share = min(1.0, max(SEEN_HOT / HOT_SHARE * n * CHARS_A_STRETCH / chars, SAMPLE_DOCS / count))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "dup"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.regrouped(batches, "text", chunk, chunk):
            found, times = np.unique(scan(part).anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.uint64).view(np.int64)), pa.array(times.astype(np.int64))], ["anchor", "n"])

    least = max(SEEN_HOT, int(HOT_SHARE * share * chars / CHARS_A_STRETCH / n))
    hot = drawn.mapInArrow(anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r[0] for r in hot.select("anchor").collect()], np.int64).view(np.uint64))


def inside(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def runs(doc: np.ndarray, dup: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Windows as (doc, dup, first, count) of neighbours."""
    by = np.lexsort((pos, dup, doc))
    doc, dup, pos = doc[by], dup[by], pos[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (dup[1:] != dup[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    return [doc[first], dup[first], pos[first], np.diff(np.append(first, len(doc)))]


def repeated_windows(docs: DataFrame, length: int, scan: Callable, extract: Callable, resolve: Callable, name: str, chunk: int | None = None) -> DataFrame:
    """(doc_id, dup, pos, len): the windows of ``common.keyed`` documents, as runs of starts, that also start earlier.

    ``scan(batch) -> Stretches``; ``extract(text, starts, lens) -> (payloads,
    heads)``, a head being the place of the anchor where the method needs it;
    ``resolve(payloads, lens, heads, buckets, doc, dup, pos) -> (which, window)``
    of the windows that are not the earliest of their contents in the block.
    """
    docs = docs.select("doc_id", "dup", "text")
    chunk = chunk or CHUNK_BYTES
    spark = docs.sparkSession
    common.small_batches(spark)
    n = common.shuffle_partitions(spark)

    hot = hot_anchors(docs, scan, chunk)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for part in textkit.regrouped(batches, "text", chunk, chunk):
            s = scan(part)
            if not len(s.row):
                continue
            doc, dup = (part.column(c).to_numpy(zero_copy_only=False)[s.row] for c in ("doc_id", "dup"))
            known = ~earliest((s.pos, dup, doc), s.content)
            rest = np.flatnonzero(~known)
            known[rest] = seen.later(s.content[rest], doc[rest], dup[rest], s.pos[rest])
            # what is known to be a copy is only passed on; a place of its own keeps it out of the anchors' groups
            anchor = np.where(known, textkit.mix(s.content + doc.astype(np.uint64) * textkit._ODD + s.pos.astype(np.uint64)), s.anchor)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (anchor.view(np.int64), s.content.view(np.int64), doc.astype(np.int64), dup.astype(np.int32), s.pos.astype(np.int64), s.len.astype(np.int32), known, inside(hot, anchor) & ~known)],
                ["anchor", "content", "doc_id", "dup", "pos", "len", "known", "hot"],
            )

    same = Window.partitionBy("deal", "content").orderBy("known", "doc_id", "dup", "pos")
    near = Window.partitionBy("deal")
    found = (
        docs.mapInArrow(find, STRETCH)
        .withColumn("deal", F.when(F.col("hot"), F.xxhash64("anchor", "content")).otherwise(F.col("anchor")))
        .repartition(n, "deal")
        .withColumn("place", F.row_number().over(same))
        .withColumn("mixed", F.col("hot") | (F.min("content").over(near) != F.max("content").over(near)))
        .withColumn("many", F.col("hot") | (F.count("*").over(near) > HOT))
        .withColumn("known", F.col("known") | (F.col("place") > 1))
        .where("known or mixed")
        .select("doc_id", "dup", "pos", "len", F.when(~F.col("known"), F.col("anchor")).alias("anchor"), "many")
    )
    found = common.materialize(found, f"{name}-stretches")
    asked = found.where("anchor is not null").groupBy("doc_id", "dup").agg(F.sort_array(F.collect_list(F.struct("pos", "len", "anchor", "many"))).alias("asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for part in textkit.regrouped(batches, "text", chunk, chunk):
            data, at = textkit.buffers(part.column("text"))
            lists = part.column("asked")
            item = lists.flatten()
            pos, len_, anchor, many = (item.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            bound = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            row = np.repeat(np.arange(part.num_rows), np.diff(bound))
            single = many.astype(bool)
            # a hot anchor's stretches are taken apart into windows
            times = np.where(single, len_, 1)
            step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            row, pos, anchor, single = (np.repeat(x, times) for x in (row, pos, anchor, single))
            pos = pos + step
            len_ = np.where(single, 1, np.repeat(len_, times))
            payload, head, digest = extract(data, at, row, pos, len_, anchor)
            doc, dup = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "dup"))
            bucket = np.where(single, digest.view(np.int64), anchor)
            first = earliest((pos, dup, doc), np.where(single, digest, textkit.mix(np.arange(len(digest), dtype=np.uint64))))
            again = ~first & single
            rest = np.flatnonzero(single & first)
            again[rest] = seen.later(digest[rest], doc[rest], dup[rest], pos[rest])
            # copies of windows that the task has passed on: no payload; resolve() passes them on
            payload = [None if gone else p for p, gone in zip(payload, again.tolist(), strict=True)]
            bucket = np.where(again, textkit.mix(doc.astype(np.uint64) + pos.astype(np.uint64)).view(np.int64), bucket)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), pa.array(doc.astype(np.int64)), pa.array(dup.astype(np.int32)), pa.array(pos.astype(np.int64)), pa.array(len_.astype(np.int32)), pa.array(head.astype(np.int32)), pa.array(payload, pa.binary())],
                ["bucket", "doc_id", "dup", "pos", "len", "head", "payload"],
            )

    def settle(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        bucket, doc, dup, pos, len_, head = (table.column(c).to_numpy() for c in ("bucket", "doc_id", "dup", "pos", "len", "head"))
        null = np.asarray(table.column("payload").is_null())
        live = np.flatnonzero(~null)
        which, window = resolve(table.column("payload").take(pa.array(live)), len_[live], head[live], bucket[live], doc[live], dup[live], pos[live])
        which = live[which]
        gone = np.flatnonzero(null)
        out = runs(np.concatenate([doc[which], doc[gone]]), np.concatenate([dup[which], dup[gone]]), np.concatenate([pos[which] + window, pos[gone]]))
        return pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int64)), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int64)), pa.array(out[3].astype(np.int64))], ["doc_id", "dup", "pos", "len"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of whole buckets; a partition's rows come sorted by bucket."""
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            while True:
                held.append(table)
                size += table.nbytes
                if size < BLOCK_BYTES:
                    break
                whole = pa.concat_tables(held)
                key = whole.column("bucket").to_numpy()
                last = int(np.searchsorted(key, key[-1]))
                held, size = [whole.slice(last)], 0
                if last:
                    yield settle(whole.slice(0, last))
                break
        if held:
            yield settle(pa.concat_tables(held))

    detail = docs.join(asked, ["doc_id", "dup"]).mapInArrow(fetch, PAYLOAD).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(compare, SPANS)
    return found.where("anchor is null").select("doc_id", "dup", "pos", F.col("len").cast("long").alias("len")).unionByName(detail)


def covered(pos: np.ndarray, len_: np.ndarray, length: int, total: int) -> np.ndarray:
    """Mask of the units of one row that lie in a window whose start is in the runs (pos, len)."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, np.minimum(pos + len_ - 1 + length, total), -1)
    return np.cumsum(edge[:-1]) > 0


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the list of their spans; the exchange of the texts is the one that ``repeated_windows`` made."""
    listed = spans.groupBy("doc_id", "dup").agg(F.collect_list(F.struct("pos", "len")).alias("spans"))
    return docs.join(listed, ["doc_id", "dup"], "left")
