"""Hierarchical packing of documents into sequences of several context sizes.

A document's ids (with the end id) are cut into full windows of the longest
size; what is left goes to the shortest tier that holds it.  From the longest
tier down each piece opens a window of its tier's size.  The gap is filled
from shorter tiers, the largest piece that fits first; a last gap takes the
beginning of a cut piece, whose rest returns to its tier.  So every window is
full.  What remains when a chunk of documents runs out, less than one window,
is cut into powers of two, so no sequence needs padding.

Sequences of all sizes form step groups of exactly ``step_tokens`` tokens where
the sizes are powers of two, as they are by default: from the largest size down
each sequence goes to the group with the fewest tokens so far and, of these,
with the least cost, the sum of squared piece lengths.  Within a group they are
dealt to ranks in the same way, so ranks have equal tokens.  What does not fill
a group waits for the next documents of the partition; only a partition's last
group is smaller.

Documents are packed where they are read, about 4 MB of text at a time: no
shuffle, and no group can become hot.  A document longer than that is a chunk
of its own.  A null text is empty, a null identifier stays null, repeated rows
are packed like any others, an empty table gives no rows, and columns other
than the identifier and the text are never read.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, textkit
from tessella.llm.tokens import default_tokenizer, encoder

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS, RANKS = 128 * 2048, 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_id long, rank int"


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences as (size, [(document, start, length)]); each size is a tier or, for the last few, a power of two."""
    longest = tiers[-1]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    queues: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, document, start), ascending

    def route(piece: tuple[int, int, int]) -> None:
        if piece[0]:
            bisect.insort(queues[tiers[bisect.bisect_left(tiers, piece[0])]], piece)

    for doc, n in enumerate(lengths):
        full = n // longest
        out += [(longest, [(doc, k * longest, longest)]) for k in range(full)]
        if n % longest:
            t = tiers[bisect.bisect_left(tiers, n % longest)]
            queues[t].append((n % longest, doc, full * longest))
    for q in queues.values():
        q.sort()
    rest: list[tuple[int, int, int]] = []
    for level in range(len(tiers) - 1, -1, -1):
        size, own = tiers[level], queues[tiers[level]]
        while own:
            n, doc, start = own.pop()
            window, gap = [(doc, start, n)], size - n
            while gap:
                # the largest piece of a shorter tier that fits, else the beginning of one that does not
                for t in [*tiers[level - 1 :: -1]] * bool(level):
                    if (k := bisect.bisect_right(queues[t], (gap, 2**62, 2**62))) > 0:
                        n, doc, start = queues[t].pop(k - 1)
                        break
                else:
                    source = next((queues[t] for t in tiers[: level + 1] if queues[t]), None)
                    if source is None:
                        break
                    n, doc, start = source.pop()
                    if n > gap:
                        route((n - gap, doc, start + gap))
                        n = gap
                window.append((doc, start, n))
                gap -= n
            if gap:
                rest += [(n, doc, start) for doc, start, n in window]
            else:
                out.append((size, window))
    left = sum(n for n, _, _ in rest)
    power = longest
    while left:
        while power > left:
            power //= 2
        window, gap = [], power
        while gap:
            n, doc, start = rest.pop()
            if n > gap:
                rest.append((n - gap, doc, start + gap))
                n = gap
            window.append((doc, start, n))
            gap -= n
        out.append((power, window))
        left -= power
    return out


def deal(items: list[tuple[int, int]], bins: int, room: int | None = None) -> list[int]:
    """A bin for each (tokens, cost), -1 where none has room: the largest first, each to the bin with the fewest tokens, then the least cost."""
    heap = [(0, 0, k) for k in range(bins)]
    placed = [-1] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], -items[i][1], i)):
        tokens, cost, k = heap[0]
        if room is not None and tokens + items[i][0] > room:
            continue
        heapq.heapreplace(heap, (tokens + items[i][0], cost + items[i][1], k))
        placed[i] = k
    return placed


def step_groups(items: list[tuple[int, int]], step_tokens: int, last: bool = False) -> list[list[int]]:
    """Groups of sequences, given as (tokens, cost), with ``step_tokens`` each; with ``last`` the rest is a group, too."""
    steps = sum(n for n, _ in items) // step_tokens
    groups: list[list[int]] = [[] for _ in range(steps)]
    placed = deal(items, steps, step_tokens) if steps else [-1] * len(items)
    for i, k in enumerate(placed):
        if k >= 0:
            groups[k].append(i)
    rest = [i for i, k in enumerate(placed) if k < 0]
    return groups + [rest] * bool(last and rest)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, ranks: int = RANKS, with_ids: bool = False) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)``; ``with_ids`` adds the ids themselves."""
    common.small_batches(docs.sparkSession)
    path = tokenizer_path or default_tokenizer()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_id", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base = encoder(path), TaskContext.get().partitionId() << 40
        step = base
        # sequences that no step has yet: (size, cost, rows without step and rank, ids)
        waiting: list[tuple[int, int, list[tuple], list[np.ndarray]]] = []

        def steps(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal step, waiting
            gone: set[int] = set()
            for group in step_groups([w[:2] for w in waiting], step_tokens, last):
                rows, kept = [], []
                for i, rank in zip(group, deal([waiting[i][:2] for i in group], ranks), strict=True):
                    rows += [(*row, step, rank) for row in waiting[i][2]]
                    kept += waiting[i][3]
                step += 1
                gone.update(group)
                columns = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int32() if name == "rank" else pa.int64()) for name, c in zip(names, columns, strict=True)]
                if with_ids:
                    sizes = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(kept).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)
            waiting = [w for i, w in enumerate(waiting) if i not in gone]

        for part in textkit.regrouped(batches, "text", 4 << 20, 4 << 20):
            ids, bounds = code.encode(*textkit.buffers(part.column("text")))
            doc_ids = part.column("doc_id").to_pylist()
            lengths = (np.diff(bounds) + 1).tolist()
            first = bounds[:-1].tolist()
            sequences = pack(lengths, tiers)
            for number, (size, window) in enumerate(sequences):
                offset, rows, kept = 0, [], []
                for doc, start, n in window:
                    own = ids[first[doc] + start : first[doc] + min(start + n, lengths[doc] - 1)]
                    if len(own) < n:
                        own = np.append(own, np.uint32(end_id))
                    rows.append((doc_ids[doc], start, n, zlib.crc32(own.astype("<u4").tobytes()), lengths[doc], base + number, offset, size))
                    if with_ids:
                        kept.append(own.copy())
                    offset += n
                waiting.append((size, sum(n * n for _, _, n in window), rows, kept))
            base += len(sequences)
            del ids
            yield from steps(False)
        yield from steps(True)

    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return wanted.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
