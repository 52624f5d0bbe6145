"""Removal of repeated byte strings with suffix arrays built block by block.

Windows of ``length`` bytes that may repeat are gathered by anchor
(``repeats``); a block holds the contents of whole anchors, a few MB.  In a
block the suffixes are sorted as in difference-cover construction:

* ``COVER`` is a difference cover modulo ``PERIOD``: for any two places i, j
  there is a shift below ``PERIOD`` that brings both onto sampled places.  The
  sampled suffixes are ranked first.
* All suffixes that start a window are dealt into buckets by their first eight
  bytes, and one bucket is sorted at a time, which bounds memory.  The sort
  compares ``PERIOD`` bytes; suffixes still tied are settled by the ranks of
  the sampled suffixes at the shift of each pair (a three-way quicksort that
  works on all tied groups at once).
* Neighbours in the suffix array that share ``length`` bytes form one class;
  all but the first in (doc_id, start) order are repeats.

Nulls, empties and ties: a null text is empty; a null identifier sorts first
and comes back as null; rows with one identifier are separate documents in the
order of their texts.  Texts shorter than the window lose nothing.  Matches
never cross documents.  Columns other than the identifier and the text are
never read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import common, repeats, textkit

LENGTH = 100
GRAM = 24
PERIOD = 32
COVER = np.array([*range(8), *range(8, PERIOD, 8)])
BUCKET = 1 << 18
CHUNK_BYTES = 2 << 20
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def shift_table(period: int = PERIOD, cover: np.ndarray = COVER) -> np.ndarray:
    """shift[i, j]: the least s with (i + s) and (j + s) both in the cover, modulo the period."""
    inside = np.zeros(period, bool)
    inside[cover] = True
    s = np.arange(period)
    hits = inside[(s[:, None] + s) % period]  # [place, shift]
    both = hits[:, None, :] & hits[None, :, :]
    if not both.any(axis=2).all():
        raise ValueError("not a difference cover")
    return both.argmax(axis=2)


SHIFT = shift_table()


def word_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers that sort like the bytes; the text ends in padding."""
    return np.ndarray((len(text) - 7,), ">u8", text.tobytes(), strides=(1,))


def refine(words: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort places by ``depth`` bytes within ascending groups; returns (places, their new groups, ascending from 0)."""
    for k in range(0, depth, 8):
        if not len(at):
            break
        size = np.bincount(group)
        tied = size[group] > 1
        if not tied.any():
            break
        part, own = at[tied], group[tied]
        key = words[part + k].astype(np.uint64)
        by = np.lexsort((key, own))
        at[tied] = part[by]
        key, own = key[by], own[by]
        split = np.zeros(len(at), bool)
        split[0] = True
        split[1:] = group[1:] != group[:-1]
        inner = np.zeros(len(own), bool)
        inner[1:] = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        split[tied] |= inner
        group = np.cumsum(split) - 1
    return at, group


def cover_ranks(text: np.ndarray, words: np.ndarray, total: int, depth: int) -> np.ndarray:
    """Ranks of the sampled suffixes by their first ``depth`` bytes or more, at their places."""
    every = np.arange(0, total, PERIOD)[:, None] + COVER
    at = every.reshape(-1)
    at = at[at < total]
    at, group = refine(words, at, np.zeros(len(at), np.int64), depth)
    rank = np.zeros(total, np.int64)
    rank[at] = group
    return rank


def settle_ties(at: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order places inside their (ascending) groups by cover ranks."""
    at, live = at.copy(), np.arange(len(at))
    while len(live):
        size = np.bincount(group[live], minlength=int(group.max()) + 1)
        live = live[size[group[live]] > 1]
        if not len(live):
            break
        own, place = group[live], at[live]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        count = np.diff(np.append(first, len(own)))
        pivot = np.repeat(place[first + count // 2], count)
        shift = SHIFT[pivot % PERIOD, place % PERIOD]
        side = np.sign(rank[place + shift] - rank[pivot + shift])
        by = np.lexsort((side, own))
        at[live] = place[by]
        own, side = own[by], side[by]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (side[1:] != side[:-1])])
        group[live] = np.flatnonzero(new)[np.cumsum(new) - 1] + int(group.max()) + 1
        live = live[side != 0]
    return at


def sorted_suffixes(text: np.ndarray, starts: np.ndarray, total: int, length: int) -> Iterator[np.ndarray]:
    """The suffix array of the given places, one bucket at a time; suffixes are told apart by ``length`` bytes at least."""
    words = word_at(text)
    rank = cover_ranks(text, words, total, length)
    head = words[starts].astype(np.uint64)
    cuts = np.zeros(0, np.uint64)
    if len(starts) > BUCKET:
        sample = np.sort(head[:: max(1, len(head) // 65536)])
        cuts = np.unique(sample[:: max(1, len(sample) * BUCKET // len(starts))])
    bucket = np.searchsorted(cuts, head, "right")
    for b in range(len(cuts) + 1):
        at = starts[bucket == b] if len(cuts) else starts
        if len(at):
            at, group = refine(words, at.copy(), np.zeros(len(at), np.int64), PERIOD)
            yield settle_ties(at, group, rank)


def same_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    out = np.ones(len(a), bool)
    for k in [*range(0, length - 7, 8), length - 8]:
        out &= words[a + k] == words[b + k]
    return out


def scan(part: pa.RecordBatch, length: int = LENGTH) -> repeats.Stretches:
    data, at = textkit.buffers(part.column("text"))
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return repeats.Stretches(none, none, none, none, none)
    raw = np.ndarray((n - 7,), "<u8", data.tobytes(), strides=(1,))
    gram = textkit.mix(raw[: n - GRAM + 1] * textkit.POW[1] + textkit.mix(raw[8 : n - GRAM + 9] * textkit.POW[2] + textkit.mix(raw[16:].copy())))

    def content(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = size.astype(np.uint64)
        for k in range(0, int(size.max()), 8):
            # past its last eight bytes a stretch adds nothing more than those again
            out = (out ^ raw[start + np.minimum(k, size - 8)]) * textkit.POW[3]
            out ^= out >> np.uint64(29)
        return textkit.mix(out)

    return repeats.stretches(gram, at, length, GRAM, content)


def extract(data, at, row, pos, len_, anchor, length: int = LENGTH):
    start = at[row] + pos
    size = len_ + length - 1
    raw = data.tobytes()
    payload = [raw[s : s + k] for s, k in zip(start.tolist(), size.tolist(), strict=True)]
    digest = np.zeros(len(start), np.uint64)
    single = len_ == 1
    if single.any():
        view = np.ndarray((len(data) - 7,), "<u8", raw, strides=(1,))
        out = np.zeros(int(single.sum()), np.uint64)
        for k in [*range(0, length - 7, 8), length - 8]:
            out = textkit.mix(out + view[start[single] + k])
        digest[single] = out
    return payload, np.zeros(len(start), np.int64), digest


def resolve(payload: pa.Array, len_, head, bucket, doc, dup, pos, length: int = LENGTH):
    data, at = textkit.buffers(payload)
    total = len(data)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.concatenate([data, np.zeros(length + PERIOD + 16, np.uint8)])
    which = np.repeat(np.arange(len(len_)), len_)
    window = np.arange(len(which)) - np.repeat(np.cumsum(len_) - len_, len_)
    starts = at[:-1][which] + window
    owner = np.zeros(total, np.int64)
    owner[starts] = np.arange(len(starts))
    words = word_at(text)
    repeated: list[np.ndarray] = []
    for order in sorted_suffixes(text, starts, total, length):
        own = owner[order]
        new = np.concatenate([[True], ~same_prefix(words, order[:-1], order[1:], length)])
        kind = np.cumsum(new) - 1
        by = np.lexsort((pos[which[own]] + window[own], dup[which[own]], doc[which[own]], kind))
        again = np.concatenate([[False], kind[by][1:] == kind[by][:-1]])
        # the same place may stand in a block twice, in two stretches; it is no repeat of itself
        repeated.append(own[by[again]])
    found = np.concatenate(repeated) if repeated else np.zeros(0, np.int64)
    return which[found], window[found]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] | None = None) -> DataFrame:
    """For each of ``docs(doc_id, text)``: bytes, bytes removed, removed runs and the SHA-256 of what is kept.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier (smaller identifier, or same document and earlier start) in the
    input.  ``keep``, even if empty, adds the kept text, without the halves of
    characters that a cut went through, and those columns of ``docs``.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    with_text = keep is not None
    keep = keep or ()
    rows = common.keyed(docs, *keep)
    spans = repeats.repeated_windows(
        rows, length, lambda p: scan(p, length), lambda *a: extract(*a, length=length), lambda *a: resolve(*a, length=length), "suffix", CHUNK_BYTES
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.regrouped(batches, "text", 4 << 20, 4 << 20):
            data, at = textkit.buffers(part.column("text"))
            out: list[tuple] = []
            for row, (doc, spans) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("spans"), strict=True)):
                own = data[at[row] : at[row + 1]]
                removed = count = 0
                if spans.is_valid and len(spans):
                    pos, len_ = (spans.values.field(k).to_numpy() for k in range(2))
                    gone = repeats.covered(pos, len_, length, len(own))
                    removed = int(gone.sum())
                    count = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = own[~gone].tobytes()
                else:
                    kept = own.tobytes()
                out.append((None if doc == common.NULL_ID else doc, len(own), removed, count, hashlib.sha256(kept).hexdigest(), *([kept.decode(errors="ignore")] if with_text else [])))
            columns = list(zip(*out, strict=True))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
            arrays = [pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*arrays, *(part.column(k) for k in keep)], [*names[: len(arrays)], *keep])

    schema = RESULT + ", text string" * with_text + "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return repeats.with_spans(rows, spans).select("doc_id", "text", "spans", *keep).mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir))
