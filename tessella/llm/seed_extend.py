"""Removal of repeated word sequences by seed and extend.

Seeds are winnowed: of the hashes of ``GRAM`` words in a window, the least.
Documents meet on their common seeds (``repeats`` joins the stretches of
windows by seed).  From a seed each stretch is extended word by word to the
left and to the right; hashes of the extensions tell, for every reach to
either side at once, which stretches still agree.  Where ``length`` words agree
with an earlier place, the match is kept, and matches that overlap or follow
each other merge into maximal repeats, which are removed.

Words are runs without space, tab, LF, VT, FF or CR and compared by 64-bit
hash.  Nulls, empties and ties: a null text has no words; a null identifier
sorts first and comes back as null; rows with one identifier are separate
documents in the order of their texts; texts shorter than the window lose
nothing; matches never cross documents.  Columns other than the identifier and
the text are never read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm import common, repeats, textkit

LENGTH = 20
GRAM = 8
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def grams(hashes: np.ndarray) -> np.ndarray:
    """The hash of the GRAM words from each place on, rows not minded."""
    n = len(hashes) - GRAM + 1
    out = hashes[:n] * textkit.POW[1]
    for k in range(1, GRAM):
        out = textkit.mix(out + hashes[k : n + k] * textkit.POW[k + 1])
    return out


def scan(part: pa.RecordBatch, length: int = LENGTH) -> repeats.Stretches:
    hashes, _, _, bounds = textkit.word_hashes(*textkit.buffers(part.column("text")))
    if len(hashes) < length:
        none = np.zeros(0, np.int64)
        return repeats.Stretches(none, none, none, none, none)

    def content(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = size.astype(np.uint64)
        for k in range(int(size.max())):
            out = (out ^ hashes[start + np.minimum(k, size - 1)]) * textkit.POW[3]
            out ^= out >> np.uint64(29)
        return textkit.mix(out)

    return repeats.stretches(grams(hashes), bounds, length, GRAM, content)


def extract(data, at, row, pos, len_, anchor, length: int = LENGTH):
    """Payload: the hashes of a stretch's words; head: where its seed lies in them."""
    hashes, _, _, bounds = textkit.word_hashes(data, at)
    start = bounds[row] + pos
    size = len_ + length - 1
    raw = hashes.tobytes()
    payload = [raw[8 * s : 8 * (s + k)] for s, k in zip(start.tolist(), size.tolist(), strict=True)]
    gram = grams(hashes)
    head = np.zeros(len(start), np.int64)
    todo = np.arange(len(start))
    for k in range(2 * length):
        if not len(todo):
            break
        hit = gram[start[todo] + np.minimum(k, size[todo] - GRAM)] == anchor[todo].view(np.uint64)
        head[todo[hit]] = np.minimum(k, size[todo[hit]] - GRAM)
        todo = todo[~hit]
    digest = np.zeros(len(start), np.uint64)
    single = len_ == 1
    if single.any():
        out = np.zeros(int(single.sum()), np.uint64)
        for k in range(length):
            out = textkit.mix(out + hashes[start[single] + k])
        digest[single] = out
    return payload, head, digest


def resolve(payload: pa.Array, len_, head, bucket, doc, dup, pos, length: int = LENGTH):
    data, at = textkit.buffers(payload)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = np.frombuffer(data.tobytes(), np.uint64)
    first = at[:-1] // 8
    size = np.diff(at) // 8
    seed = first + head
    reach = length - GRAM
    # left[j], right[j]: hashes of the extensions by j words; past the stretch's end they stay
    left, right = [np.zeros(len(seed), np.uint64)], [np.zeros(len(seed), np.uint64)]
    for j in range(reach):
        to_left, to_right = seed - 1 - j, seed + GRAM + j
        left.append(textkit.mix(left[-1] + textkit.POW[1] * hashes[np.maximum(to_left, first)]))
        right.append(textkit.mix(right[-1] + textkit.POW[2] * hashes[np.minimum(to_right, first + size - 1)]))
    found_which, found_window = [], []
    for j in range(reach + 1):
        window = head - j  # the window that reaches j words to the left of the seed
        own = np.flatnonzero((window >= 0) & (window < len_))
        if not len(own):
            continue
        key = textkit.mix(bucket[own].view(np.uint64) + textkit.mix(left[j][own] + textkit.POW[4] * right[reach - j][own]))
        again = ~repeats.earliest((pos[own] + window[own], dup[own], doc[own]), key)
        found_which.append(own[again])
        found_window.append(window[own[again]])
    return np.concatenate(found_which), np.concatenate(found_window)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """For each of ``docs(doc_id, text)``: words, words removed and the SHA-256 of the kept words, joined by one space.

    A word goes if a run of ``length`` words that covers it also starts earlier
    (smaller identifier, or same document and earlier start) in the input.
    ``with_text`` adds the kept words.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    rows = common.keyed(docs)
    spans = repeats.repeated_windows(
        rows, length, lambda p: scan(p, length), lambda *a: extract(*a, length=length), lambda *a: resolve(*a, length=length), "seeds"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.regrouped(batches, "text", 4 << 20, 4 << 20):
            data, at = textkit.buffers(part.column("text"))
            starts, sizes, bounds = textkit.words(data, at)
            gone = np.zeros(len(starts), bool)
            for row, spans in enumerate(part.column("spans")):
                if spans.is_valid and len(spans):
                    pos, len_ = (spans.values.field(k).to_numpy() for k in range(2))
                    gone[bounds[row] : bounds[row + 1]] = repeats.covered(pos, len_, length, int(bounds[row + 1] - bounds[row]))
            # kept words with one space after each, all rows in one buffer
            s, n = starts[~gone], sizes[~gone]
            wide = n + 1
            ends = np.cumsum(wide)
            begin = ends - wide
            joined = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            source = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            joined[source + np.repeat(begin, n)] = data[source + np.repeat(s, n)]
            raw = joined.tobytes()
            before = np.concatenate([[0], np.cumsum(~gone)])[bounds]
            edge = np.concatenate([[0], ends])[before]
            out = []
            for row, doc in enumerate(part.column("doc_id").to_pylist()):
                total = int(bounds[row + 1] - bounds[row])
                kept = raw[edge[row] : max(edge[row], edge[row + 1] - 1)]
                out.append((None if doc == common.NULL_ID else doc, total, total - int(before[row + 1] - before[row]), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, pa.int64() if k < 3 else pa.string()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: len(arrays)])

    return repeats.with_spans(rows, spans).select("doc_id", "text", "spans").mapInArrow(cut, RESULT + (", text string" if with_text else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir))


#: The query's rows by comparing every window with every other through its words.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
  places AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d),
  ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s:s + 19], ' ') ORDER BY doc_id, s) AS r FROM places),
  gone AS (SELECT DISTINCT doc_id, s + i AS pos FROM ranked, range(0, 20) AS t(i) WHERE r > 1),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
  kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.pos) AS text, count(*) AS n FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - COALESCE(k.n, 0) AS n_removed, sha256(COALESCE(k.text, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
