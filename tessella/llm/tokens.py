"""Exact tokenisation of Arrow batches with the tokenizers library.

The byte-level pre-tokeniser never joins a non-space character with a
following single space, so a text may be cut before each space that stands
alone between two visible characters; the ids of the pieces, concatenated,
are the ids of the text.  Each distinct piece is encoded once per worker and
remembered, up to ``MEMO`` pieces and ``MEMO_IDS`` ids.
"""

from __future__ import annotations

import os

import numpy as np

from tessella.llm.textkit import range_hashes

MEMO, MEMO_IDS = 1_500_000, 30_000_000
#: Pieces that the library gets at once; what it gives back for each is large.
STEP = 16_384
_LOADED: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.uint32)
        self.ids = np.zeros(0, self.kind)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, their bounds) for rows of UTF-8 bytes with offsets ``at``."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        cuts = cut_points(data, at)
        lengths = np.diff(np.append(cuts, len(data)))
        hashes = range_hashes(data, cuts, lengths)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MEMO or len(self.ids) > MEMO_IDS:
            self.forget()
        slot = np.searchsorted(self.keys, distinct)
        slot[slot == len(self.keys)] = 0
        known = self.keys[slot] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            raw = data.tobytes()
            new = np.flatnonzero(~known)
            sizes, flat = [np.zeros(0, np.int64)], [self.ids]
            for k in range(0, len(new), STEP):
                part = new[k : k + STEP]
                texts = [raw[s : s + n].decode() for s, n in zip(cuts[first[part]].tolist(), lengths[first[part]].tolist(), strict=True)]
                coded = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
                flat.append(np.fromiter((i for x in coded for i in x), self.kind, int(sizes[-1].sum())))
            sizes = np.concatenate(sizes)
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys)
            self.starts = np.concatenate([self.starts, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.uint32)])[order]
            self.lengths = np.concatenate([self.lengths, sizes.astype(np.uint32)])[order]
            self.ids = np.concatenate(flat)
            self.keys = keys[order]
            slot = np.searchsorted(self.keys, distinct)
        slot = slot[which]
        sizes = self.lengths[slot].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[slot] - (ends - sizes), sizes) + np.arange(int(ends[-1]))].astype(np.uint32)
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(cuts, at)]


def cut_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row starts, and spaces between visible characters.

    Beyond ASCII only characters of two bytes with a lead of 0xC3 or more count
    as visible: no white space lies among them.
    """
    n = len(data)
    plain = (data > 0x20) & (data < 0x7F)
    lead = (data >= 0xC3) & (data <= 0xDF)
    before = np.zeros(n, bool)
    before[1:] = plain[:-1]
    before[2:] |= lead[:-2]
    after = np.zeros(n, bool)
    after[:-1] = plain[1:] | lead[1:]
    cut = (data == 0x20) & before & after
    edge = at[at < n]
    cut[edge] = True
    # a space whose neighbour belongs to another row is no cut of its own; rows are cut anyway
    return np.flatnonzero(cut)


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
