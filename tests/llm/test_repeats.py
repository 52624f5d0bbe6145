"""Hot anchors, small chunks and long texts for the two operators that remove repeats."""

from __future__ import annotations

import numpy as np
import pytest

from tessella.llm import repeats, seed_extend, suffix_dedup
from tests.llm.test_edges import brute_bytes, brute_words, frame, multiset, prose

BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def rows_with_common_parts():
    """Passages shorter and longer than the windows, in other surroundings, and whole copies, not in the order of their identifiers."""
    short, long = prose(400, 9), prose(401, 60)
    rows = [(k, f"{prose(500 + k, 25)} {short} {prose(600 + k, 25)}") for k in range(60)]
    rows += [(100 + k, f"{prose(700 + k, 8)} {long} {prose(800 + k, 8)}") for k in range(60)]
    rows += [(300 - k, prose(900 + k % 3, 50)) for k in range(60)]
    return rows + [(400, "ab" * 900), (401, "ab" * 500), (None, long), (None, long), (402, " ".join(["word"] * 300))]


@pytest.mark.parametrize("chunk", [400, 1 << 20])
@pytest.mark.parametrize("seen_hot", [2, 10**9])
def test_anchors_that_are_dealt_by_contents(spark, monkeypatch, chunk, seen_hot):
    monkeypatch.setattr(repeats, "SEEN_HOT", seen_hot)
    monkeypatch.setattr(repeats, "HOT_SHARE", 1e-9 if seen_hot == 2 else 0.25)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    rows = rows_with_common_parts()
    assert multiset(suffix_dedup.remove_repeats(frame(spark, rows)), *BYTES) == brute_bytes(rows, 100)
    assert multiset(seed_extend.remove_repeats(frame(spark, rows), 12), *WORDS) == brute_words(rows, 12)


def test_what_a_task_has_seen():
    rng = np.random.default_rng(0)
    for bits in (1, 12):
        seen = repeats.Seen()
        seen.BITS = bits
        first: dict = {}
        for _ in range(200):
            key = rng.permutation(40)[:20].astype(np.uint64) << np.uint64(58)
            place = rng.integers(0, 6, (3, 20))
            later = seen.later(key, *place)
            for k, p, gone in zip(key.tolist(), zip(*place.tolist(), strict=True), later.tolist(), strict=True):
                assert not gone or first[k] < p  # only what has an earlier equal goes
                first[k] = min(first.get(k, p), p)


def test_texts_beyond_a_block(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(40_000)])
    text = " ".join(rng.choice(words, 900_000))  # 6 MB: more than a chunk and a block
    rows = [(1, text), (2, text[3_000_000:] + " tail"), (3, "short " + text[:500])]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["n_bytes"] == len(text)
    assert got[2]["n_removed"] == len(text) - 3_000_000 and got[3]["n_removed"] == 500
    got = {r["doc_id"]: r for r in seed_extend.remove_repeats(frame(spark, rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["n_words"] == 900_000
    cut = len(text[3_000_000:].split())
    assert cut - 2 <= got[2]["n_removed"] <= cut and got[3]["n_words"] - 3 <= got[3]["n_removed"] < got[3]["n_words"]
