"""Scores, threshold and verdicts against plain Python with the same hash."""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np
import pytest
import xxhash

from tessella.llm import quality_rules
from tests.llm.test_edges import WORD, brute_base, frame, prose


def spark_hash(*values) -> int:
    """Spark's xxhash64 of strings or longs, one seeding the next."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed % 2**64)
        seed -= 2**64 if seed >= 2**63 else 0
    return seed


def buckets(text: str, count: int) -> list[int]:
    h = [spark_hash(w) for w in WORD.findall(text)]
    return [x % count for x in h] + [spark_hash(a, b) % count for a, b in zip(h, h[1:], strict=False)]


def test_verdicts_by_hand(spark):
    rng = np.random.default_rng(8)
    odd = [f"junk{k}" for k in range(400)]
    rows = [(k, prose(k, 60 + k)) for k in range(30)] + [(100 + k, " ".join(rng.choice(odd, 80))) for k in range(10)]
    rows += [(200, "same words again " * 40), (201, prose(3, 20)), (202, None), (203, prose(77, 90) + " " + " ".join(odd[:40])), (None, prose(1, 70))]
    trusted, count, spreads = [*range(20), 200, 201], 256, 2.0
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows), spark.createDataFrame([(k,) for k in trusted], "doc_id long"), count, spreads).collect()}
    grams = {i: buckets(t or "", count) for i, t in rows}
    target, raw = Counter(b for i in trusted for b in grams[i]), Counter(b for v in grams.values() for b in v)
    t, r = sum(target.values()), sum(raw.values())
    score = {i: sum(np.log((target[b] + 1) / (t + count)) - np.log((raw[b] + 1) / (r + count)) for b in v) / max(1, len(v)) for i, v in grams.items()}
    failed = {}
    for i, text in rows:
        n, _, _, _, again = brute_base(text or "")
        failed[i] = n < 50 or 100 * again > 50 * n
    good = [score[i] for i in trusted if not failed[i]]
    limit = np.mean(good) - spreads * np.std(good)
    verdicts = Counter()
    for i, _ in rows:
        assert got[i]["score"] == pytest.approx(score[i], abs=1e-9) and got[i]["threshold"] == pytest.approx(limit, abs=2e-9)
        assert got[i]["base_failed"] == failed[i] and got[i]["kept"] == (not failed[i] and score[i] >= limit)
        verdicts[got[i]["kept"], got[i]["base_failed"]] += 1
    assert min(verdicts[True, False], verdicts[False, False], verdicts[False, True]) >= 3


def test_a_text_beyond_a_block(spark):
    long = " ".join(f"w{k % 5000}" for k in range(700_000))  # 4 MB
    row = quality_rules.judge(frame(spark, [(1, long), (2, "few words")]), spark.createDataFrame([(1,)], "doc_id long")).where("doc_id = 1").first()
    assert row["n_words"] == 700_000 and row["n_repeat_words"] == 700_000 and row["base_failed"]
