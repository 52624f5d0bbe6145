"""Step groups and ranks."""

from __future__ import annotations

from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st

from tessella.llm import packing
from tests.llm.test_edges import documents, frame, prose


@given(st.lists(st.tuples(st.sampled_from([1, 2, 64, 256, 512, 1024, 2048]), st.integers(1, 10**6)), max_size=400), st.booleans())
def test_groups_have_equal_tokens(items, last):
    groups = packing.step_groups(items, 4096, last)
    full = sum(n for n, _ in items) // 4096
    assert [sum(items[i][0] for i in g) for g in groups[:full]] == [4096] * full and len(groups) <= full + 1
    seen = Counter(i for g in groups for i in g)
    assert set(seen.values()) <= {1} and (not last or len(seen) == len(items))


def test_ranks_have_equal_tokens():
    items = [(2048, k * 37 % 101) for k in range(64)] + [(512, k) for k in range(256)]
    ranks = packing.deal(items, 8)
    tokens, cost = Counter(), Counter()
    for (n, c), r in zip(items, ranks, strict=True):
        tokens[r] += n
        cost[r] += c
    assert set(tokens.values()) == {32768} and max(cost.values()) < 1.1 * min(cost.values())


def test_steps_of_a_table(spark):
    rows = documents() + [(1000 + k, prose(k, 30 + k * 13 % 900)) for k in range(300)]
    pieces = packing.pack_documents(frame(spark, rows), step_tokens=16_384, ranks=4).collect()
    steps, ranks = Counter(), defaultdict(Counter)
    for p in pieces:
        if p["offset"] == 0:
            steps[p["step_id"]] += p["sequence_length"]
            ranks[p["step_id"]][p["rank"]] += p["sequence_length"]
    smaller = [s for s, n in steps.items() if n != 16_384]
    assert len(smaller) <= 3 and len(steps) > 4  # one for each partition
    assert all(max(r.values()) - min(r.values()) <= 2048 and set(r) == {0, 1, 2, 3} for s, r in ranks.items() if s not in smaller)
    by_sequence = defaultdict(set)
    for p in pieces:
        by_sequence[p["sequence_id"]].add((p["step_id"], p["rank"], p["sequence_length"]))
    assert all(len(v) == 1 for v in by_sequence.values())


def test_a_text_beyond_a_chunk(spark):
    text = " ".join(f"word{k}" for k in range(700_000))  # 7 MB
    pieces = packing.pack_documents(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string").coalesce(1)).collect()
    own = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == 1)
    assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[0][0] == 0
    assert own[-1][0] + own[-1][1] == next(p["doc_tokens"] for p in pieces if p["doc_id"] == 1) > 1_000_000
