"""Character models against their definition, many scripts, long texts, rejection and scores."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import language_id

#: First letter and number of letters.
SCRIPTS = {"latin": (0x61, 26), "cyrillic": (0x430, 32), "greek": (0x3B1, 25), "hebrew": (0x5D0, 27), "georgian": (0x10D0, 33), "armenian": (0x561, 38), "devanagari": (0x915, 37), "han": (0x4E00, 3000)}


def made_up(rng, script: str, words: int) -> str:
    first, count = SCRIPTS[script]
    return " ".join("".join(chr(first + int(k)) for k in rng.integers(0, count, int(rng.integers(2, 9)))) for _ in range(words))


def brute_model(texts: list[str], order: int, symbols: int):
    """Interpolated Kneser-Ney by dictionaries: probability of a symbol after a context; a text begins at boundaries, as a space is one."""
    padded = [[" "] * (order - 1) + list(t) for t in texts]
    runs = Counter(tuple(p[i - order + 1 : i + 1]) for p in padded for i in range(order - 1, len(p)))
    counts = {order: runs}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(r[1:] for r in counts[n + 1])
    level = {}
    for n in range(1, order + 1):
        times = Counter(counts[n].values())
        d = times[1] / (times[1] + 2 * times[2]) if times[1] and times[2] else 0.5
        total, kinds = Counter(), Counter()
        for run, c in counts[n].items():
            total[run[:-1]] += c
            kinds[run[:-1]] += 1
        level[n] = (d, total, kinds)

    def prob(context: tuple, symbol: str, n: int) -> float:
        if not n:
            return 1.0 / symbols
        d, total, kinds = level[n]
        own = context[len(context) - n + 1 :]
        below = prob(context, symbol, n - 1)
        if not total[own]:
            return below
        return max(counts[n][(*own, symbol)] - d, 0) / total[own] + d * kinds[own] / total[own] * below

    return prob


def test_model_equals_its_definition():
    rng = np.random.default_rng(1)
    texts = [made_up(rng, "latin", 30) for _ in range(6)]
    column = pa.record_batch([pa.array(["x"] * 6), pa.array(texts)], ["lang", "text"])
    found = language_id.models(pa.Table.from_batches([language_id.counted(column)]))
    alphabet = {c for t in texts for c in t}
    prob = brute_model(texts, language_id.ORDER, len(alphabet) + 1)
    for text in (texts[0][:60], made_up(rng, "latin", 8), "zzz\u0416 qq", "e"):
        padded = [" "] * (language_id.ORDER - 1) + list(text)
        want = -np.mean([np.log(prob(tuple(padded[i - language_id.ORDER + 1 : i]), padded[i], language_id.ORDER)) for i in range(language_id.ORDER - 1, len(padded))])
        assert found.entropies(pa.array([text]))[0][0, 0] == pytest.approx(want, rel=1e-9)
    for context in ((" ", " ", " "), tuple(texts[0][3:6]), ("q", "q", "q")):
        total = sum(prob(context, c, language_id.ORDER) for c in alphabet) + prob(context, "never seen", language_id.ORDER)
        assert total == pytest.approx(1.0)


def test_scripts_are_told_apart(spark):
    rng = np.random.default_rng(2)
    teach = spark.createDataFrame([(made_up(rng, k, 40), k) for k in SCRIPTS for _ in range(60)], "text string, lang string")
    rows = spark.createDataFrame([(i, made_up(rng, k, 40), k) for i, k in enumerate(list(SCRIPTS) * 30)], "doc_id long, text string, lang string")
    found = language_id.identify(rows, teach, keep=("lang", "text")).collect()
    for k in SCRIPTS:
        assert sum(r["lang_pred"] == k and not r["rejected"] for r in found if r["lang"] == k) >= 29
    # a language that was not learned is rejected, though a share of its texts must go somewhere
    unknown = language_id.identify(rows.where("lang = 'georgian'"), teach.where("lang != 'georgian'")).collect()
    assert all(r["rejected"] for r in unknown)


def test_scores_say_how_sure_the_model_is(spark):
    rng = np.random.default_rng(3)
    letters = {"a": "abcdefgh", "b": "cdefghij"}  # most letters are common to both
    text = lambda k, n: " ".join("".join(rng.choice(list(letters[k]), int(rng.integers(2, 6)))) for _ in range(n))
    teach = spark.createDataFrame([(text(k, 30), k) for k in letters for _ in range(100)], "text string, lang string")
    rows = spark.createDataFrame([(i, text("ab"[i % 2], 1 + i % 5)) for i in range(400)], "doc_id long, text string")
    found = language_id.identify(rows, teach).collect()
    right = [r["score"] for r in found if r["lang_pred"] == "ab"[r["doc_id"] % 2]]
    wrong = [r["score"] for r in found if r["lang_pred"] != "ab"[r["doc_id"] % 2]]
    assert wrong and np.mean(right) > np.mean(wrong) + 0.05 and all(0 <= r["score"] <= 1 for r in found)
    assert np.std([r["score"] for r in found]) > 0.01


def test_long_texts_in_pieces_equal_whole_ones(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [made_up(rng, "latin", 400), "\u00e9\u4e2d \u0416" * 900, made_up(rng, "cyrillic", 300), "  ,, ab" + " " * 700 + "cd", "!" * 900]
    column = pa.record_batch([pa.array(["x", "y", "z", "x", "y"]), pa.array(texts)], ["lang", "text"])
    table = pa.Table.from_batches([language_id.counted(column)])
    model = language_id.models(table)
    want = model.entropies(column.column("text"))
    monkeypatch.setattr(language_id, "PIECE", 101)
    got = model.entropies(column.column("text"))
    for a, b in zip(want, got, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-9)
    pieces = Counter()
    for r in language_id.counted(column).to_pylist():
        pieces[r["lang"], *(r[f"c{k}"] for k in range(4))] += r["n"]
    assert pieces == {(r["lang"], *(r[f"c{k}"] for k in range(4))): r["n"] for r in table.to_pylist()}
