"""Texts that are longer than the blocks that the operators work in."""

from __future__ import annotations

import numpy as np
import pytest


def test_texts_beyond_a_block_in_the_other_operators(spark):
    """Each operator's longest text here is longer than the blocks that it works in."""
    import zlib
    from fractions import Fraction

    from tessella.llm import common, language_id, mixing, signature_trees, sstable, tokens, tree_weighting

    text = " ".join(f"word{k % 3001} {k}" for k in range(420_000))  # 6 MB
    near = text[: len(text) - 7_000]
    rows = spark.createDataFrame([(1, text, "en", "src0"), (2, near, "en", "src0"), (3, "a short one", "en", "src0")], "doc_id long, text string, lang string, source string").coalesce(1)
    classes = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in signature_trees.similarity_classes(rows, 3, Fraction(9, 10)).collect()}
    assert classes[1] == (len(text.split()) - 2, 1) and classes[2][1] == 1 and classes[3] == (1, 3)
    found = {r["doc_id"]: r for r in language_id.identify(rows, rows).collect()}
    assert found[1]["lang_pred"] == "en" and found[1]["cross_entropy"] == pytest.approx(found[2]["cross_entropy"], rel=0.05)
    scored = {r["doc_id"]: r for r in tree_weighting.score_documents(rows).collect()}
    assert scored[1]["n_tokens"] == len(text.split()) + 1 and scored[1]["score"] < scored[2]["score"] < 0
    assert scored[2]["bits_per_byte"] == pytest.approx(scored[1]["bits_per_byte"], rel=0.02)
    code = tokens.encoder(tokens.default_tokenizer()).tokenizer
    kept = {r["doc_id"]: r for r in sstable.read_shards(sstable.write_shards(rows, common.scratch(spark, "long"))).collect()}
    ids = [*code.encode(text, add_special_tokens=False).ids, 0]
    assert kept[1]["n_tokens"] == len(ids) and kept[1]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    taken = {r["doc_id"]: r["tokens"] * r["copies"] + r["cut_tokens"] for r in mixing.mix(rows, share=(1, 2), max_epochs=1).collect()}
    assert sum(taken.values()) == (len(text.split()) + len(near.split()) + 3) // 2
