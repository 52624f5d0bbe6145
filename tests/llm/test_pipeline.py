from __future__ import annotations

import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_edges import brute_roots, documents, frame

DATA = "/root/testdata/sf0.001"


def test_stages_take_and_return_documents(spark):
    docs = frame(spark).select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert tuple(found.columns) == corpus_pipeline.COLUMNS, name


def test_one_of_each_group_stays(spark):
    docs = frame(spark).select(*corpus_pipeline.COLUMNS)
    kept = [r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()]
    documents_, _, roots = brute_roots(documents(), corpus_pipeline.WORDS, 4, 5)
    assert sorted(map(str, kept)) == sorted(str(documents_[k][0]) for k in set(roots))
    assert {1, 4, 6, 7, 8} <= set(kept) and not {2, 3} & set(kept)


@pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")
def test_run(spark):
    pieces = corpus_pipeline.run(spark, DATA).collect()
    totals: dict = {}
    for p in pieces:
        totals[p["doc_id"]] = totals.get(p["doc_id"], 0) + p["length"]
        assert p["offset"] + p["length"] <= 2048
    assert totals and all(totals[p["doc_id"]] == p["doc_tokens"] for p in pieces)


def test_pipeline_yields_the_ids_of_its_sequences(spark):
    docs = spark.createDataFrame([(k, "some words of a text " * (40 * k + 1), "en", "src0", 0) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {p["doc_id"] for p in pieces} == set(range(6))
    for p in pieces:
        assert len(p["ids"]) == p["length"]
        assert zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"]


def test_stages_on_nulls_empty_tables_and_repeated_rows(spark):
    text = "some words of a text that is long enough to be told from others by its letters alone "
    rows = [(None, None, None, None, None), (None, text, "en", "src0", 5), (None, text, "en", "src0", 5), (3, text * 3, None, None, None), (3, text * 3, None, None, None), (4, "", "en", "src1", 0), (5, None, "en", "src1", 0)]
    rows += [(10 + k, f"number {k} " + " ".join(f"{w}{k}" for w in text.split()), "en", "src2", 9) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert found.columns == docs.columns and found.count() <= docs.count(), name
        assert stage(spark, docs.where("doc_id < -9"), DATA).collect() == [], name
    kept = corpus_pipeline.one_of_each_group(spark, docs, DATA).collect()
    counts = Counter(r["doc_id"] for r in kept)  # one of two equal rows stays, and texts without words link with nothing
    assert counts == {None: 2, 3: 1, 4: 1, 5: 1} | {10 + k: 1 for k in range(8)}
    known = corpus_pipeline.known_language(spark, docs, DATA).collect()
    assert not {4, 5} & {r["doc_id"] for r in known} and all(r["text"] for r in known)
    pieces = corpus_pipeline.packed(spark, docs, DATA)
    assert Counter(r["doc_id"] for r in pieces.where("start = 0").collect()) == Counter(r[0] for r in rows)


def test_cut_texts_keep_their_white_space(spark):
    from tessella.llm import mixing

    df = spark.createDataFrame([(" a\n b\t\tc  d", n) for n in range(6)] + [("", 1), ("x", 3)], "t string, n long")
    found = [r[0] for r in df.select(mixing.first_tokens(F.col("t"), F.col("n"))).collect()]
    assert found == ["", " a", " a\n b", " a\n b\t\tc", " a\n b\t\tc  d", " a\n b\t\tc  d", "", "x"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")
def test_the_mixture_takes_what_its_definition_takes(spark):
    """The stage against plain Python: budgets from the operator's own leaves, documents by md5 order."""
    import hashlib
    import re

    from tessella.llm import common, mixing

    docs = common.documents(spark, DATA)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    rows = docs.select(*corpus_pipeline.COLUMNS).collect()
    domain = {r["source"]: r["domain"] for r in docs.select("source", mixing.domain_of(F.coalesce("source", F.lit("unknown"))).alias("domain")).distinct().collect()}
    leaf = lambda r: (domain[r["source"]], r["lang"] or "unknown", r["source"] or "unknown")
    supply: Counter = Counter()
    for r in rows:
        supply[leaf(r)] += len(word.findall(r["text"] or ""))
    frame_ = spark.createDataFrame([(*k, v) for k, v in supply.items()], "domain string, language string, origin string, supply long")
    given = {tuple(b[:3]): b["given"] for b in mixing.leaf_budgets(frame_, mixing.WEIGHTS, corpus_pipeline.SHARE, corpus_pipeline.EPOCHS).collect()}
    want: Counter = Counter()
    for k, budget in given.items():
        copies, rest = divmod(budget, supply[k]) if supply[k] else (0, 0)
        own = sorted((r for r in rows if leaf(r) == k), key=lambda r: (hashlib.md5(f"{mixing.SEED}/{copies}/{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), len(word.findall(r["text"] or "")), hashlib.md5((r["text"] or "").encode()).hexdigest()))
        sofar = 0
        for r in own:
            text = r["text"] or ""
            spans = [m.end() for m in word.finditer(text)]
            if copies:
                want[r["doc_id"], text] += 1
            elif sofar < rest:
                take = min(len(spans), rest - sofar)
                want[r["doc_id"], text if take == len(spans) else text[: spans[take - 1]]] += 1
            sofar += len(spans)
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.mixed(spark, docs, DATA).collect()) == want
