"""Keys, folders and file systems."""

from __future__ import annotations

from collections import Counter

import pytest

from tessella.llm import common


@pytest.mark.parametrize("keep", [(), ("lang",)])
def test_rows_that_share_an_identifier_are_numbered(spark, keep):
    rows = [(None, f"text {k % 37}", "en") for k in range(300)] + [(5, None, None), (5, "", None), (5, "b", "fr"), (6, "c", None), (-7, "d", "de")] + [(9, f"{'same beginning ' * 20}{k}", "x") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    found = common.keyed(df, *keep).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((common.NULL_ID if i is None else i, t or "") for i, t, _ in rows)
    by_id: dict = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append((r["dup"], r["text"]))
    for own in by_id.values():
        own.sort()
        assert [d for d, _ in own] == list(range(len(own)))
        assert [t for _, t in own] == sorted(t for _, t in own)


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())
    Context.master = "local[2]"
    assert common.shared_dir(Session()).startswith("file://") and common.shared_dir(Session()) == common.shared_dir(Session())


def test_paths_as_arrow_names_them(tmp_path):
    assert common.arrow_uri("s3a://bucket/a/b") == common.arrow_uri("s3n://bucket/a/b") == "s3://bucket/a/b"
    assert common.arrow_uri("dbfs:/a/b") == "file:///dbfs/a/b"
    assert common.arrow_uri("hdfs://host:9000/a") == "hdfs://host:9000/a"
    assert common.arrow_uri("file:/a/b") == common.arrow_uri("file:///a/b") == "file:///a/b"
    for path in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        system, inner = common.file_system(path)
        assert system.get_file_info(inner).is_file is False and inner == str(tmp_path)


def test_scratch_made_inside_goes(spark):
    with common.passing(spark) as kept:
        gone = common.materialize(spark.range(3), "gone")
        stays = common.materialize(spark.range(4), "stays")
        kept.append(stays.scratch_path)
    assert stays.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone.scratch_path)
    common.discard(spark, stays.scratch_path)


@pytest.mark.parametrize("hub", [2, 1000])
def test_components(spark, monkeypatch, hub):
    """Stars, chains, loops and repeated edges, with and without hubs, against union and find."""
    import random

    from tessella.llm import components

    monkeypatch.setattr(components, "HUB", hub)
    rng = random.Random(hub)
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 140)] + [(200 + k * 7 % 13, 200 + k * 5 % 13) for k in range(30)] + [(k, 900 - k) for k in range(300, 330)]
    edges += [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(25)] + [(5, 5), (140, 59)] + [(0, 7)] * 3
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
