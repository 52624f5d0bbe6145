from __future__ import annotations

from pathlib import Path

import pytest

from tessella.operators import context, elementwise
from tessella.sources import profiles

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_subpackage():
    for path in (ROOT / "tessella").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tessella.llm" not in path.read_text(), path


def test_settings_hold_inside_only(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with context.settings(spark, spark__sql__shuffle__partitions=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_callsites_are_stable(spark):
    with context.callsite(spark, "a", 1) as one, context.callsite(spark, "a", 2) as other:
        assert spark.sparkContext.getLocalProperty("spark.job.description") == other != one
    with context.callsite(spark, "a", 1) as again:
        assert again == one


def test_provider_route_equals_the_plain_one(spark):
    from pyspark.sql import functions as F

    rows = spark.range(256).select(F.col("id").cast("int").alias("px"))
    both = elementwise.threshold_batches(rows, "px", "a").withColumn("b", elementwise.threshold(F.col("px")))
    assert both.where("a != b").count() == 0


def test_models_and_artifacts_come_back(spark, tmp_path):
    models = {("x", "y"): {"beta": [1.0, 2.0], "variance": 0.5, "n": 3.0}}
    profiles.save_models(spark, models, f"file://{tmp_path}/m")
    assert profiles.load_models(spark, f"file://{tmp_path}/m") == models
    profiles.save_artifact(spark, [1.0], [2.0], [0.0, 1.0], f"file://{tmp_path}/a")
    assert profiles.load_artifact(spark, f"file://{tmp_path}/a") == ([1.0], [2.0], [0.0, 1.0])
    with pytest.raises(ValueError, match="sizes"):
        profiles.save_artifact(spark, [1.0], [], [0.0], f"file://{tmp_path}/b")
