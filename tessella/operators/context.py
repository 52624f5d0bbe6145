"""Scopes of execution: settings for one piece of work, and a name that stays the same between runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def settings(spark: SparkSession, **values: object) -> Iterator[SparkSession]:
    """Session settings that hold inside the block; double underscores stand for dots."""
    named = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def callsite(spark: SparkSession, *key: object) -> Iterator[str]:
    """Jobs inside the block carry a description made of the key, the same in every run."""
    name = hashlib.sha256("\u001f".join(map(str, key)).encode()).hexdigest()[:16]
    context = spark.sparkContext
    before = context.getLocalProperty("spark.job.description")
    context.setLocalProperty("spark.job.description", name)
    try:
        yield name
    finally:
        context.setLocalProperty("spark.job.description", before)
