"""Session helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Takes the place of a null identifier inside joins and orderings; it sorts first.
NULL_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The folder of a local session that names none.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session may leave it unset and gets a temporary folder; on a
    cluster every machine would have another one, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="tessella-"))
        found = _LOCAL[0]
    return found.rstrip("/")


#: Hadoop's names of file systems, by the names that Arrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "hdfs"}


def arrow_uri(path: str) -> str:
    """A Hadoop path as Arrow names it: S3 without the client's letter, DBFS by its mount, a bare path as it is."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme == "dbfs":
        return "file:///dbfs/" + rest.lstrip("/")
    if scheme == "file":
        return "file:///" + rest.lstrip("/")
    return f"{SCHEMES.get(scheme, scheme)}:{rest}"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """(file system, path inside it) for files that tasks write and read themselves."""
    return pyarrow.fs.FileSystem.from_uri(arrow_uri(path))


#: Paths that this session has made in the shared folder.
_SCRATCH: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch paths that nothing will read again."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _SCRATCH.discard(path)


def clean(spark: SparkSession) -> None:
    """Delete all of this session's scratch; call it when the results that come from it are written."""
    discard(spark, *list(_SCRATCH))


@contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch made inside is deleted at the end, but for the paths that the caller puts into the list."""
    before, kept = set(_SCRATCH), []
    yield kept
    discard(spark, *(_SCRATCH - before - set(kept)))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there and no executor holds the only copy."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    return found


def small_batches(spark: SparkSession) -> None:
    """Batches of at most 2,000 rows to and from Python, unless the session asks for others: whole texts can be long.

    Spark reads this setting when a plan runs, so it stays set in the session.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, "2000")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, dup, text, keep...): a key that is unique without null.

    A null identifier becomes ``NULL_ID`` and sorts first; a null text is empty.
    Rows that share an identifier are told apart by ``dup``, their number in the
    order of their texts; only where there are such rows is the table sorted.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _numbered(rows, *keep)
    return rows.select("doc_id", F.lit(0).alias("dup"), "text", *keep)


#: Characters of a text that deal rows of one identifier to tasks; whole texts order them inside.
DEALT_BY = 200


def _numbered(rows: DataFrame, *keep: str) -> DataFrame:
    """``rows`` with ``dup``, each row's number among those of its identifier in the order of their texts.

    The rows are range-partitioned by identifier and beginning of the text, so
    that very many rows of one identifier, all null ones for instance, lie in
    many tasks.  A task numbers its rows as they stand sorted; a table of one
    row a task tells how many rows of its first identifier lie in tasks before.
    """
    order = ["doc_id", "text", *keep]
    n = shuffle_partitions(rows.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    small_batches(rows.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            local = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
            if last is not None and ids[0] == last:
                local[: first[1] if len(first) > 1 else len(ids)] += count
            last, count = ids[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), task, np.int32)), pa.array(local)], [*batch.schema.names, "_task", "_local"])

    ranged = rows.repartitionByRange(n, "doc_id", F.substring("text", 1, DEALT_BY)).sortWithinPartitions(*order)
    placed = materialize(ranged.mapInArrow(number, kinds + ", _task int, _local long"), "numbered")
    ends = placed.groupBy("_task").agg(F.max(F.struct("doc_id", "_local")).alias("end")).select("_task", "end.doc_id", (F.col("end._local") + 1).alias("_n"))
    after = F.lead("_task").over(Window.orderBy("_task"))  # one row a task
    ahead = ends.withColumn("_next", after).withColumn("_ahead", F.sum("_n").over(Window.partitionBy("doc_id").orderBy("_task")))
    ahead = ahead.where("_next is not null").select(F.col("_next").alias("_task"), "doc_id", "_ahead")
    found = placed.join(F.broadcast(ahead), ["_task", "doc_id"], "left")  # as many rows as tasks
    return found.select("doc_id", (F.col("_local") + F.coalesce("_ahead", F.lit(0))).cast("int").alias("dup"), "text", *keep)


def original_id(column: str = "doc_id"):
    return F.when(F.col(column) != NULL_ID, F.col(column))
