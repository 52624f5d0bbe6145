"""Quality rules with a hashed n-gram likelihood ratio, in DataFrame functions alone.

Words and pairs of words fall into ``BUCKETS`` hash buckets.  Two smoothed
multinomials over the buckets are counted, one over the trusted target
documents and one over the whole raw corpus.  A document's score is the mean
over its n-grams of ``ln(target / raw)``; it is kept if no base rule fails it
and the score reaches the threshold.  The threshold is a function of all
trusted documents that pass the base rules: ``SPREADS`` standard deviations
below their mean score, so equal inputs give equal verdicts.

Base rules: fewer than 50 words fail, and texts where more than half of the
words stand in three-word windows that occur twice or more.  Such windows are
told apart by 64-bit hash.

Nulls, empties and ties: a null or empty text has no words and fails; a null
identifier is never trusted; with no trusted document every score is 0 and the
threshold lets all pass; repeated rows are judged like any other; an empty
table gives no rows; columns other than the identifier and the text are never
read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common

BUCKETS = 1 << 14
SPREADS = 4.0
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def word_list(text: Column) -> Column:
    """Runs without space, tab, LF, VT, FF or CR."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def word_hashes(text: Column) -> Column:
    return F.transform(word_list(text), lambda w: F.xxhash64(w))


def windows(hashes: Column) -> Column:
    """The hash of each run of three words."""
    return F.when(F.size(hashes) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(hashes, 3, F.greatest(F.lit(0), F.size(hashes) - 2)), lambda h, i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), h))
    )


def repeated_starts(own: Column, placed: Column) -> Column:
    """Ascending places of the windows found twice or more.

    ``placed`` is ``own`` as (hash, place), sorted: there a repeated window has a neighbour with its hash.
    """

    def again(w: Column, k: Column) -> Column:
        return (F.get(placed, k - 1)["h"].eqNullSafe(w["h"])) | (F.get(placed, k + 1)["h"].eqNullSafe(w["h"]))

    return F.sort_array(F.transform(F.filter(placed, again), lambda w: w["i"]))


def covered(starts: Column) -> Column:
    """Places in the union of [s, s + 2] for ascending starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def lines_again(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    return F.size(lines) - F.size(F.array_distinct(lines))


def gram_buckets(hashes: Column, count: int) -> Column:
    """Buckets of the words and of the pairs of neighbouring words."""
    single = F.transform(hashes, lambda h: F.pmod(h, F.lit(count)).cast("int"))
    pair = F.transform(F.slice(hashes, 2, F.greatest(F.lit(0), F.size(hashes) - 1)), lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(count)).cast("int"))
    return F.concat(single, F.when(F.size(hashes) < 2, F.array().cast("array<int>")).otherwise(pair))


def ratio_weights(counted: DataFrame, count: int) -> DataFrame:
    """One row: ``count`` log ratios of the smoothed multinomials in (b, target, raw); the table has ``count`` rows at most."""
    every = counted.sparkSession.range(count).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("target"), F.lit(0).cast("long").alias("raw"))
    filled = every.union(counted.select("b", "target", "raw")).groupBy("b").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    listed = filled.agg(F.sort_array(F.collect_list(F.struct("b", "target", "raw"))).alias("all"), F.sum("target").alias("t"), F.sum("raw").alias("r"))
    target, raw = (lambda x: F.log((x["target"] + 1.0) / (F.col("t") + float(count)))), (lambda x: F.log((x["raw"] + 1.0) / (F.col("r") + float(count))))
    return listed.select(F.transform("all", lambda x: F.when(F.col("t") == 0, F.lit(0.0)).otherwise(target(x) - raw(x))).alias("weights"))


def judge(docs: DataFrame, trusted: DataFrame, count: int = BUCKETS, spreads: float = SPREADS) -> DataFrame:
    """Base counts, score, threshold and verdict for each of ``docs(doc_id, text)``; ``trusted(doc_id)`` names the target documents.

    Two passes over the texts: one counts buckets, one scores.  Only the first
    shuffles texts, to mark the trusted ones; the counts (``count`` rows) and
    one row of sums are all that tasks share.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    # one join of whole texts, always by shuffle: the marks grow with the corpus
    marked = rows.join(marks.hint("shuffle_hash"), "doc_id", "left").select(F.coalesce("trusted", F.lit(False)).alias("trusted"), word_hashes(F.col("text")).alias("hashes"))
    grams = marked.select("trusted", F.explode(gram_buckets(F.col("hashes"), count)).alias("b"))
    counted = grams.groupBy("b").agg(F.count_if("trusted").alias("target"), F.count("*").alias("raw"))
    # ``count`` numbers, whatever the corpus: they become a constant of the second pass
    weights = ratio_weights(common.materialize(counted, "buckets"), count).first()["weights"]
    weight = F.from_json(F.lit(json.dumps(weights)), "array<double>")

    hashes, own, placed = F.col("hashes"), F.col("own"), F.col("placed")
    with_windows = rows.withColumn("hashes", word_hashes(F.col("text"))).withColumn("own", windows(hashes))
    # most texts repeat no window: nothing is sorted for them
    sorted_windows = F.when(F.size(F.array_distinct(own)) == F.size(own), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    total = F.aggregate(gram_buckets(hashes, count), F.lit(0.0), lambda acc, b: acc + F.get(weight, b))
    text = F.col("text")
    scored = with_windows.withColumn("placed", sorted_windows).select(
        "doc_id",
        F.size(hashes).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines_again(text).cast("long").alias("n_dup_lines"),
        covered(repeated_starts(own, placed)).cast("long").alias("n_repeat_words"),
        (total / F.greatest(F.lit(1), 2 * F.size(hashes) - 1)).alias("score"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = common.materialize(scored.withColumn("base_failed", failed), "scores")
    # scores without texts meet the marks again
    good = scored.where("not base_failed").join(marks.hint("shuffle_hash"), "doc_id", "left_semi")
    limit = common.materialize(good.agg((F.avg("score") - spreads * F.coalesce(F.stddev_pop("score"), F.lit(0.0))).alias("limit")), "limit").scalar()
    threshold = F.round(F.coalesce(limit, F.lit(float("-inf"))), 9)
    return scored.withColumn("threshold", threshold).withColumn("kept", ~F.col("base_failed") & (F.round("score", 9) >= F.col("threshold")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    return judge(common.documents(spark, sf_dir), trusted)
