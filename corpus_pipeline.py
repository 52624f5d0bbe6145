"""A corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, mixing, packing.

Each stage takes and returns the columns of ``documents``; the last returns the
pieces of the packed sequences with their token ids.  Stages are written as
Parquet to the shared folder and read again; a stage's input and what else it
wrote there are deleted when its output is written.

Nulls, empties and ties: null and empty texts and texts without a letter go in
the first stage, which can tell no language of them; null identifiers, languages
and sources are kept as they are by all stages but the mixing, whose output has
the languages and sources of its input; rows that repeat an identifier are
documents of their own; of equal texts the join keeps the one with the least
identifier, null before all; empty tables pass through all stages.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, language_id, mixing, packing, signature_trees, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORDS, THRESHOLD = 5, Fraction(4, 5)
SHARE, EPOCHS = (19, 20), 1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that every language's model rejects."""
    found = language_id.identify(docs, docs.where(language_id.learnable()), keep=COLUMNS)
    return found.where("not rejected").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    first = signature_trees.similarity_classes(docs, WORDS, THRESHOLD).where("first").select("doc_id", "dup")
    rows = common.keyed(docs.withColumn("text_", F.col("text")), "text_", "lang", "source", "n_chars")
    kept = rows.join(first, ["doc_id", "dup"], "left_semi")
    return kept.select(common.original_id().alias("doc_id"), F.col("text_").alias("text"), "lang", "source", "n_chars")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that 100-byte strings from earlier places cover."""
    cut = suffix_dedup.remove_repeats(docs, keep=("lang", "source"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents, the last one of a leaf cut behind the last token that it may give."""
    taken = mixing.mix(docs, share=SHARE, max_epochs=EPOCHS, keep=("lang", "source", "n_chars"))
    cut = mixing.first_tokens(F.col("text_"), F.col("cut_tokens"))
    whole = (F.col("copies") > 0) | (F.col("cut_tokens") == F.col("tokens"))
    text = F.when(whole, F.col("text_")).otherwise(cut)
    return taken.select("doc_id", text.alias("text"), F.col("keep_lang").alias("lang"), F.col("keep_source").alias("source"), F.when(whole, F.col("keep_n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of several context sizes, with their token ids."""
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = common.documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        with common.passing(spark) as kept:
            docs = common.materialize(stage(spark, docs, sf_dir), name)
            kept.append(docs.scratch_path)
        common.discard(spark, *read)
        read = [docs.scratch_path]
    return STAGES[-1][1](spark, docs, sf_dir)
