"""Language identification with interpolated Kneser-Ney character models.

Texts become symbols: each letter or mark in lower case is a symbol of its own,
whatever its script, and a run of anything else is one boundary.  Each language
has a model of order ``ORDER``; its n-grams and contexts lie in arrays sorted by
64-bit hash, with discounted probabilities and interpolation weights beside
them, looked up by binary search.  Below the unigrams all symbols of all sampled
languages are equally likely, and one more that stands for those never seen.
The language with the lowest cross-entropy per symbol wins.

The models are fitted on a bounded sample of labelled rows: of each language at
most ``SAMPLE_DOCS`` distinct texts, whole, those whose hash is least.  Tasks
count their n-grams and the driver gathers the distinct ones.  Every fifth
sampled text is kept out of the counts and calibrates two things.  A text is
rejected if its cross-entropy lies more than ``REJECT`` standard errors above
its language's mean, the error being made of a spread between documents and a
part that falls with length.  The score is the share of the best language in
``exp(-sharpness * cross-entropy)``, summed over languages; the sharpness is the
one at which the mean score of calibration texts equals the share of them that
are recognised.  Every whole text is predicted; one that is longer than
``PIECE`` bytes is read piece by piece, with the symbols before each piece as
its context.  Languages are labels: their number is taken to be small, and one
model of bounded size is kept for each.

Nulls, empties and ties: a text that is null or has no letter gets ``und``,
score 0 and is rejected; rows with null language or null identifier teach
nothing; equal cross-entropies go to the language that sorts first; with
nothing to learn from all texts get ``und``.  Languages, sources and
identifiers play no part in a prediction.  Other columns are never read.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import common, textkit

ORDER = 4
SAMPLE_DOCS = 400
REJECT = 8.0
PIECE = 1 << 20
#: Bytes of computed probabilities that a worker remembers.
MEMO_BYTES = 64 << 20
#: Beyond this code point there are no letters, only marks that join nothing.
LAST_POINT = 0x3FFFF
COUNTED = "lang string, " + ", ".join(f"c{k} int" for k in range(ORDER)) + ", n long"


@dataclass
class Table:
    """Values by sorted hash."""

    keys: np.ndarray
    values: np.ndarray

    def get(self, want: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(want), missing)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], missing)


def table(keys: np.ndarray, values: np.ndarray) -> Table:
    by = np.argsort(keys)
    return Table(keys[by], values[by].astype(np.float64))


def hashes(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the 0, 1, ... len(columns) symbols that end at each place; ``columns`` have the last symbol first."""
    out = [np.zeros(len(columns[0]), np.uint64)]
    for k, c in enumerate(columns):
        out.append(textkit.mix(out[-1] + (c.astype(np.uint64) + np.uint64(1)) * textkit.POW[k + 1]))
    return out


@dataclass
class KneserNey:
    symbols: int
    grams: list[Table] = field(default_factory=list)
    weights: list[Table] = field(default_factory=list)

    @staticmethod
    def fit(columns: list[np.ndarray], counts: np.ndarray, symbols: int) -> KneserNey:
        """From distinct runs of ORDER symbols, the last symbol first, and their counts."""
        model = KneserNey(symbols)
        runs, contexts = hashes(columns), hashes(columns[1:])
        for n in range(1, ORDER + 1):
            if n == ORDER:
                grams, context, times = runs[n], contexts[n - 1], counts
            else:  # in how many contexts one symbol longer the n-gram follows
                longer = np.unique(runs[n + 1], return_index=True)[1]
                grams, first, times = np.unique(runs[n][longer], return_index=True, return_counts=True)
                context = contexts[n - 1][longer][first]
            once, twice = int((times == 1).sum()), int((times == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            own, which = np.unique(context, return_inverse=True)
            total = np.bincount(which, times, len(own))
            model.grams.append(table(grams, np.maximum(times - discount, 0) / total[which]))
            model.weights.append(table(own, discount * np.bincount(which, minlength=len(own)) / total))
        return model

    def log_prob(self, columns: list[np.ndarray]) -> np.ndarray:
        runs, contexts = hashes(columns), hashes(columns[1:])
        p = np.full(len(columns[0]), 1.0 / self.symbols)
        for n in range(1, ORDER + 1):
            p = self.grams[n - 1].get(runs[n], 0.0) + self.weights[n - 1].get(contexts[n - 1], 1.0) * p
        return np.log(p)


@functools.cache
def point_tables() -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each code point, whether it is a letter): letters in lower case and marks are their own symbols, all else is 0."""
    symbol, letter = np.zeros(LAST_POINT + 1, np.uint32), np.zeros(LAST_POINT + 1, bool)
    for c in range(LAST_POINT):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            symbol[c], letter[c] = ord(chr(c).lower()[0]), True
        elif kind == "M":
            symbol[c] = c
    return symbol, letter


@dataclass
class Runs:
    """The symbols of a few rows: columns (last symbol first), bounds of the rows, whether each has a letter."""

    columns: list[np.ndarray]
    bounds: np.ndarray
    letters: np.ndarray


def decoded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, bounds of the rows in them)."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    if bounds[-1] != len(points):  # not UTF-8 somewhere: row by row
        rows = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(at[:-1], at[1:], strict=True)]
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    return np.minimum(points, LAST_POINT), bounds


def symbol_runs(data: np.ndarray, at: np.ndarray, before: list[int] | None = None) -> Runs:
    """Symbols of rows; ``before`` are the last symbols of the piece of the same row that comes before, newest first."""
    symbol, letter = point_tables()
    points, bounds = decoded(data, at)
    sym = symbol[points]
    has = np.concatenate([[0], np.cumsum(letter[points])])
    letters = has[bounds[1:]] > has[bounds[:-1]]
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[first] = sym[first] != 0  # a text begins at a boundary anyway
    if before and before[0] and len(keep):
        keep[0] = True
    bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
    sym = sym[keep]
    columns = [sym]
    for k in range(1, ORDER):
        past = np.zeros(len(sym), np.uint32)
        past[k:] = sym[: max(0, len(sym) - k)]
        for j in range(k):  # the j-th symbol of a row has j before it
            own = bounds[:-1] + j
            past[own[own < bounds[1:]]] = 0
        if before:
            for j in range(min(k, len(sym))):
                past[j] = before[k - j - 1]
        columns.append(past)
    return Runs(columns, bounds, letters)


def pieces(column: pa.Array) -> Iterator[tuple[int, Runs]]:
    """(first row, symbols) of rows of ``PIECE`` bytes together; a longer row comes in several pieces."""
    data, at = textkit.buffers(column)
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1)
        if at[end] - at[row] <= 2 * PIECE:
            yield row, symbol_runs(data[at[row] : at[end]], at[row : end + 1] - at[row])
        else:
            before = [0] * ORDER
            s = int(at[row])
            while s < at[end]:
                e = min(s + PIECE, int(at[end]))
                while e < at[end] and data[e] & 0xC0 == 0x80:
                    e += 1
                found = symbol_runs(data[s:e], np.array([0, e - s]), before)
                yield row, found
                tail = found.columns[0][::-1][:ORDER].tolist()
                before = (tail + before)[:ORDER]
                s = e
        row = end


@dataclass
class Identifier:
    """Models of all languages; what it has computed for an n-gram it remembers, up to ``MEMO_BYTES``."""

    langs: list[str]
    models: list[KneserNey]
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    sharpness: float = 1.0
    memo: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def log_probs(self, columns: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Log-probabilities of all places, by language."""
        if self.memo is None:
            bits = max(4, int(math.log2(MEMO_BYTES / 8 / (len(self.langs) + 1))))
            self.memo = (np.zeros(1 << bits, np.uint64), np.zeros((len(self.langs), 1 << bits)), np.uint64(64 - bits))
        keys, values, shift = self.memo
        want = hashes(columns)[ORDER]
        slot = (want >> shift).astype(np.int64)
        miss = np.flatnonzero(keys[slot] != want)
        new, first, which = np.unique(want[miss], return_index=True, return_inverse=True)
        own = [c[miss[first]] for c in columns]
        place = slot[miss[first]]
        free = keys[place] == 0
        keys[place[free]] = new[free]
        free &= keys[place] == new  # of two that share a place one is remembered
        for k, model in enumerate(self.models):
            fresh = model.log_prob(own)
            out = values[k][slot]
            out[miss] = fresh[which]
            values[k][place[free]] = fresh[free]
            yield out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy by row and language, symbols, has a letter)."""
        out = np.zeros((len(column), len(self.langs)))
        size, letters = np.zeros(len(column), np.int64), np.zeros(len(column), bool)
        for row, runs in pieces(column):
            rows = slice(row, row + len(runs.bounds) - 1)
            count = np.diff(runs.bounds)
            some = count > 0
            size[rows] += count
            letters[rows] |= runs.letters
            if some.any():
                for k, values in enumerate(self.log_probs(runs.columns)):
                    out[rows, k][some] -= np.add.reduceat(values, runs.bounds[:-1][some])
        return out / np.maximum(size, 1)[:, None], size, letters

    def scores(self, entropy: np.ndarray) -> np.ndarray:
        """The best language's share."""
        return 1.0 / np.exp(np.maximum((entropy.min(axis=1)[:, None] - entropy) * self.sharpness, -700.0)).sum(axis=1)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        entropy, size, letters = self.entropies(column)
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        limit = self.mean[best] + REJECT * np.sqrt(self.spread[best] ** 2 + self.noise[best] ** 2 / np.maximum(size, 1))
        langs = [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return langs, np.where(letters, self.scores(entropy), 0.0), np.where(letters, least, np.nan), ~letters | (least > limit)

    def calibrate(self, langs: np.ndarray, entropy: np.ndarray, size: np.ndarray) -> None:
        """From texts that the models have not counted: their languages' numbers, entropies and sizes."""
        for j in range(len(self.langs)):
            own, n = entropy[langs == j, j], size[langs == j]
            if not len(own):
                own, n = np.array([math.log(self.models[j].symbols)]), np.array([1])
            self.mean[j] = np.average(own, weights=n)
            away = own - self.mean[j]
            long = n >= np.median(n)
            self.spread[j] = max(0.02, 1.4826 * float(np.median(np.abs(away[long]))))
            self.noise[j] = max(1.0, float(np.sqrt(np.mean(away**2 * n))))
        if not len(langs) or len(self.langs) == 1:
            return
        # a share of right answers that is never 0 or 1
        right = (int((entropy.argmin(axis=1) == langs).sum()) + 1) / (len(langs) + 2)
        low, high = 0.0, 1e6
        for _ in range(100):  # the mean score grows with the sharpness
            self.sharpness = (low + high) / 2
            low, high = (self.sharpness, high) if self.scores(entropy).mean() < right else (low, self.sharpness)


def learnable() -> Column:
    """Rows that may teach: crc32 of the identifier as text, modulo 3, is not 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def draw(docs: DataFrame, docs_each: int) -> DataFrame | None:
    """The sample (lang, text, learns, checks): per language the ``docs_each`` distinct texts of least hash."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    name = F.shiftrightunsigned(F.xxhash64("text"), 1)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct(name)).collect()}  # one row a language
    if not counts:
        return None
    share = F.lit(None).cast("double")
    for lang, n in counts.items():
        # room enough that fewer than asked for hardly ever come through
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * docs_each / max(n, 1)))).otherwise(share)
    some = rows.withColumn("name", name).where(F.col("name") <= share * float(2**63)).groupBy("lang", "name").agg(F.first("text").alias("text"))
    own = Window.partitionBy("lang")
    least = some.withColumn("place", F.row_number().over(own.orderBy("name"))).where(F.col("place") <= docs_each)
    few = F.count("*").over(own) < 5
    fifth = F.col("place") % 5 == 1
    return common.materialize(least.select("lang", "text", (few | ~fifth).alias("learns"), (few | fifth).alias("checks")).repartition(min(16, common.shuffle_partitions(docs.sparkSession))), "sample")


def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The distinct runs of ORDER symbols of a batch of (lang, text), by language, and their counts."""
    code = batch.column("lang").dictionary_encode()
    number = code.indices.to_numpy(zero_copy_only=False)
    found: list[tuple] = []
    for row, runs in pieces(batch.column("text")):
        lang = np.repeat(number[row : row + len(runs.bounds) - 1], np.diff(runs.bounds))
        key = textkit.mix(hashes(runs.columns)[ORDER] + lang.astype(np.uint64))
        first, times = np.unique(key, return_index=True, return_counts=True)[1:]
        found.append((lang[first], *(c[first] for c in runs.columns), times))
    lang, *columns, times = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64) for _ in range(ORDER + 2))
    names = ["lang", *(f"c{k}" for k in range(ORDER)), "n"]
    return pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(lang)), *(pa.array(c.astype(np.int32)) for c in columns), pa.array(times.astype(np.int64))], names)


def models(table_: pa.Table) -> Identifier | None:
    """Models of the languages of (lang, c0, c1, ..., n), not calibrated yet."""
    langs = sorted(set(table_.column("lang").to_pylist()))
    if not langs:
        return None
    lang = np.searchsorted(np.array(langs, object), table_.column("lang").to_numpy(zero_copy_only=False))
    columns = [table_.column(f"c{k}").to_numpy().astype(np.uint32) for k in range(ORDER)]
    times = table_.column("n").to_numpy().astype(np.float64)
    symbols = len(np.unique(columns[0])) + 1
    made = [KneserNey.fit([c[lang == j] for c in columns], times[lang == j], symbols) for j in range(len(langs))]
    return Identifier(langs, made, *(np.zeros(len(langs)) for _ in range(3)))


def learn(teachers: DataFrame, docs_each: int = SAMPLE_DOCS) -> Identifier | None:
    """Fitted and calibrated on the sample; tasks read the texts, the driver gets n-grams with counts, and entropies."""
    spark = teachers.sparkSession
    sample = draw(teachers, docs_each)
    if sample is None:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.regrouped(batches, "text", 4 << 20, 4 << 20):
            yield counted(part)

    grams = [f"c{k}" for k in range(ORDER)]
    counts = sample.where("learns").select("lang", "text").mapInArrow(count, COUNTED).groupBy("lang", *grams).agg(F.sum("n").alias("n"))
    found = models(counts.toArrow())
    if found is None:
        return None
    shared = spark.sparkContext.broadcast(found)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.regrouped(batches, "text", 2 << 20, 2 << 20):
            entropy, size, letters = shared.value.entropies(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(size), pa.array(letters)], ["lang", "entropy", "size", "letters"])

    rows = sample.where("checks").select("lang", "text").mapInArrow(check, "lang string, entropy array<double>, size long, letters boolean").where("letters").orderBy("lang", "size", "entropy").collect()
    rows = [r for r in rows if r["lang"] in found.langs]
    found.calibrate(np.array([found.langs.index(r["lang"]) for r in rows], np.int64), np.array([r["entropy"] for r in rows]).reshape(len(rows), len(found.langs)), np.array([r["size"] for r in rows]))
    common.discard(spark, sample.scratch_path)
    return found


def identify(docs: DataFrame, teachers: DataFrame, docs_each: int = SAMPLE_DOCS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score, cross_entropy and rejected; learns from ``teachers(lang, text)``."""
    common.small_batches(docs.sparkSession)
    model = learn(teachers, docs_each)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by that of the sample
    names = ["lang_pred", "score", "cross_entropy", "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in textkit.regrouped(batches, source, 2 << 20, 2 << 20):
            if own is None:
                n = part.num_rows
                found = (["und"] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool))
            else:
                found = own.predict(part.column(source))
            arrays = [pa.array(found[0], pa.string()), pa.array(found[1]), pa.array(found[2], from_pandas=True), pa.array(found[3])]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *arrays], [*keep, *names])

    source = "text" if "text" in keep else "text_"
    rows = docs.select(*keep, *([] if "text" in keep else [F.col("text").cast("string").alias("text_")]))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, cross_entropy double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), docs.where(learnable()))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
