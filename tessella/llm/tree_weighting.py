"""Language-model scoring with context-tree weighting, and a unigram base score.

The model predicts each byte of the text (A-Z folded, a zero byte at the end)
from up to ``DEPTH`` bytes before it, in eight binary decisions.  Every context
of every length keeps, for each node of that binary decomposition, how many
zeros and ones the training texts had there.  A node's Krichevsky-Trofimov
estimate is mixed with the product of its longer contexts' weighted
probabilities, half and half, down from the deepest; the predictive probability
follows the same weights.  The sum of the logarithms is the text's code length.

How it is laid out:

1. Documents are read once, in blocks of about 4 MB (more where there are very
   many shards, so that rows stay worth their overhead), written as block files
   to the shared folder.  For each block its distinct words and distinct grams
   of ``DEPTH + 1`` bytes go out with their training counts, sorted, in one row
   for each shard that has any; what is asked for grows with the corpus, never
   with the frequency of a word or gram.
2. A shard merges its rows as a stream into one table of distinct keys and
   counts; it holds that table and one row at a time, never all blocks' keys.
   Words are sharded by hash, grams by the last two context bytes, so a shard
   holds whole context subtrees from depth 2 on.  A shard with many times the
   mean number of bytes is merged in several tasks first and answered in
   several tasks, each with the table.  Depths 0 and 1 are 65,536 nodes at
   most, summed over the shards exactly; they are the only thing that the
   driver gathers and ships, and their number is fixed.
3. Shards answer each block in the order of its keys, and a task with a block's
   answers reads the block file and sums up by document.  A long text is read
   in ranges of ``RANGE`` bytes, each with the bytes before it as context.

Nulls, empties and ties: a null or empty text has one token, the end; a null
identifier stays null, and such rows are not learned from; repeated rows are
counted and scored like any others; an empty table gives no rows; columns other
than the identifier and the text are never read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, textkit
from tessella.llm.blobs import ascending, ascending_back, counts_back, counts_out, packed, unpacked

DEPTH = 5
BLOCK_BYTES, MOST_BLOCK_BYTES, ROW_BYTES = 4 << 20, 64 << 20, 8 << 10
RANGE = 4 << 20
#: A shard with more bytes than this and twice the mean is dealt to several tasks.
SPLIT_BYTES = 32 << 20
ASKED = "shard int, block string, keys binary, counts binary, documents long"
TABLES = "shard int, keys binary, counts binary, kept long, trained long"
ANSWERS = "block string, shard int, answer binary"
STATE = "node int, inner double, zeros long, ones long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def held_out() -> Column:
    """crc32 of the identifier as text, modulo 7, is 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


def ended(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded bytes with a zero byte after each row, the rows' bounds)."""
    rows = len(at) - 1
    full = np.zeros(len(data) + rows, np.uint8)
    bounds = at + np.arange(rows + 1)
    place = np.ones(len(full), bool)
    place[bounds[1:] - 1] = False
    full[place] = textkit.LOWER[data]
    return full, bounds


def byte_grams(full: np.ndarray, bounds: np.ndarray, s: int, e: int) -> np.ndarray:
    """Context and next byte at each place from s to e of ``ended`` rows."""
    begin = max(0, s - DEPTH)
    wide = full[begin:e].astype(np.uint64)
    grams = wide.copy()
    for k in range(1, DEPTH + 1):
        grams[k:] |= wide[:-k] << np.uint64(8 * k)
    rows = slice(int(np.searchsorted(bounds[:-1], begin)), int(np.searchsorted(bounds[:-1], e)))
    first, stop = bounds[:-1][rows], np.minimum(bounds[1:][rows], e)
    for k in range(DEPTH):  # the k-th byte of a row has k before it
        own = first + k
        grams[own[own < stop] - begin] &= np.uint64((1 << (8 * (k + 1))) - 1)
    return grams[s - begin :]


def ranges(total: int) -> Iterator[tuple[int, int]]:
    for s in range(0, total, RANGE):
        yield s, min(s + RANGE, total)


def distinct(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of 63 bits, and how often each is learned from."""
    marked = (keys << np.uint64(1)) | learn.astype(np.uint64)
    marked.sort()
    new = np.flatnonzero(np.concatenate([[True], marked[1:] != marked[:-1]])) if len(marked) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(marked)))
    marked = marked[new]
    times = np.where((marked & np.uint64(1)) == 1, times, 0)
    keys = marked >> np.uint64(1)
    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[lead], np.add.reduceat(times, lead) if len(lead) else times


class Counted:
    """Distinct keys and their counts, merged from sorted rows as they come; memory follows the distinct keys."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pending.append((keys, counts))
        self.waiting += len(keys)
        if self.waiting > max(1 << 19, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pending) == 1 and not len(self.keys):
            self.keys, self.counts = self.pending[0]
        elif self.pending:
            keys = np.concatenate([self.keys, *(k for k, _ in self.pending)])
            counts = np.concatenate([self.counts, *(c for _, c in self.pending)])
            by = np.argsort(keys, kind="stable")
            keys = keys[by]
            lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.counts = keys[lead], np.add.reduceat(counts[by], lead) if len(lead) else counts
        self.pending, self.waiting = [], 0
        return self.keys, self.counts


def word_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def gram_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the predicted one."""
    near = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return (textkit.mix(near + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """ln Gamma(n + 1/2) for whole numbers n."""
    return _stirling(n.astype(np.float64) + 0.5)


def _stirling(x: np.ndarray) -> np.ndarray:
    # shifted by eight, where the series is exact to the last digits
    shift = np.zeros_like(x)
    low = x < 8
    y = np.where(low, x + 8, x)
    for k in range(8):
        shift += np.where(low, np.log(np.where(low, x + k, 1.0)), 0.0)
    z = 1.0 / (y * y)
    series = (1.0 / 12 - z * (1.0 / 360 - z * (1.0 / 1260 - z * (1.0 / 1680)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return log_gamma_half(zeros) + log_gamma_half(ones) - _stirling(zeros + ones + 1.0) - math.log(math.pi)


def weighted(kt: np.ndarray, inner: np.ndarray) -> np.ndarray:
    return np.logaddexp(kt, inner) - math.log(2)


def share(log_ratio: np.ndarray) -> np.ndarray:
    """beta / (beta + 1)."""
    return 0.5 * (1 + np.tanh(0.5 * log_ratio))


def node_keys(grams: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context of ``depth`` bytes and binary node, bit taken there), [gram, decision]."""
    byte = (grams & np.uint64(0xFF))[:, None]
    context = ((grams >> np.uint64(8)) & np.uint64((1 << (8 * depth)) - 1))[:, None]
    j = np.arange(8, dtype=np.uint64)
    node = (np.uint64(1) << j) | (byte >> (np.uint64(8) - j))
    return (context << np.uint64(8)) | node, ((byte >> (np.uint64(7) - j)) & np.uint64(1)).astype(np.int64)


class Subtrees:
    """Contexts of two bytes and more under one shard's grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams = grams
        self.predict = np.zeros((len(grams), 8))
        times = np.repeat(counts, 8)
        longer = None
        for depth in range(DEPTH, 1, -1):
            keys, bit = node_keys(grams, depth)
            nodes, which = np.unique(keys.reshape(-1), return_inverse=True)
            taken = bit.reshape(-1)
            ones = np.bincount(which, times * taken, len(nodes))
            zeros = np.bincount(which, times * (1 - taken), len(nodes))
            kt = log_kt(zeros, ones)
            if longer is None:
                own = kt
                self.predict = self._estimate(zeros, ones, which, taken)
            else:
                # nodes of longer contexts meet in the node without their oldest byte
                parents = np.searchsorted(nodes, longer[0] & np.uint64((1 << (8 * depth + 8)) - 1))
                below = np.bincount(parents, longer[1], len(nodes))
                own = weighted(kt, below)
                part = share(kt - below)[which].reshape(-1, 8)
                self.predict = part * self._estimate(zeros, ones, which, taken) + (1 - part) * self.predict
            longer = (nodes, own, zeros, ones)
        self.top = longer

    @staticmethod
    def _estimate(zeros, ones, which, taken) -> np.ndarray:
        had = np.where(taken == 1, ones[which], zeros[which])
        return ((had + 0.5) / (zeros[which] + ones[which] + 1.0)).reshape(-1, 8)

    def state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What depth 1 needs: (its nodes, sums of the weighted probabilities of their longer contexts, zeros, ones)."""
        nodes, own, zeros, ones = self.top
        up, which = np.unique(nodes & np.uint64(0xFFFF), return_inverse=True)
        return up, np.bincount(which, own, len(up)), np.bincount(which, zeros, len(up)), np.bincount(which, ones, len(up))


class Crown:
    """Depths 0 and 1, from the summed state of all shards."""

    def __init__(self, rows: list[tuple[int, float, int, int]]):
        self.part1, self.one1 = np.full(1 << 16, 0.5), np.full(1 << 16, 0.5)
        self.part0, self.one0 = np.full(256, 0.5), np.full(256, 0.5)
        if not rows:
            return
        node, inner, zeros, ones = (np.array(x) for x in zip(*sorted(rows), strict=True))
        kt = log_kt(zeros, ones)
        self.part1[node] = share(kt - inner)
        self.one1[node] = (ones + 0.5) / (zeros + ones + 1.0)
        low, which = np.unique(node & 0xFF, return_inverse=True)
        below, zeros, ones = (np.bincount(which, x, len(low)) for x in (weighted(kt, inner), zeros, ones))
        self.part0[low] = share(log_kt(zeros, ones) - below)
        self.one0[low] = (ones + 0.5) / (zeros + ones + 1.0)

    def log10(self, grams: np.ndarray, predict: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte, from the prediction of depth 2."""
        for depth, part, one in ((1, self.part1, self.one1), (0, self.part0, self.one0)):
            keys, bit = node_keys(grams, depth)
            at = keys.astype(np.int64)
            here = np.where(bit == 1, one[at], 1 - one[at])
            predict = part[at] * here + (1 - part[at]) * predict
        return np.log10(predict).sum(axis=1)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(name)[k].as_py() for name in batch.schema.names}


def tree_tables(asked: DataFrame, *dealt: str) -> DataFrame:
    """(shard, keys, counts, kept, trained): the rows of each group of ``dealt`` columns merged into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, Counted()

        def table() -> pa.RecordBatch:
            keys, counts = own.merge()
            return pa.RecordBatch.from_pydict({"shard": [held[0]], "keys": [ascending(keys)], "counts": [counts_out(counts, 8)], "kept": [int((counts > 0).sum())], "trained": [int(counts.sum())]}, schema=kinds)

        for row in rows_of(batches):
            if held is not None and tuple(row[c] for c in dealt) != held:
                yield table()
                own = Counted()
            held = tuple(row[c] for c in dealt)
            own.add(ascending_back(row["keys"]), counts_back(row["counts"], 8))
        if held is not None:
            yield table()
        textkit.release()

    kinds = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("kept", pa.int64()), ("trained", pa.int64())])
    n = common.shuffle_partitions(asked.sparkSession)
    return asked.select(*dealt, "keys", "counts").repartition(n, *dealt).sortWithinPartitions(*dealt).mapInArrow(run, TABLES)


def score_documents(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """Scores of ``docs(doc_id, text)``; ``held`` marks the rows that are not learned from (by default ``held_out()``)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    shards = common.shuffle_partitions(spark)
    folder = common.scratch(spark, "ctw")
    never = F.lit(True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held if held is not None else held_out(), never).alias("held"))
    block_bytes = min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, shards * ROW_BYTES))

    # word shards are 0, 1, ..., gram shards follow them
    def parted(words: np.ndarray, grams: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(shard, whether it has words, places of its keys) for each shard that a block has keys of."""
        for shift, shard, has_words in ((0, word_shard(words << np.uint64(1), shards), True), (shards, gram_shard(grams, shards), False)):
            by = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[by], np.arange(shards + 1))
            for s in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                yield shift + s, has_words, by[edge[s] : edge[s + 1]]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = common.file_system(folder)
        for part in textkit.regrouped(batches, "text", block_bytes, block_bytes):
            name = f"{uuid.uuid4().hex}.arrow"
            system.create_dir(inner, recursive=True)
            with system.open_output_stream(f"{inner}/{name}") as sink, pa.ipc.new_file(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            words, grams, learned = Counted(), Counted(), 0
            for own in textkit.slices(part, "text", RANGE):
                data, at = textkit.buffers(own.column("text"))
                learn = ~own.column("held").to_numpy(zero_copy_only=False)
                learned += int(learn.sum())
                hashes, _, _, bounds = textkit.word_hashes(data, at, lower=True)
                words.add(*distinct(hashes >> np.uint64(1), np.repeat(learn, np.diff(bounds))))
                del hashes
                full, bounds = ended(data, at)
                marks = np.repeat(learn, np.diff(bounds))
                for s, e in ranges(len(full)):
                    grams.add(*distinct(byte_grams(full, bounds, s, e), marks[s:e]))
            lists = words.merge(), grams.merge()
            out = {k: [] for k in asked_schema.names}
            for shard, has_words, own in parted(lists[0][0], lists[1][0]):
                keys, counts = lists[0 if has_words else 1]
                for column, value in zip(asked_schema.names, (shard, name, ascending(keys[own]), counts_out(counts[own], 8), 0), strict=True):
                    out[column].append(value)
            if not out["shard"]:  # never: each row has its end
                continue
            out["documents"][0] = learned
            yield pa.RecordBatch.from_pydict(out, schema=asked_schema)

    asked_schema = pa.schema([("shard", pa.int32()), ("block", pa.string()), ("keys", pa.binary()), ("counts", pa.binary()), ("documents", pa.int64())])
    asked = common.materialize(rows.mapInArrow(ask, ASKED), "ctw-asked")

    # shards that have far more than their share, and in how many tasks each is worked on: two rows a shuffle partition at most
    sizes = asked.groupBy("shard").agg(F.sum(F.octet_length("keys") + F.octet_length("counts")).alias("bytes"), F.sum("documents").alias("documents")).collect()
    most = max(SPLIT_BYTES, 2 * sum(r["bytes"] for r in sizes) // max(1, len(sizes)))
    ways = [(r["shard"], -(-r["bytes"] // most)) for r in sizes if r["bytes"] > most]
    ends = sum(r["documents"] for r in sizes)
    split = F.broadcast(spark.createDataFrame(ways, "shard int, ways int"))
    dealt = asked.join(split, "shard", "left").withColumn("ways", F.coalesce("ways", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("block"), F.col("ways")).cast("int"))
    tables = common.materialize(tree_tables(tree_tables(dealt, "shard", "salt") if ways else asked, "shard"), "ctw-tables")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            nodes, inner, zeros, ones = Subtrees(ascending_back(row["keys"]), counts_back(row["counts"], 8)).state()
            yield pa.RecordBatch.from_arrays([pa.array(nodes.astype(np.int32)), pa.array(inner), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64))], ["node", "inner", "zeros", "ones"])
        textkit.release()

    # decimals add up to the same sum in any order
    state = tables.where(F.col("shard") >= shards).select("keys", "counts").mapInArrow(summed, STATE).groupBy("node").agg(F.sum(F.col("inner").cast("decimal(38,9)")).cast("double").alias("inner"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    crown = Crown([tuple(r) for r in state.collect()])  # 65,536 rows at most
    shared = spark.sparkContext.broadcast(crown)
    sums = tables.where(F.col("shard") < shards).agg(F.sum("trained"), F.sum("kept")).first()
    total_tokens, vocabulary = int(sums[0] or 0) + ends, int(sums[1] or 0) + (ends > 0)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's table comes before the rows that ask it."""
        keys, values = np.zeros(0, np.uint64), np.zeros(0)
        for row in rows_of(batches):
            if row["block"] is None:
                keys, values = ascending_back(row["keys"]), counts_back(row["counts"], 8)
                if row["shard"] >= shards:
                    values = shared.value.log10(keys, Subtrees(keys, values).predict)
                textkit.release()
                continue
            own = values[np.searchsorted(keys, ascending_back(row["keys"]))]
            out = counts_out(own, 8) if row["shard"] < shards else packed(own.astype("<f8").view(np.uint8).reshape(-1, 8).T)
            yield pa.RecordBatch.from_pydict({"block": [row["block"]], "shard": [row["shard"]], "answer": [out]}, schema=answer_schema)
        textkit.release()

    answer_schema = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("answer", pa.binary())])
    every = F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))
    copies = tables.join(split, "shard", "left").select("shard", every.alias("salt"), F.lit(None).cast("string").alias("block"), "keys", "counts")
    asking = copies.unionByName(dealt.select("shard", "salt", "block", "keys", F.lit(None).cast("binary").alias("counts")))
    answers = asking.repartition(shards, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("block").asc_nulls_first()).mapInArrow(answer, ANSWERS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = common.file_system(folder)

        def sums_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            out = np.zeros(len(bounds) - 1)
            some = np.diff(bounds) > 0
            if some.any():
                out[some] = np.add.reduceat(values, bounds[:-1][some])
            return out

        def flush(name: str, got: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            with system.open_input_file(f"{inner}/{name}") as source:
                part = pa.Table.from_batches([b for b in _batches(pa.ipc.open_file(source))]).combine_chunks().to_batches()[0]
            words, grams = Counted(), Counted()
            for own in textkit.slices(part, "text", RANGE):
                data, at = textkit.buffers(own.column("text"))
                found = np.unique(textkit.word_hashes(data, at, lower=True)[0] >> np.uint64(1))
                words.add(found, np.zeros(len(found), np.int64))
                full, bounds = ended(data, at)
                for s, e in ranges(len(full)):
                    found = np.unique(byte_grams(full, bounds, s, e))
                    grams.add(found, np.zeros(len(found), np.int64))
            word_keys, gram_keys = words.merge()[0], grams.merge()[0]
            count, log = np.zeros(len(word_keys)), np.zeros(len(gram_keys))
            for shard, has_words, own in parted(word_keys, gram_keys):
                data = got.pop(shard)
                if has_words:
                    count[own] = counts_back(data, 8)
                else:
                    log[own] = np.ascontiguousarray(unpacked(data, np.uint8).reshape(8, -1).T).view("<f8").reshape(-1)
            below = math.log10(total_tokens + vocabulary + 1)
            base_of, known_of = np.log10(count + 1) - below, (count > 0).astype(np.float64)
            for own in textkit.slices(part, "text", RANGE):
                data, at = textkit.buffers(own.column("text"))
                hashes, _, _, bounds = textkit.word_hashes(data, at, lower=True)
                which = np.searchsorted(word_keys, hashes >> np.uint64(1))
                base = sums_by_row(base_of[which], bounds) + (math.log10(ends + 1) - below)
                known = sums_by_row(known_of[which], bounds) + (ends > 0)
                tokens = np.diff(bounds) + 1
                del hashes, which
                full, bounds = ended(data, at)
                total = np.zeros(own.num_rows)
                for s, e in ranges(len(full)):
                    total += sums_by_row(log[np.searchsorted(gram_keys, byte_grams(full, bounds, s, e))], np.clip(bounds, s, e) - s)
                size = np.diff(at)
                bits = -total / math.log10(2) / (size + 1)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("held"), pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(own.num_rows, total_tokens, np.int64)), pa.array(base), pa.array(total), pa.array(size.astype(np.int64)), pa.array(bits)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
                )
            textkit.release()

        name, got = None, {}
        for row in rows_of(batches):
            if name is not None and row["block"] != name:
                yield from flush(name, got)
                got = {}
            name = row["block"]
            got[row["shard"]] = row["answer"]
        if name is not None:
            yield from flush(name, got)

    return answers.repartition(shards, "block").sortWithinPartitions("block").mapInArrow(score, RESULT)


def _batches(reader) -> Iterator[pa.RecordBatch]:
    for k in range(reader.num_record_batches):
        yield reader.get_batch(k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(common.documents(spark, sf_dir))
    return found.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
