"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order::

    data block*  |  index  |  Bloom filter  |  footer

* A key is the identifier as eight big-endian bytes with the sign bit turned,
  then a four-byte number that tells repeated identifiers apart.
* An entry is ``shared, unshared, value length`` (varints), the unshared key
  bytes and the ids (little-endian, two bytes each where all of the block fit).
  ``shared`` counts the bytes that the key has in common with the one before;
  each block starts afresh.
* A block is ``width byte + entries``, compressed with zstd, with a CRC-32.
* The sparse index has the last key, place and size of each block, the Bloom
  filter ten bits a key; the footer has their places, counts and a magic word.

``lookup`` asks the filter, finds the block by binary search in the index and
reads that block alone.

Nulls, empties and ties: a null text is empty (its only id is the end id); a
null identifier sorts first and comes back as null; rows with one identifier
are all kept, ordered by text.  An empty table gives no shard and no rows.
Columns other than the identifier and the text are never read.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import common, textkit
from tessella.llm.tokens import default_tokenizer, encoder

MAGIC = b"TSLSST01"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES = 256 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
MANIFEST = "path string, first_key binary, docs long, tokens long, bytes long"
TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_bytes(doc_id: int | None, repeat: int = 0) -> bytes:
    return struct.pack(">QI", (common.NULL_ID if doc_id is None else doc_id) + 2**63, repeat)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), 12)
    high = textkit.mix(np.ascontiguousarray(raw[:, :8]).view(">u8").astype(np.uint64).reshape(-1) + raw[:, 8:].astype(np.uint64) @ np.array([1, 3, 5, 7], np.uint64))
    step = textkit.mix(high) | np.uint64(1)
    return (high[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class Writer:
    """Appends entries in key order to an open stream."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.packer = sink, zstandard.ZstdCompressor(level=1)
        self.place = self.tokens = 0
        self.keys: list[bytes] = []
        self.index: list[tuple[bytes, int, int]] = []
        self.block: list[tuple[bytes, np.ndarray]] = []
        self.size = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.block.append((key, ids))
        self.tokens += len(ids)
        self.size += 2 * len(ids) + 16
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.block:
            return
        wide = any(len(ids) and int(ids.max()) > 0xFFFF for _, ids in self.block)
        parts, last = [b"\x04" if wide else b"\x02"], b""
        for key, ids in self.block:
            value = ids.astype("<u4" if wide else "<u2").tobytes()
            shared = next((i for i, (a, b) in enumerate(zip(last, key, strict=False)) if a != b), len(last))
            parts += [varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value]
            last = key
        self.write_block(b"".join(parts), last)
        self.block, self.size = [], 0

    def write_block(self, raw: bytes, last: bytes) -> None:
        data = self.packer.compress(raw)
        data += struct.pack("<I", zlib.crc32(data))
        self.sink.write(data)
        self.index.append((last, self.place, len(data)))
        self.place += len(data)

    def close(self) -> int:
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(p) + varint(n) for k, p, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        if self.keys:
            bloom[bloom_places(self.keys, bits).reshape(-1).astype(np.int64)] = 1
        packed = np.packbits(bloom).tobytes()
        footer = FOOTER.pack(self.place, len(index), self.place + len(index), bits, len(self.keys), self.tokens, MAGIC)
        self.sink.write(index + packed + footer)
        return self.place + len(index) + len(packed) + len(footer)


class Reader:
    """Reads a shard through any seekable file."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        index_at, index_size, bloom_at, self.bits, self.docs, self.tokens, magic = FOOTER.unpack(self.read(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw, at = self.read(index_at, index_size), 0
        self.last_keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        while at < len(raw):
            n, at = read_varint(raw, at)
            self.last_keys.append(raw[at : at + n])
            place, at = read_varint(raw, at + n)
            size, at = read_varint(raw, at)
            self.places.append((place, size))
        self.bloom = np.unpackbits(np.frombuffer(self.read(bloom_at, -(-self.bits // 8)), np.uint8))

    def read(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return bytes(self.source.read(size))

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self.read(*self.places[k])
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        raw = self.unpacker.decompress(data[:-4])
        kind, at, last = "<u4" if raw[0] == 4 else "<u2", 1, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            own, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            last = last[:shared] + raw[at : at + own]
            at += own
            yield last, np.frombuffer(raw[at : at + size], kind)
            at += size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def lookup(self, doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
        key = key_bytes(doc_id, repeat)
        if not self.docs or not self.bloom[bloom_places([key], self.bits).reshape(-1).astype(np.int64)].all():
            return None
        k = bisect.bisect_left(self.last_keys, key)
        if k == len(self.places):
            return None
        return next((ids for found, ids in self.block(k) if found == key), None)


def open_shard(path: str) -> Reader:
    system, inner = common.file_system(path)
    return Reader(system.open_input_file(inner))


def write_shards(docs: DataFrame, out: str, tokenizer_path: str | None = None, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` and write one shard for each range of identifiers under ``out``.

    Returns the manifest, one row a shard.  A task that runs again writes a file
    of another name; the manifest names the file of the run that counted.
    """
    path, spark = tokenizer_path or default_tokenizer(), docs.sparkSession
    common.small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = common.file_system(out)
        code, writer, name, last, repeat, first = encoder(path), None, f"{uuid.uuid4().hex}.sst", None, 0, b""
        for part in textkit.regrouped(batches, "text", 4 << 20, 4 << 20):
            if writer is None:
                system.create_dir(inner, recursive=True)
                sink = system.open_output_stream(f"{inner}/{name}")
                writer = Writer(sink)
            ids, bounds = code.encode(*textkit.buffers(part.column("text")))
            ends = np.uint32(end_id)
            for row, doc in enumerate(part.column("doc_id").to_pylist()):
                repeat = repeat + 1 if writer.keys and doc == last else 0
                last, key = doc, key_bytes(doc, repeat)
                first = first or key
                writer.add(key, np.append(ids[bounds[row] : bounds[row + 1]], ends))
        if writer is not None:
            size = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{out}/{name}"], "first_key": [first], "docs": [len(writer.keys)], "tokens": [writer.tokens], "bytes": [size]})

    ranged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(partitions or common.shuffle_partitions(spark), "doc_id")
    manifest = ranged.sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Each document of the shards: identifier, ids before it, count and CRC-32 of its ids.

    Nothing is grouped: the shards' first ids come from a running sum over the
    manifest, one row a shard.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = open_shard(name)
                for k in range(len(shard.places)):
                    keys, sizes, sums = [], [], []
                    for key, ids in shard.block(k):
                        number = struct.unpack(">Q", key[:8])[0] - 2**63
                        keys.append(None if number == common.NULL_ID else number)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    ends = at + np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = int(ends[-1])

    base = F.coalesce(F.sum("tokens").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", "tokens", "first_key").withColumn("base", base).select("path", "base")
    return placed.repartition(max(1, common.shuffle_partitions(manifest.sparkSession)), "path").mapInArrow(read, TOKENS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(common.documents(spark, sf_dir), common.scratch(spark, "sst")))
