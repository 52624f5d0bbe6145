"""Audio columns: texts' bytes as 8-bit samples, and features of the samples.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the
samples of a mono WAV file of unsigned 8-bit PCM, which stores them without
loss.  Features come from the bytes read back out of that file:

* resampling by ``UP / DOWN`` with a windowed-sinc filter in polyphase form:
  each output phase has its own short filter over the input;
* log-mel energies of overlapping, windowed frames;
* segments by energy with hysteresis: one opens where a frame's level reaches
  ``OPEN_DB`` and closes where it falls below ``CLOSE_DB``;
* the frames in tensors of one fixed shape, ``TENSOR_FRAMES x MELS``, the last
  one padded with the floor value, each with the time span of its frames, as an
  Arrow stream whose column has the fixed-shape tensor type.

A document is computed alone and in blocks of fixed size, so equal texts give
equal bytes.  Resampled values and frames exist for one block of ``BLOCK``
frames at a time; what a document holds at once is its text, its WAV file, and
its mel energies and tensors, together about five bytes a byte of text.

Nulls, empties and ties: a null or empty text is 64 zero bytes; a null
identifier stays null; repeated rows give equal rows; an empty table gives no
rows; columns other than the identifier and the text are never read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, textkit

RATE, UP, DOWN, HALF = 8000, 4, 5, 8
FRAME, HOP, MELS = 256, 128, 24
TENSOR_FRAMES, FLOOR = 64, -12.0
OPEN_DB, CLOSE_DB = -9.0, -15.0
BLOCK = 2048
PAD = 64
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_tensors long, n_segments long, seconds double"
OUTPUTS = ", media binary, tensors binary, segments array<struct<start:double,stop:double>>"


def wav(raw: bytes | memoryview, rate: int = RATE) -> bytes:
    """A WAV file of the bytes, padded with zeros to a positive multiple of ``PAD``."""
    pad = -len(raw) % PAD if len(raw) else PAD
    size = len(raw) + pad
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", size)
    return b"".join((head, raw, bytes(pad)))


def wav_samples(media: bytes | memoryview) -> tuple[bytes | memoryview, int]:
    """(samples, rate) of an 8-bit mono WAV file, a view if given one; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif kind == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


def polyphase_filters(up: int = UP, down: int = DOWN, half: int = HALF) -> np.ndarray:
    """One filter a phase, [phase, tap], of a Hann-windowed sinc cut at the lower of both bands."""
    n = np.arange(-half * up, half * up)
    cut = 1.0 / max(up, down)
    taps = cut * np.sinc(cut * n) * (0.5 + 0.5 * np.cos(np.pi * n / (half * up)))
    phases = taps.reshape(2 * half, up).T * up
    return phases / phases.sum(axis=1, keepdims=True)


FILTERS = polyphase_filters()


def resample(x: np.ndarray, first: int, last: int, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Values first to last of the ``len(x) * up / down``, rounded up, that 8-bit samples give; ``first`` is a multiple of ``up``.

    The signal is zero outside.
    """
    taps = FILTERS.shape[1]
    origin = first * down // up
    begin, end = origin + 1 - taps // 2, (last - 1) * down // up + 1 + taps // 2
    near = np.zeros(end - begin, np.float32)
    inside = x[max(0, begin) : end]
    near[max(0, -begin) : max(0, -begin) + len(inside)] = (inside.astype(np.float32) - 128) / 128
    out = np.empty(last - first, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(near, taps)
    for k in range(min(up, last - first)):
        at, phase = divmod(k * down, up)
        count = -(-(last - first - k) // up)
        out[k::up] = np.ascontiguousarray(view[at::down][:count]) @ FILTERS[phase][::-1].astype(np.float32)
    return out


def mel_bank(rate: float, size: int = FRAME, bands: int = MELS) -> np.ndarray:
    """Triangles [bin, band], evenly spaced on the mel scale from 0 to half the rate."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    bins = np.arange(size // 2 + 1)[:, None] * rate / size
    rise, fall = (bins - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - bins) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


BANK = mel_bank(RATE * UP / DOWN)
WINDOW = (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(FRAME) + 0.5) / FRAME)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 mel energies [frame, band], level of each frame in dB) of 8-bit samples; at least one frame, the end padded with zeros."""
    total = -(-len(x) * UP // DOWN)
    frames = max(1, -(-(total - FRAME) // HOP) + 1)
    out, level = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for k in range(0, frames, BLOCK):
        count = min(BLOCK, frames - k)
        y = np.zeros((count - 1) * HOP + FRAME, np.float32)
        stop = min(total, k * HOP + len(y))
        y[: stop - k * HOP] = resample(x, k * HOP, stop)
        part = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        level[k : k + count] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-9)
        spectrum = np.fft.rfft(part * WINDOW, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[k : k + count] = np.log10(np.maximum(power @ BANK, np.float32(10**FLOOR)))
    return out, level


def segments(level: np.ndarray, open_db: float = OPEN_DB, close_db: float = CLOSE_DB) -> np.ndarray:
    """[first frame, frame after the last] of each segment."""
    sign = np.where(level >= open_db, 1, np.where(level < close_db, -1, 0))
    sign[0] = sign[0] or -1
    known = np.maximum.accumulate(np.where(sign != 0, np.arange(len(sign)), 0))
    on = np.concatenate([[False], sign[known] > 0, [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return edge.reshape(-1, 2)


TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS), dim_names=("frame", "mel"))
STREAM = pa.schema([("log_mel", TENSOR), ("start", pa.float64()), ("stop", pa.float64()), ("frames", pa.int32())])


def tensor_stream(mel: np.ndarray, rate: float) -> bytes:
    """An Arrow stream of fixed-shape tensors with their time spans in seconds, ``BLOCK`` frames a batch."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, STREAM) as writer:
        for k in range(0, len(mel), BLOCK):
            part = mel[k : k + BLOCK]
            count = -(-len(part) // TENSOR_FRAMES)
            full = np.full((count * TENSOR_FRAMES, MELS), np.float32(FLOOR))
            full[: len(part)] = part
            storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), TENSOR_FRAMES * MELS)
            first = k + np.arange(count) * TENSOR_FRAMES
            frames = np.minimum(TENSOR_FRAMES, len(mel) - first)
            start, stop = first * HOP / rate, ((first + frames - 1) * HOP + FRAME) / rate
            writer.write_batch(pa.record_batch([pa.ExtensionArray.from_storage(TENSOR, storage), pa.array(start), pa.array(stop), pa.array(frames.astype(np.int32))], schema=STREAM))
    return sink.getvalue()


def features(samples: bytes | memoryview, rate: int = RATE) -> tuple[bytes, np.ndarray, int, float]:
    """(tensor stream, segments in seconds, frames, seconds) of 8-bit samples."""
    own = rate * UP / DOWN
    mel, level = log_mel(np.frombuffer(samples, np.uint8))
    spans = segments(level)
    return tensor_stream(mel, own), np.stack([spans[:, 0] * HOP / own, ((spans[:, 1] - 1) * HOP + FRAME) / own], axis=1), len(mel), len(samples) / rate


def audio_features(docs: DataFrame, with_outputs: bool = False) -> DataFrame:
    """Digests of media and features for each of ``docs(doc_id, text)``.

    ``with_outputs`` adds the WAV files, the tensor streams and the segments
    themselves.  Each partition is worked on where it is read, without shuffle.
    """

    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textkit.regrouped(batches, "text", 2 << 20, 2 << 20):
            data, at = textkit.buffers(part.column("text"))
            rows = []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                media = wav(memoryview(data[s:e]))
                payload, rate = wav_samples(memoryview(media))
                tensors, spans, frames, seconds = features(payload, rate)
                kept = hashlib.sha256(tensors + spans.tobytes()).hexdigest()
                row = [e - s, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), kept, frames, -(-frames // TENSOR_FRAMES), len(spans), seconds]
                rows.append(row + [media, tensors, [{"start": a, "stop": b} for a, b in spans.tolist()]] * with_outputs)
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_tensors", "n_segments", "seconds", "media", "tensors", "segments"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("start", pa.float64()), ("stop", pa.float64())]))]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], ["doc_id", *names[: len(columns)]])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return wanted.mapInArrow(run, DIGEST + (OUTPUTS if with_outputs else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(common.documents(spark, sf_dir))
