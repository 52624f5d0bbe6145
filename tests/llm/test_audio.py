"""Filters and features against direct computation, blocks, and the memory of a long text."""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import audio


def direct_resample(x: np.ndarray) -> np.ndarray:
    """Each value as the windowed-sinc sum around its place in the input, by definition."""
    up, down, half = audio.UP, audio.DOWN, audio.HALF
    signal = (x.astype(np.float64) - 128) / 128
    out = []
    for n in range(-(-len(x) * up // down)):
        place = n * down / up
        weights, total = [], 0.0
        for i in range(int(np.floor(place)) - half + 1, int(np.floor(place)) + half + 1):
            # the filter in units of the finer grid
            t = (i - place) * up
            w = np.sinc(t / max(up, down)) * (0.5 + 0.5 * np.cos(np.pi * t / (half * up)))
            weights.append(w)
            total += w * (signal[i] if 0 <= i < len(signal) else 0.0)
        out.append(total / sum(weights))
    return np.array(out)


def samples(n: int, seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 256, n).astype(np.uint8)


def test_resampling_equals_its_definition():
    for n in (64, 67, 320):
        x = samples(n, n)
        total = -(-n * audio.UP // audio.DOWN)
        np.testing.assert_allclose(audio.resample(x, 0, total), direct_resample(x), atol=2e-5)


def test_resampling_in_blocks_equals_the_whole():
    x = samples(5000, 1)
    whole = audio.resample(x, 0, 4000)
    parts = [audio.resample(x, k, min(k + 256, 4000)) for k in range(0, 4000, 256)]
    np.testing.assert_allclose(np.concatenate(parts), whole, atol=1e-6)


def test_mel_energies_equal_their_definition(monkeypatch):
    x = samples(1500, 2)
    y = direct_resample(x)
    rate = audio.RATE * audio.UP / audio.DOWN
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hertz(m) for m in np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), audio.MELS + 2)]
    mel, level = audio.log_mel(x)
    frames = -(-(len(y) - audio.FRAME) // audio.HOP) + 1
    assert mel.shape == (frames, audio.MELS)
    for f in range(frames):
        own = np.zeros(audio.FRAME)
        part = y[f * audio.HOP : f * audio.HOP + audio.FRAME]
        own[: len(part)] = part
        assert level[f] == pytest.approx(10 * np.log10(np.mean(own**2) + 1e-9), abs=1e-3)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(audio.FRAME) + 0.5) / audio.FRAME)
        for b in (0, 7, audio.MELS - 1):
            energy = 0.0
            for k in range(audio.FRAME // 2 + 1):
                value = np.sum(own * window * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FRAME))
                at = k * rate / audio.FRAME
                rise, fall = (at - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - at) / (edges[b + 2] - edges[b + 1])
                energy += abs(value) ** 2 * max(0.0, min(rise, fall))
            assert mel[f, b] == pytest.approx(np.log10(max(energy, 10**audio.FLOOR)), abs=2e-3)
    monkeypatch.setattr(audio, "BLOCK", 4)
    again = audio.log_mel(x)
    np.testing.assert_allclose(again[0], mel, atol=1e-3)
    np.testing.assert_allclose(again[1], level, atol=1e-3)


def test_segments_open_and_close_at_their_own_levels():
    level = np.array([-20, -10, -8, -12, -14, -16, -12, -9, -9, -15, -15.1], np.float32)
    assert audio.segments(level).tolist() == [[2, 5], [7, 10]]
    assert audio.segments(np.array([-5.0, -5.0])).tolist() == [[0, 2]] and audio.segments(np.array([-12.0])).tolist() == []


def test_tensors_of_several_batches():
    frames = audio.BLOCK + 70
    mel = np.random.default_rng(3).random((frames, audio.MELS)).astype(np.float32)
    with pa.ipc.open_stream(io.BytesIO(audio.tensor_stream(mel, 6400.0))) as reader:
        table = reader.read_all()
    back = np.concatenate([c.storage.flatten().to_numpy() for c in table["log_mel"].chunks]).reshape(-1, audio.MELS)
    assert table.num_rows == -(-frames // audio.TENSOR_FRAMES) and np.array_equal(back[:frames], mel)
    assert sum(table["frames"].to_pylist()) == frames and table["start"].to_pylist() == [k * audio.TENSOR_FRAMES * audio.HOP / 6400.0 for k in range(table.num_rows)]


def test_a_long_text_takes_little_memory():
    import tracemalloc

    raw = bytes(20 << 20)
    tracemalloc.start()
    media = audio.wav(memoryview(raw))
    payload, rate = audio.wav_samples(memoryview(media))
    tensors, spans, frames, _ = audio.features(payload, rate)
    hashlib.sha256(tensors)
    assert tracemalloc.get_traced_memory()[1] < 6 * len(raw) and frames > 100_000
    tracemalloc.stop()
