"""Audio preparation: decoding, resampling, fitting to ten seconds, log-mel spectrograms. Numpy in Arrow batches."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mediafold.functions.mel import CORNER_HZ, CORNER_MEL, LOG_STEP, STEP

# Fixed values of the audio tower's input.
RATE = 48_000
SAMPLES = 480_000
FFT, HOP, BANDS = 1024, 480, 64
LOW_HZ, HIGH_HZ = 50.0, 14_000.0
TAPS, CUTOFF = 256, 0.95
FLOOR = 1e-10


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and their rate. Raises ValueError for what is no PCM WAV."""
    try:
        with wave.open(io.BytesIO(content), "rb") as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError) as e:
        raise ValueError(f"not a PCM WAV file: {e}") from e
    if not rate:
        raise ValueError("no sample rate")
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / (1 << 8 * width - 1)
    return x.reshape(-1, channels).mean(axis=1), rate


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Windowed-sinc resampling to floor(n * to / rate) samples, in blocks."""
    if rate == to or not len(x):
        return x
    n = len(x) * to // rate
    scale = min(1.0, to / rate) * CUTOFF
    half = TAPS // 2
    padded = np.pad(x.astype(np.float64), half)
    out = np.empty(n, np.float32)
    for at in range(0, n, 4096):
        t = np.arange(at, min(n, at + 4096)) * (rate / to)
        base = np.floor(t).astype(np.int64)
        k = np.arange(-half + 1, half + 1)
        d = (t - base)[:, None] - k
        phase = (d / half + 1) / 2
        window = 0.35875 - 0.48829 * np.cos(2 * np.pi * phase) + 0.14128 * np.cos(4 * np.pi * phase) - 0.01168 * np.cos(6 * np.pi * phase)
        window[(phase < 0) | (phase > 1)] = 0
        weights = scale * np.sinc(scale * d) * window
        out[at : at + len(t)] = (padded[base[:, None] + k + half] * weights).sum(axis=1)
    return out


def fit(x: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """Exactly n samples: the middle of a longer sound, a shorter one repeated."""
    if len(x) >= n:
        start = (len(x) - n) // 2
        return x[start : start + n]
    return np.resize(x, n) if len(x) else np.zeros(n, np.float32)


def reflect_pad(x: np.ndarray, pad: int) -> np.ndarray:
    """Mirrored at both ends, the end sample itself not repeated."""
    return np.pad(x, pad, mode="reflect")


def mel(hz):
    hz = np.asarray(hz, float)
    return np.where(hz >= CORNER_HZ, CORNER_MEL + np.log(np.maximum(hz, 1e-9) / CORNER_HZ) / LOG_STEP, hz / STEP)


def hz(m):
    m = np.asarray(m, float)
    return np.where(m >= CORNER_MEL, CORNER_HZ * np.exp(LOG_STEP * (m - CORNER_MEL)), m * STEP)


@lru_cache(maxsize=2)
def mel_bank(bands: int = BANDS) -> np.ndarray:
    """bands x (FFT / 2 + 1): triangles between equal steps of the mel scale, each of the same area."""
    edges = hz(np.linspace(mel(LOW_HZ), mel(HIGH_HZ), bands + 2))
    bins = np.arange(FFT // 2 + 1) * RATE / FFT
    up = (bins - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - bins) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x: np.ndarray) -> np.ndarray:
    """frames x BANDS in decibels; 1001 frames for ten seconds."""
    padded = reflect_pad(x.astype(np.float32), FFT // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, FFT)[::HOP]
    window = np.hanning(FFT + 1)[:-1].astype(np.float32)
    spectrum = np.fft.rfft(frames * window, axis=1)
    return (10 * np.log10(np.maximum((spectrum.real**2 + spectrum.imag**2) @ mel_bank().T, FLOOR))).astype(np.float32)


def too_short(n: int, rate: int, gate: float = 0.35) -> bool:
    return not n or n / rate < gate


def audio_tensors(files: DataFrame, id_col: str = "path", content_col: str = "content", gate: float = 0.35) -> DataFrame:
    """``id_col``, duration_s, tensor (frames x BANDS, flat; null for sounds under the gate) and error. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                duration = tensor = error = None
                try:
                    x, rate = decode_wav(batch.column(1)[k].as_py() or b"")
                    duration = len(x) / rate
                    if not too_short(len(x), rate, gate):
                        tensor = log_mel(fit(resample(x, rate))).ravel()
                except (ValueError, KeyError) as e:
                    error = str(e)
                arrays = [batch.column(0).slice(k, 1), pa.array([duration], pa.float64()), pa.array([tensor], pa.list_(pa.float32())), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "duration_s", "tensor", "error"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(files[id_col].alias("id"), files[content_col].alias("content")).mapInArrow(run, f"id {kind}, duration_s double, tensor array<float>, error string").withColumnRenamed("id", id_col)
