"""Media columns: WAV bytes read by the wave module, short-time Fourier transforms and spectral-peak pair fingerprints.

``fingerprint_media`` takes a binary column of WAV files and stores time-coded arrays: for each landmark the frame of its
first peak and a code of both peaks' frequencies and their distance in frames. ``text_to_wav`` stores texts as WAV columns.

Defined cases: a null or empty text is a payload of one block of blanks; null media give null arrays; bytes that are no WAV
file give null arrays and the error's text; constant sound (no energy outside frequency zero) has no landmarks; repeated
rows are computed alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from mediafold.llm._common import table

BLOCK = 192
FRAME, HOP = BLOCK, BLOCK // 2
RATE = 8000
BANDS = (1, 12, 36, FRAME // 2 + 1)  # of frequency bins; each frame has one candidate in each band
FAN_OUT, REACH = 3, 32  # each peak is paired with the next ones, up to so many frames away
FRAMES_AT_ONCE = 2048
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)  # periodic


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono: each byte is a sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> tuple[bytes, int, int]:
    """The stored frames, the width of a sample and the number of channels."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()


def samples(frames: bytes, width: int, channels: int) -> np.ndarray:
    """Mono samples about zero, whatever the width."""
    if width == 1:
        x = np.frombuffer(frames, np.uint8).astype(np.float32) - 128
    elif width == 3:
        b = np.frombuffer(frames, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float32)
    else:
        x = np.frombuffer(frames, {2: "<i2", 4: "<i4"}[width]).astype(np.float32)
    return x if channels == 1 else x.reshape(-1, channels).mean(axis=1)


def spectral_peaks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and frequency bins of the peaks, ordered by both: the strongest bin of a band where it is no weaker than the
    bins beside it, in the next band too, and louder than the band's in the frames before and after. The spectra are made in blocks of frames, so memory is bounded."""
    n = max(1, -(-len(x) // HOP))
    padded = np.zeros((n + 1) * HOP, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    bands = list(zip(BANDS, BANDS[1:], strict=False))
    best, loud, summit = np.empty((n, len(bands)), np.int32), np.empty((n, len(bands)), np.float32), np.empty((n, len(bands)), bool)
    for at in range(0, n, FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[at : at + FRAMES_AT_ONCE] * _WINDOW, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for b, (low, high) in enumerate(bands):
            k = power[:, low:high].argmax(axis=1) + low
            row, part = np.arange(len(k)), slice(at, at + len(k))
            best[part, b], loud[part, b] = k, power[row, k]
            summit[part, b] = (power[row, k] >= power[row, k - 1]) & (power[row, k] >= power[row, np.minimum(k + 1, power.shape[1] - 1)])
    peak = summit & (loud > 1e-3)
    peak[1:] &= loud[1:] >= loud[:-1]
    peak[:-1] &= loud[:-1] > loud[1:]
    at, _ = np.nonzero(peak)
    return at.astype(np.int32), best[peak]


def landmarks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the peak pairs, ordered by time and code."""
    t, f = spectral_peaks(x)
    times, codes = [], []
    for k in range(1, min(FAN_OUT, max(len(t) - 1, 0)) + 1):
        gap = t[k:] - t[:-k]
        near = gap <= REACH
        times.append(t[:-k][near])
        codes.append((f[:-k] << 16 | f[k:] << 6 | gap)[near])
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order].astype(np.int32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b" "), len(raw)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            made = [payload_of(t) for t in part.column(1).to_pylist()]
            arrays = [part.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([to_wav(p) for p, _ in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "media"])


def text_to_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes and media: each text's UTF-8 bytes, filled up with blanks, as the samples of a WAV file."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_texts, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def describe(media: bytes | None) -> dict:
    if media is None:
        return {}
    try:
        frames, width, channels = read_wav(media)
        t, code = landmarks(samples(frames, width, channels))
    except (wave.Error, EOFError, KeyError, ValueError) as e:
        return {"error": f"{type(e).__name__}: {e}"}
    return {
        "payload_bytes": len(frames), "payload_sha256": hashlib.sha256(frames).hexdigest(), "tail_crc32": zlib.crc32(frames[-16:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "times": t, "codes": code,
    }


_FACTS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "error": pa.string()}


def _media(digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [describe(m) for m in part.column(2).to_pylist()]
                arrays = [part.column(0), part.column(1), *(pa.array([x.get(k) for x in found], kind) for k, kind in _FACTS.items())]
                if digests:
                    arrays += [
                        pa.array([len(x["times"]) if "times" in x else None for x in found], pa.int64()),
                        pa.array([hashlib.sha256(x["times"].astype("<i4").tobytes() + x["codes"].astype("<i4").tobytes()).hexdigest() if "times" in x else None for x in found], pa.string()),
                    ]
                else:
                    arrays += [pa.array([x.get(k) for x in found], pa.list_(pa.int32())) for k in ("times", "codes")]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", *_FACTS, *(("n_landmarks", "feature") if digests else ("times", "codes"))])

    return run


def fingerprint_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", digests: bool = False) -> DataFrame:
    """One row per WAV file: its stored bytes' facts and its landmarks as ``times`` and ``codes`` (array<int>).

    With ``digests`` the arrays are replaced by their number and the SHA-256 of their little-endian bytes (``feature``).
    ``n_bytes`` is passed on where the input has it. No shuffle.
    """
    from pyspark.sql import functions as F

    n_bytes = media["n_bytes"] if "n_bytes" in media.columns else F.lit(None).cast("long")
    rows = media.select(media[id_col].alias("id"), n_bytes.alias("n_bytes"), media[media_col].alias("media"))
    kind = media.schema[id_col].dataType.simpleString()
    facts = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"
    made = "n_landmarks long, feature string" if digests else "times array<int>, codes array<int>"
    return rows.mapInArrow(_media(digests), f"id {kind}, n_bytes long, {facts}, {made}").withColumnRenamed("id", id_col)


def op10_wav_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_media(text_to_wav(table(spark, sf_dir, "documents")), digests=True)
