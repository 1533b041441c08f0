"""What the tasks read of a media file: facts from programs, one vector and its tags, and what is attached to a request. Each file is opened and decoded once for each."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafold.functions.headers import image_dims
from mediafold.functions.metadata import exif_metadata, probe_metadata
from mediafold.functions.text import missing_binary, short_sound
from mediafold.operators.dsp import decode_wav, fit, log_mel, resample, too_short
from mediafold.operators.imageprep import decode_image, image_tensor
from mediafold.operators.zeroshot import SMALLEST, Gate
from mediafold.sources.external import EXIF, PROBE, ProgramError, run_program

FFMPEG = ["ffmpeg", "-v", "error", "-y"]
MIN_SECONDS = 0.35
PROGRAM_SECONDS, FRAME_SECONDS, TRANSCODE_SECONDS = 30.0, 60.0, 300.0


@dataclass(frozen=True)
class Programs:
    probe: tuple[str, ...] = tuple(PROBE)
    exif: tuple[str, ...] = tuple(EXIF)
    ffmpeg: tuple[str, ...] = tuple(FFMPEG)


def _answers(programs: Programs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                began, raw, failure, seconds, rate = time.monotonic(), None, None, None, None
                try:
                    raw = run_program([*(programs.exif if kind == "image" else programs.probe), path], PROGRAM_SECONDS).decode("utf-8", "replace")
                except ProgramError as e:
                    failure = str(e)
                    if kind == "audio":  # what a sound says of itself
                        try:
                            with open(path, "rb") as f:
                                x, rate = decode_wav(f.read())
                            seconds = len(x) / rate
                        except (OSError, ValueError, KeyError):
                            pass
                out.append((path, raw, failure, seconds, rate, int(1000 * (time.monotonic() - began))))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "raw", "failure", "seconds", "rate", "probe_ms"])

    return run


def with_facts(files: DataFrame, programs: Programs = Programs()) -> DataFrame:  # noqa: B008
    """files with metadata (JSON), duration_s and probe_ms. A program that isn't installed leaves what the header or a WAV file says, and a note; one that fails makes an error."""
    asked = files.filter("error IS NULL").select("path", "type").mapInArrow(_answers(programs), "path string, raw string, failure string, seconds double, rate long, probe_ms long")
    rows = files.join(asked, "path", "left")
    image, missing = F.col("type") == "image", missing_binary(F.col("failure"))
    shaped = F.when(image, F.to_json(exif_metadata(F.col("raw")))).otherwise(F.to_json(probe_metadata(F.col("raw"))))
    program = F.when(image, F.lit("exiftool")).otherwise(F.lit("ffprobe"))
    note = F.concat(program, F.lit(" not found; minimal metadata only"))
    dims = image_dims(F.col("header"))
    plain = F.to_json(F.struct(F.col("seconds").alias("duration_s"), dims["height"].alias("height"), note.alias("note"), F.col("rate").alias("sample_rate"), dims["width"].alias("width")))
    error = F.when(F.col("failure").isNotNull() & ~missing, F.col("failure")).when(F.col("raw").isNotNull() & shaped.isNull(), F.concat(program, F.lit(" output: no JSON")))
    rows = rows.withColumns({"metadata": F.when(F.col("raw").isNotNull(), shaped).when(missing, plain), "error": F.coalesce("error", error)})
    rows = rows.withColumn("duration_s", F.get_json_object("metadata", "$.duration_s").try_cast("double"))
    return rows.drop("raw", "failure", "seconds", "rate")


def frame(path: str, seconds: float, ffmpeg: tuple[str, ...] = tuple(FFMPEG)) -> bytes:
    """A video's frame at a time, as PNG."""
    with tempfile.TemporaryDirectory() as folder:
        out = os.path.join(folder, "frame.png")
        run_program([*ffmpeg, "-ss", f"{seconds:.3f}", "-i", path, "-frames:v", "1", out], FRAME_SECONDS)
        try:
            with open(out, "rb") as f:
                return f.read()
        except OSError:
            return b""


def frames(path: str, n: int, duration: float | None, ffmpeg: tuple[str, ...] = tuple(FFMPEG)) -> list[bytes]:
    """The middles of n equal parts; those that fail are left out, but for a program that isn't there. ProgramError if none is left."""
    n = max(n, 1)
    found, last = [], None
    for t in [duration * (i + 0.5) / n for i in range(n)] if duration and duration > 0 else [0.0]:
        try:
            if data := frame(path, t, ffmpeg):
                found.append(data)
        except ProgramError as e:
            if "not found" in str(e):
                raise
            last = e
    if not found:
        raise last or ProgramError("no frame extracted")
    return found


def sound_for_request(path: str, mime: str, ffmpeg: tuple[str, ...] = tuple(FFMPEG)) -> tuple[bytes, str]:
    """MP3: the file itself, or a mono copy of 16 kHz."""
    if mime == "audio/mpeg":
        with open(path, "rb") as f:
            return f.read(), "mp3"
    with tempfile.TemporaryDirectory() as folder:
        out = os.path.join(folder, "sound.mp3")
        run_program([*ffmpeg, "-i", path, "-vn", "-ac", "1", "-ar", "16000", "-b:a", "64k", out], TRANSCODE_SECONDS)
        with open(out, "rb") as f:
            if not (data := f.read()):
                raise ProgramError("empty sound")
        return data, "mp3"


@dataclass(frozen=True)
class Attach:
    """Reads what goes with a request, in the task that asks: an image, a video's frames, a sound if that is wanted. An OSError or ProgramError says why it can't."""

    n_frames: int = 4
    sound: bool = False
    programs: Programs = Programs()

    def __call__(self, path: str, kind: str, mime: str, duration: float | None) -> tuple[list[tuple[bytes, str]], tuple[bytes, str] | None]:
        if kind == "image":
            try:
                with open(path, "rb") as f:
                    return [(f.read(), mime)], None
            except OSError as e:
                raise ProgramError(f"read for vision: {e.strerror}") from e
        if kind == "video":
            return [(f, "image/png") for f in frames(path, self.n_frames, duration, self.programs.ffmpeg)], None
        return [], sound_for_request(path, mime, self.programs.ffmpeg) if self.sound else None


def tensor_of(path: str, kind: str, duration: float | None, gate: float, programs: Programs) -> np.ndarray | None:
    """The tagger's input; None for a sound that is too short. A video's is that of the frame in its middle."""
    if kind == "audio":
        with open(path, "rb") as f:
            x, rate = decode_wav(f.read())
        return None if too_short(len(x), rate, gate) else log_mel(fit(resample(x, rate)))
    if kind == "video":
        return image_tensor(decode_image(frames(path, 1, duration, programs.ffmpeg)[0]))
    with open(path, "rb") as f:
        return image_tensor(decode_image(f.read()))


def ranked_labels(vector: np.ndarray, labels: list[str], matrix: np.ndarray, gate: Gate) -> list[tuple[float, str]] | None:
    """The labels that pass the gate, best first, ties in label order; None if it is shut."""
    v = np.asarray(vector, np.float64)
    with np.errstate(all="ignore"):
        n = np.sqrt((v * v).sum())
        s = matrix @ v / n
    if not SMALLEST <= n < np.inf:
        return None
    order = np.argsort(-s, kind="stable")
    top, second = s[order[0]], s[order[1]] if len(order) > 1 else 0.0
    if not (top >= gate.hi or (top >= gate.lo and top - second >= gate.margin)):
        return None
    return [(float(s[k]), labels[k]) for k in order[: gate.k] if s[k] >= top * gate.rel]


def tagged(files: DataFrame, embed: Callable[[np.ndarray], np.ndarray], labels: list[str], matrix: np.ndarray, gate: Gate, min_seconds: float = MIN_SECONDS, programs: Programs = Programs()) -> DataFrame:  # noqa: B008
    """path, found (labels), score, failure and tag_ms. files: path, type, duration_s. A file is read, decoded, embedded and scored in one place; short sounds aren't opened."""
    vocab = np.asarray(matrix, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, kind, duration, short in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                began, found, failure = time.monotonic(), None, None
                if not short:
                    try:
                        tensor = tensor_of(path, kind, duration, min_seconds, programs)
                        found = None if tensor is None else ranked_labels(embed(np.asarray(tensor, np.float32).ravel()), labels, vocab, gate)
                    except Exception as e:  # noqa: BLE001  whatever a file or a model says becomes the row's error
                        failure = str(e)
                out.append((path, found and [x for _, x in found], found[0][0] if found else None, failure, int(1000 * (time.monotonic() - began))))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.list_(pa.string()), pa.float64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "found", "score", "failure", "tag_ms"])

    short = short_sound(F.col("duration_s"), min_seconds) & (F.col("type") == "audio")
    return files.select("path", "type", "duration_s", short.alias("short")).mapInArrow(run, "path string, found array<string>, score double, failure string, tag_ms long")


def lean_json(text: str | None) -> dict:
    """Metadata without the container's own tags, which would crowd out the medium."""
    value = json.loads(text) if isinstance(text, str) else {}
    return {k: v for k, v in value.items() if k != "format_tags"}
