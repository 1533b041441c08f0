"""Image preparation: BMP and PNG decoding, bicubic resizing, centre crop and normalisation. Numpy in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE = 224
PIXEL_CAP = 100_000_000
# The image tower's mean and deviation by channel.
MEAN = (0.48145466, 0.4578275, 0.40821073)
DEVIATION = (0.26862954, 0.26130258, 0.27577711)


def check_size(width: int, height: int, cap: int = PIXEL_CAP) -> None:
    if width * height > cap:
        raise ValueError(f"image is {width}x{height}, over the cap of {cap} pixels")


def decode_png(data: bytes, cap: int = PIXEL_CAP) -> np.ndarray:
    """height x width x 3. 8-bit grey, grey with alpha, RGB, RGBA and palette, not interlaced."""
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
            check_size(head[0], head[1], cap)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("unsupported PNG")
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    except (zlib.error, ValueError) as e:
        raise ValueError(f"broken PNG: {e}") from e
    out = np.zeros((height, width, channels), np.uint8)
    before = np.zeros((width, channels), np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].reshape(width, channels)
        if kind == 0:
            now = line
        elif kind == 1:
            now = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            now = line + before
        else:
            now, left, corner = np.zeros_like(line), np.zeros(channels, np.int32), np.zeros(channels, np.int32)
            for x in range(width):
                up = before[x].astype(np.int32)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                now[x] = (line[x] + guess) & 255
                left, corner = now[x].astype(np.int32), up
        out[y] = before = now
    if head[3] == 3:
        if palette is None:
            raise ValueError("PNG without its palette")
        return palette[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, axis=2) if channels < 3 else out[:, :, :3]


def decode_bmp(data: bytes, cap: int = PIXEL_CAP) -> np.ndarray:
    """Uncompressed, 24 or 32 bits a pixel."""
    try:
        (offset,), (width, height, _, bits, packing) = struct.unpack_from("<I", data, 10), struct.unpack_from("<iiHHI", data, 18)
    except struct.error as e:
        raise ValueError(f"broken BMP: {e}") from e
    check_size(width, abs(height), cap)
    if bits not in (24, 32) or packing not in (0, 3) or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, : width * bits // 8]
    pixels = rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def decode_image(data: bytes, cap: int = PIXEL_CAP) -> np.ndarray:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data, cap)
    if data[:2] == b"BM":
        return decode_bmp(data, cap)
    raise ValueError("no decoder for this image format")


def _weights(n: int, to: int) -> np.ndarray:
    """to x n weights of Catmull-Rom resizing, widened when shrinking."""
    scale = max(n / to, 1.0)
    d = np.abs((np.arange(n)[None, :] + 0.5 - (np.arange(to)[:, None] + 0.5) * n / to) / scale)
    w = np.where(d < 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
    return w / w.sum(axis=1, keepdims=True)


def image_tensor(pixels: np.ndarray, side: int = SIDE) -> np.ndarray:
    """3 x side x side: shortest edge resized to side, centre cropped, normalised."""
    height, width = pixels.shape[:2]
    scale = side / min(height, width)
    h, w = max(side, round(height * scale)), max(side, round(width * scale))
    x = np.tensordot(_weights(height, h), pixels.astype(np.float64), (1, 0))
    x = np.tensordot(_weights(width, w), x, (1, 1)).transpose(1, 0, 2)
    y0, x0 = (h - side) // 2, (w - side) // 2
    x = np.clip(np.rint(x[y0 : y0 + side, x0 : x0 + side]), 0, 255) / 255
    return ((x - MEAN) / DEVIATION).transpose(2, 0, 1).astype(np.float32)


def image_tensors(files: DataFrame, id_col: str = "path", content_col: str = "content", cap: int = PIXEL_CAP) -> DataFrame:
    """``id_col``, tensor (3 x SIDE x SIDE, flat) and error. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tensor = error = None
                try:
                    tensor = image_tensor(decode_image(batch.column(1)[k].as_py() or b"", cap)).ravel()
                except ValueError as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([tensor], pa.list_(pa.float32())), pa.array([error], pa.string())], ["id", "tensor", "error"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(files[id_col].alias("id"), files[content_col].alias("content")).mapInArrow(run, f"id {kind}, tensor array<float>, error string").withColumnRenamed("id", id_col)
