"""Width and height from the first 32 bytes of PNG and WebP files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_BYTES = 32


def _number(h: Column, byte: int, n: int, big: bool) -> Column:
    """Unsigned integer of n bytes from the given byte on; h is hexadecimal."""
    parts = [F.substring(h, 2 * (byte + i) + 1, 2) for i in (range(n) if big else reversed(range(n)))]
    return F.conv(F.concat(*parts), 16, 10).cast("bigint")


def image_dims(content: Column) -> Column:
    """struct<width, height>, or null where the header has none."""
    h = F.hex(F.substring(content, 1, HEADER_BYTES))
    size = F.length(h) / 2

    def dims(width: Column, height: Column) -> Column:
        return F.struct(width.alias("width"), height.alias("height"))

    webp = h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250")
    form = F.substring(h, 25, 8)
    packed = _number(h, 21, 4, False)
    low14 = F.lit(0x3FFF).cast("bigint")
    return (
        F.when((size >= 24) & h.startswith("89504E47") & (form == "49484452"), dims(_number(h, 16, 4, True), _number(h, 20, 4, True)))
        .when((size >= 30) & webp & (form == "56503858"), dims(_number(h, 24, 3, False) + 1, _number(h, 27, 3, False) + 1))
        .when((size >= 30) & webp & (form == "56503820"), dims(_number(h, 26, 2, False).bitwiseAND(low14), _number(h, 28, 2, False).bitwiseAND(low14)))
        .when((size >= 30) & webp & (form == "5650384C"), dims(packed.bitwiseAND(low14) + 1, F.shiftright(packed, 14).bitwiseAND(low14) + 1))
    )


def over_pixel_cap(width: Column, height: Column, cap: int) -> Column:
    """An error text where an image is too large to be decoded, else null."""
    return F.when(width * height > cap, F.concat_ws("", F.lit("image is "), width, F.lit("x"), height, F.lit(f", over the cap of {cap} pixels")))
