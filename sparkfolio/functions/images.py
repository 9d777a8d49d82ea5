"""Format and size of images from the first bytes of their files. PNG, GIF and WebP are read by column functions; a JPEG's segments are walked in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Fixed values of the format: markers without a length, and frame headers (not DHT, JPG and DAC).
JPEG_BARE = {0x01, *range(0xD0, 0xD8)}
JPEG_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
JPEG_ENDS = {0xD9, 0xDA}


def jpeg_size(content: bytes) -> list[int] | None:
    """Width and height of the first frame header; None if the data end, or the image begins, before there is one."""
    at, end = 2, len(content)
    while at + 1 < end and content[at] == 0xFF:
        marker = content[at + 1]
        if marker == 0xFF:  # filler
            at += 1
        elif marker in JPEG_BARE:
            at += 2
        elif marker in JPEG_ENDS or at + 9 > end:
            return None
        elif marker in JPEG_FRAMES:
            return [int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")]
        else:
            at += 2 + max(2, int.from_bytes(content[at + 2 : at + 4], "big"))
    return None


@F.pandas_udf(ArrayType(IntegerType()))
def _jpeg_sizes(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else jpeg_size(bytes(c)))


def image_header(content: Column) -> Column:
    """struct<format, width, height> of binary data. An unknown format gives null; a file cut off before its size, or with a size of zero, has a format and no size."""
    byte = lambda at: F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("long")
    little = lambda at, n: sum((byte(at + i) * (1 << 8 * i) for i in range(1, n)), byte(at))
    big = lambda at, n: sum((byte(at + i) * (1 << 8 * (n - 1 - i)) for i in range(n - 1)), byte(at + n - 1))
    begins = lambda at, text: F.hex(F.substring(content, at + 1, len(text))) == text.hex().upper()
    bits = lambda value, first, n: F.shiftright(value, first).bitwiseAND((1 << n) - 1)
    reaches = lambda n: F.length(content) >= n

    png, jpeg = begins(0, b"\x89PNG\r\n\x1a\n"), begins(0, b"\xff\xd8\xff")
    gif = begins(0, b"GIF87a") | begins(0, b"GIF89a")
    webp = begins(0, b"RIFF") & begins(8, b"WEBP")
    size = lambda width, height: F.array(width.cast("int"), height.cast("int"))
    lossless = little(21, 4)
    found = (
        F.when(png & begins(12, b"IHDR") & reaches(24), size(big(16, 4), big(20, 4)))
        .when(gif & reaches(10), size(little(6, 2), little(8, 2)))
        .when(webp & begins(12, b"VP8 ") & begins(23, b"\x9d\x01\x2a") & reaches(30), size(bits(little(26, 2), 0, 14), bits(little(28, 2), 0, 14)))
        .when(webp & begins(12, b"VP8L") & begins(20, b"\x2f") & reaches(25), size(bits(lossless, 0, 14) + 1, bits(lossless, 14, 14) + 1))
        .when(webp & begins(12, b"VP8X") & reaches(30), size(little(24, 3) + 1, little(27, 3) + 1))
        .when(jpeg, _jpeg_sizes(F.when(jpeg, content)))
    )
    kind = F.when(png, "png").when(jpeg, "jpeg").when(gif, "gif").when(webp, "webp")
    whole = F.when((found[0] > 0) & (found[1] > 0), found)
    return F.when(kind.isNotNull(), F.struct(kind.alias("format"), whole[0].alias("width"), whole[1].alias("height")))
