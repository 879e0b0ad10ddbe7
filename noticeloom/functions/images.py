"""What image files tell: their kind and size by their first bytes, and a hash of their pixels."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeloom.sources.work import ship

SIZE = "kind string, width int, height int"


def image_size(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(kind, width, height) from the head of a PNG, GIF, WebP or JPEG file; nulls for others and for heads that are cut."""
    data, none = data or b"", (None, None, None)
    try:
        if data[1:4] == b"PNG":
            return ("png", *struct.unpack_from(">II", data, 16))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack_from("<HH", data, 6))
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            form = data[12:16]
            if form == b"VP8 ":
                return ("webp", *(side & 0x3FFF for side in struct.unpack_from("<HH", data, 26)))
            if form == b"VP8L":  # two sizes of 14 bits, less one
                bits = int.from_bytes(data[21:25], "little") if len(data) >= 25 else None
                return none if bits is None else ("webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
            if form == b"VP8X" and len(data) >= 30:  # two sizes of three bytes, less one
                return "webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
            return none
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a frame, neither tables nor coding conditions
                    height, width = struct.unpack_from(">HH", data, at + 5)
                    return "jpeg", width, height
                if size < 2:
                    return none
                at += 2 + size
    except struct.error:
        pass
    return none


def probed(data: Column) -> Column:
    """struct(kind, width, height) of files' heads; the first half megabyte is enough."""
    @F.pandas_udf(SIZE)
    def sizes(heads: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame(list(map(image_size, heads)), columns=["kind", "width", "height"])
        return found.astype({"width": "Int32", "height": "Int32"})

    return sizes(F.substring(data, 1, 512 * 1024))


#: Pixels of an image that is hashed, at most; cells of a hash's side.
MOST_PIXELS, GRID = 50_000_000, 8
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: bytes, rows: int, width: int, step: int) -> np.ndarray:
    """A PNG's rows of bytes without their filters; step: bytes of a pixel, one at least."""
    data = np.frombuffer(raw, np.uint8, rows * (width + 1)).reshape(rows, width + 1)
    out = np.zeros((rows, width), np.uint8)
    above = np.zeros(width, np.uint8)
    for y in range(rows):
        kind, line = data[y, 0], data[y, 1:]
        if kind == 2:
            line = line + above
        elif kind == 1:  # each byte adds the one a pixel before: sums along the pixels
            padded = np.zeros(-(-width // step) * step, np.uint8)
            padded[:width] = line
            line = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:width]
        elif kind in (3, 4):
            done, up = bytearray(line.tobytes()), above.tobytes()
            for i in range(width):
                left, upper = done[i - step] if i >= step else 0, up[i]
                if kind == 3:
                    add = (left + upper) // 2
                else:
                    corner = up[i - step] if i >= step else 0
                    a, b, c = abs(upper - corner), abs(left - corner), abs(left + upper - 2 * corner)
                    add = left if a <= b and a <= c else upper if b <= c else corner
                done[i] = (done[i] + add) & 255
            line = np.frombuffer(bytes(done), np.uint8)
        elif kind:
            raise ValueError("filter")
        out[y] = above = line
    return out


def png_grays(data: bytes | None) -> np.ndarray | None:
    """The gray values, 0 to 255, of a PNG that isn't interlaced, transparency left out of account; None for other files, for broken
    ones and for more than MOST_PIXELS pixels."""
    if not data or data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    try:
        at, packed, palette, head = 8, [], None, None
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            body = data[at + 8:at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                packed.append(body)
            at += size + 12
        width, height, depth, color, _, _, interlaced = head
        channels = _CHANNELS[color]
        if interlaced or not width or not height or width * height > MOST_PIXELS:
            return None
        line = (width * channels * depth + 7) // 8
        raw = zlib.decompressobj().decompress(b"".join(packed), height * (line + 1))
        rows = _unfiltered(raw, height, line, max(1, channels * depth // 8))
        if depth == 16:
            rows = rows[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
            rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2, dtype=np.uint8)
            rows = rows if color == 3 else rows * np.uint8(255 // (2**depth - 1))
        pixels = rows[:, :width * channels].reshape(height, width, channels)
        if color == 3:
            pixels = palette[pixels[:, :, 0]]
        if pixels.shape[2] < 3:
            return pixels[:, :, 0].astype(np.float64)
        return pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])
    except (struct.error, zlib.error, ValueError, KeyError, TypeError, IndexError):
        return None


def average_hash(data: bytes | None) -> str | None:
    """16 hex digits: of the 8 by 8 parts of an image, row by row, whether a part's mean is over the mean of all parts."""
    grays = png_grays(data)
    if grays is None:
        return None

    def weights(n):  # of each pixel in each part; parts may begin within a pixel
        edges, pixels = np.arange(GRID + 1) * n / GRID, np.arange(n)
        return np.clip(np.minimum(edges[1:, None], pixels + 1) - np.maximum(edges[:-1, None], pixels), 0, 1) * GRID / n

    means = weights(grays.shape[0]) @ grays @ weights(grays.shape[1]).T
    return np.packbits((means > means.mean() + 1e-9).ravel()).tobytes().hex()


def average_hashes(data: Column) -> Column:
    """average_hash of files' bytes."""
    ship()

    @F.pandas_udf("string")
    def hashed(files: pd.Series) -> pd.Series:
        return files.map(average_hash)

    return hashed(data)
