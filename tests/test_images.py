"""Hashes of pixels against a plain reading of generated images."""

import random
import struct
import zlib

import pytest

from noticeloom.functions import images

R = random.Random(2)


def _filtered(lines, step, kinds):
    """A PNG's rows with these filters."""
    out, above = b"", bytes(len(lines[0]))
    for line, kind in zip(lines, kinds):
        def guess(i):
            left, up, corner = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = left + up - corner
            paeth = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            return (0, left, up, (left + up) // 2, paeth)[kind]
        out += bytes([kind, *((line[i] - guess(i)) % 256 for i in range(len(line)))])
        above = line
    return out


def _png(width, height, depth, color, lines, kinds, extra=b""):
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color] * depth // 8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    packed = zlib.compress(_filtered(lines, step, kinds))
    cut = len(packed) // 2
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + extra + chunk(b"IDAT", packed[:cut]) + chunk(b"IDAT", packed[cut:]) + chunk(b"IEND", b"")


def _hash(gray, width, height):
    """By eighths of pixels: every pixel is cut into 8 by 8 equal pieces."""
    cells = [[0.0] * 8 for _ in range(8)]
    for y in range(8 * height):
        for x in range(8 * width):
            cells[y // height][x // width] += gray[y // 8][x // 8]
    flat = [c for row in cells for c in row]
    return f"{int(''.join('1' if c > sum(flat) / 64 + 1e-6 else '0' for c in flat), 2):016x}"


@pytest.mark.parametrize("width,height", [(8, 8), (16, 24), (13, 5), (1, 1), (37, 20)])
@pytest.mark.parametrize("color", [0, 2, 4, 6])
def test_hashes_of_generated_images(width, height, color):
    r = random.Random(width * height + color)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[color]
    pixels = [[[r.randrange(256) for _ in range(channels)] for _ in range(width)] for _ in range(height)]
    gray = [[p[0] if channels < 3 else 0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2] for p in row] for row in pixels]
    data = _png(width, height, 8, color, [bytes(v for p in row for v in p) for row in pixels], [r.randrange(5) for _ in range(height)])
    assert images.average_hash(data) == _hash(gray, width, height)


def test_depths_and_palettes():
    r = random.Random(1)
    for depth in (1, 2, 4):
        values = [[r.randrange(2**depth) for _ in range(11)] for _ in range(9)]
        packed = [int("".join(f"{v:0{depth}b}" for v in row).ljust((11 * depth + 7) // 8 * 8, "0"), 2).to_bytes((11 * depth + 7) // 8, "big") for row in values]
        assert images.png_grays(_png(11, 9, depth, 0, packed, [1] * 9)).tolist() == [[v * (255 // (2**depth - 1)) for v in row] for row in values]
    wide = [bytes(v for x in row for v in (x, 7)) for row in [[1, 2, 3], [4, 5, 6]]]
    assert images.png_grays(_png(3, 2, 16, 0, wide, [2, 4])).tolist() == [[1, 2, 3], [4, 5, 6]]
    colors = struct.pack(">I4s", 6, b"PLTE") + bytes([10, 10, 10, 200, 200, 200]) + b"\0\0\0\0"
    assert [round(v) for v in images.png_grays(_png(2, 1, 8, 3, [bytes([1, 0])], [0], colors))[0]] == [200, 10]


def test_what_is_no_image():
    whole = _png(8, 8, 8, 0, [bytes(8)] * 8, [0] * 8)
    for data in (None, b"", b"\x89PNG\r\n\x1a\n", whole[:40], _png(8, 8, 8, 0, [R.randbytes(8) for _ in range(8)], [0] * 8)[:60], b"GIF89a", whole[:28] + b"\x01" + whole[29:]):
        assert images.average_hash(data) is None
    assert images.average_hash(whole) == "0" * 16
