"""Per-image numpy helpers: channel order, target sizes and area means."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The signature of a PNG file, samples per pixel by colour type.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def rgb_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray | None:
    """H x W x 3 RGB from the image source's blue-green-red bytes."""
    if height <= 0 or width <= 0:
        return None
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, 2::-1]


def shares(size_in: int, size_out: int) -> np.ndarray:
    """How much of each input cell lies in each output cell, in whole units.

    Both lines are cut into ``size_in * size_out`` units; a row sums to
    ``size_in``.
    """
    a = np.arange(size_out)[:, None] * size_in
    b = np.arange(size_in)[None, :] * size_out
    overlap = np.minimum(a + size_in, b + size_out) - np.maximum(a, b)
    return np.maximum(overlap, 0)


def area_mean(pixels: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Resize to ``size`` (width, height): each new pixel is the mean of the area it covers."""
    height, width = pixels.shape[:2]
    if (width, height) == size:
        return pixels
    wide, tall = shares(width, size[0]).astype("f8"), shares(height, size[1]).astype("f8")
    # Whole numbers far below 2 ** 53: the float products are exact.
    sums = np.einsum("oy,yxc,px->opc", tall, pixels.astype("f8"), wide, optimize=True)
    area = height * width
    return np.floor((2 * sums + area) / (2 * area)).astype(np.uint8)


def fitted_size(width: int, height: int, limit: tuple[int, int]) -> tuple[int, int]:
    """Size within ``limit`` of the same aspect ratio, halves rounded up; never enlarges."""
    wide, tall = limit
    if width <= wide and height <= tall:
        return width, height
    if width * tall >= height * wide:
        return wide, max(1, (2 * height * wide + width) // (2 * width))
    return max(1, (2 * width * tall + height) // (2 * height)), tall


def shrink_to_fit(pixels: np.ndarray, limit: tuple[int, int]) -> np.ndarray:
    return area_mean(pixels, fitted_size(pixels.shape[1], pixels.shape[0], limit))


def png_pixels(data: bytes) -> np.ndarray | None:
    """Rows by columns by 1, 3 or 4 channels (grey, BGR, BGRA) of a PNG file.

    Eight bits a sample, not interlaced; None for anything else.
    """
    try:
        return _png_pixels(data)
    except (struct.error, zlib.error, ValueError, KeyError, IndexError):
        return None


def _png_pixels(data: bytes) -> np.ndarray | None:
    if data[:8] != PNG_SIGNATURE:
        return None
    at, packed, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
        at += size + 12
    if depth != 8 or interlace:
        return None
    samples = PNG_SAMPLES[colour]
    rows = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(height, 1 + width * samples)
    pixels = _unfiltered(rows, samples).reshape(height, width, samples)
    if colour == 3:
        return palette[pixels[:, :, 0]][:, :, ::-1]
    if colour == 4:
        return pixels[:, :, :1]
    return pixels if samples == 1 else pixels[:, :, [2, 1, 0, 3][:samples]]


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Lines of bytes after undoing each line's filter; ``step`` bytes make a pixel."""
    out = np.zeros((len(rows), rows.shape[1] - 1), dtype=np.uint8)
    above = np.zeros(rows.shape[1] - 1, dtype=np.uint8)
    for line, row in enumerate(rows):
        kind, raw = row[0], row[1:]
        if kind == 0:
            done = raw.copy()
        elif kind == 1:  # the pixel to the left
            done = np.cumsum(raw.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:  # the pixel above
            done = raw + above
        elif kind in (3, 4):
            values, up = raw.tolist(), above.tolist()
            for i in range(len(values)):
                left = values[i - step] if i >= step else 0
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    corner = up[i - step] if i >= step else 0
                    p = left + up[i] - corner
                    guess = min((left, up[i], corner), key=lambda v, p=p: abs(p - v))
                values[i] = (values[i] + guess) & 255
            done = np.array(values, dtype=np.uint8)
        else:
            raise ValueError("no such filter")
        out[line] = above = done
    return out
