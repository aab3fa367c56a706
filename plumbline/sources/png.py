"""Greyscale PNG images of 8 or 16 bits, as depth and confidence frames are stored: chunks by hand, rows filtered and unfiltered in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def size_of(data: bytes) -> tuple[int, int]:
    """(width, height) from the header alone."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">II", data[16:24])


def decode(data: bytes) -> np.ndarray:
    """The image's values, height x width. Other colour types, interlacing and broken checksums are refused."""
    width, height = size_of(data)
    depth, colour, _, _, interlace = data[24:29]
    if colour != 0 or interlace or depth not in (8, 16):
        raise ValueError(f"only greyscale images of 8 or 16 bits without interlacing are read (colour {colour}, {depth} bits)")
    at, body = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + chunk) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"the checksum of a {kind.decode('latin1')} chunk is wrong")
        if kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
        at += 12 + n
    step = depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out = unfiltered(rows[:, 0], rows[:, 1:], step)
    return out if step == 1 else out.view(">u2").astype(np.uint16)


def unfiltered(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the image from its filtered rows; ``step`` bytes make a pixel."""
    height, width = rows.shape
    out = np.zeros((height + 1, width), np.uint8)
    for r in range(height):
        above, line, kind = out[r], rows[r], kinds[r]
        if kind == 0:
            out[r + 1] = line
        elif kind == 1:  # what is left of it: a running sum of each of the pixel's bytes
            out[r + 1] = np.cumsum(line.reshape(-1, step), 0, np.uint8).ravel()
        elif kind == 2:
            out[r + 1] = line + above
        elif kind in (3, 4):
            up, now = above.tolist(), [0] * step
            up_left = [0] * step + up
            for i, x in enumerate(line.tolist()):
                a, b, c = now[i], up[i], up_left[i]
                if kind == 3:
                    guess = (a + b) >> 1
                else:  # the neighbour that a + b - c is nearest to; left before up before both
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now.append((x + guess) & 255)
            out[r + 1] = now[step:]
        else:
            raise ValueError(f"unknown row filter {kind}")
    return out[1:]


def encode(image: np.ndarray, kinds: tuple[int, ...] = (2,)) -> bytes:
    """A PNG of an unsigned image of 8 or 16 bits. Rows take the given filters (0, 1, 2) in turn."""
    height, width = image.shape
    step = image.dtype.itemsize
    raw = np.ascontiguousarray(image.astype(">u2") if step == 2 else image).view(np.uint8).reshape(height, width * step)
    rows = np.zeros((height, 1 + width * step), np.uint8)
    for r in range(height):
        kind = kinds[r % len(kinds)]
        left = np.concatenate((np.zeros(step, np.uint8), raw[r, :-step]))
        rows[r, 0] = kind
        rows[r, 1:] = raw[r] - (left if kind == 1 else raw[r - 1] if kind == 2 and r else 0)
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8 * step, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
