"""Greyscale images as array columns (row by row, with their width): thumbnails by area, sharpness, and how far a view has moved.

Work is numpy on Arrow batches, an image at a time. A null image or one whose length isn't a multiple of its width gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area_weights(n: int, m: int) -> np.ndarray:
    """(m, n): how much of each of n samples falls into each of m cells of the same whole width; rows sum to one."""
    edges = np.arange(m + 1) * (n / m)
    lo, hi = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
    return np.maximum(hi - lo, 0) * (m / n)


def reduced(image: np.ndarray, side: int) -> np.ndarray:
    """The image averaged by area so that its longer side has ``side`` pixels; a smaller one stays as it is."""
    h, w = image.shape
    if max(h, w) <= side:
        return image.astype(float)
    k = side / max(h, w)
    return area_weights(h, max(1, round(h * k))) @ image @ area_weights(w, max(1, round(w * k))).T


def laplacian_variance(image: np.ndarray) -> float:
    """The population variance of the four neighbours' sum less four times the pixel; the border mirrors its inner neighbour."""
    if min(image.shape) < 2:
        return 0.0
    p = np.pad(image.astype(float), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def shift_between(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, response) by phase correlation of the images under a Hann window: the centroid of the correlation's peak and what
    lies in it, 1 for equal images."""
    h, w = a.shape
    window = np.hanning(h)[:, None] * np.hanning(w)[None, :] if min(h, w) > 2 else 1.0
    cross = np.fft.fft2(b * window) * np.conj(np.fft.fft2(a * window))
    size = np.abs(cross)
    corr = np.fft.fftshift(np.real(np.fft.ifft2(cross / np.where(size > 1e-12, size, 1.0))))
    y, x = np.unravel_index(int(np.argmax(corr)), corr.shape)
    ys, xs = slice(max(0, y - 2), y + 3), slice(max(0, x - 2), x + 3)
    part = np.maximum(corr[ys, xs], 0)
    total = part.sum()
    if total <= 0:
        return 0.0, 0.0, 0.0
    gy, gx = np.mgrid[ys, xs][:, : part.shape[0], : part.shape[1]]
    return float((gx * part).sum() / total - w // 2), float((gy * part).sum() / total - h // 2), float(total)


def _image(values: pa.Scalar, width: pa.Scalar) -> np.ndarray | None:
    if not values.is_valid or not width.is_valid or width.as_py() < 1 or len(values) % width.as_py() or not len(values):
        return None
    return values.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width.as_py())


def sharpness(image: str | Column, width: str | Column, side: int = 480) -> Column:
    """The Laplacian variance of the image reduced to ``side``."""

    @F.arrow_udf("double")
    def f(images: pa.Array, widths: pa.Array) -> pa.Array:
        shown = (_image(i, w) for i, w in zip(images, widths, strict=True))
        return pa.array([None if x is None else laplacian_variance(reduced(x, side)) for x in shown], pa.float64())

    return f(image, width)


def thumbnail(image: str | Column, width: str | Column, side: int = 160) -> Column:
    """struct(w, pixels): the image reduced to ``side``."""

    @F.arrow_udf("struct<w:int,pixels:array<float>>")
    def f(images: pa.Array, widths: pa.Array) -> pa.Array:
        out = []
        for i, w in zip(images, widths, strict=True):
            x = _image(i, w)
            small = None if x is None else reduced(x, side)
            out.append(None if small is None else {"w": small.shape[1], "pixels": small.ravel().astype(np.float32)})
        return pa.array(out, pa.struct([("w", pa.int32()), ("pixels", pa.list_(pa.float32()))]))

    return f(image, width)


def motion(frames: DataFrame, key: str, frame: str, image: str, width: str, *, side: int = 160, least_response: float = 0.05) -> DataFrame:
    """key, frame, sharpness, shift: of each frame, and how far the view moved since the frame before as a share of the longer side (0 for the first, 1 where
    the views don't match). A capture's frames pass a task in order, of which it holds one thumbnail."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = None, None
        for b in batches:
            sharp, moved = [], []
            for k, i, w in zip(b.column("_k"), b.column("_i"), b.column("_w"), strict=True):
                x = _image(i, w)
                small = None if x is None else reduced(x, side)
                if k.as_py() != now:
                    now, before = k.as_py(), None
                if small is None or before is None:
                    shift = 0.0
                elif before.shape != small.shape:
                    shift = 1.0
                else:
                    dx, dy, response = shift_between(before, small)
                    shift = float(np.hypot(dx, dy)) / max(small.shape) if response > least_response else 1.0
                before = before if small is None else small
                sharp.append(None if x is None else laplacian_variance(reduced(x, 480)))
                moved.append(shift)
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_f"), pa.array(sharp, pa.float64()), pa.array(moved, pa.float64())], [key, frame, "sharpness", "shift"])

    d = frames.select(F.col(key).alias("_k"), F.col(frame).alias("_f"), F.col(image).alias("_i"), F.col(width).alias("_w"))
    return d.repartition("_k").sortWithinPartitions("_k", "_f").mapInArrow(run, f"`{key}` {kinds[key]}, `{frame}` {kinds[frame]}, sharpness double, shift double")
