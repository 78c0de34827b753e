"""Pixel arithmetic: 8-bit resampling as numpy helpers, normalisation also as a column function."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The image model's channel means and deviations.
MEAN = (0.48145466, 0.4578275, 0.40821073)
STD = (0.26862954, 0.26130258, 0.27577711)

# Fixed values of the 8-bit resampler: cubic coefficient, reach in pixels, fraction bits.
CUBIC = -0.5
REACH = 2.0
FRACTION_BITS = 22

OUTPUTS = 8  # output pixels of an axis worked on at a time


def normalize_pixels(pixels: Column, channels: int) -> Column:
    """Row-major interleaved bytes (array<int>) to normalised red, green and blue planes."""
    points = F.floor(F.size(pixels) / channels).cast("int")

    def plane(c: int) -> Column:
        return F.transform(
            F.sequence(F.lit(0), points - 1),
            lambda i: (F.element_at(pixels, i * channels + c + 1) / F.lit(255.0) - F.lit(MEAN[c])) / F.lit(STD[c]),
        )

    return F.concat(plane(0), plane(1), plane(2))


def target_size(height: int, width: int, size: int) -> tuple[int, int]:
    """(height, width) with the shorter side at `size` and the shape kept."""
    if width <= height:
        return int(size * height / width), size
    return size, int(size * width / height)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    near = ((CUBIC + 2.0) * x - (CUBIC + 3.0)) * x * x + 1.0
    far = (((x - 5.0) * x + 8.0) * x - 4.0) * CUBIC
    return np.where(x < 1.0, near, np.where(x < 2.0, far, 0.0))


@lru_cache(maxsize=256)
def axis_taps(n_in: int, n_out: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(first input pixel, whole-number weights) of the output pixels from `first` on.

    The reach grows with the reduction, so a smaller image is a weighted mean of what it covers. Each output
    has about four times the reduction in weights, so a table of 224 outputs of a 4,000 pixel side takes
    0.1 MB, and the tables that are kept some 25 MB.
    """
    scale = n_in / n_out
    stretch = max(scale, 1.0)
    center = (np.arange(first, first + count) + 0.5) * scale
    low = np.maximum((center - REACH * stretch + 0.5).astype(int), 0)
    high = np.minimum((center + REACH * stretch + 0.5).astype(int), n_in)
    at = low[:, None] + np.arange((high - low).max())
    weights = np.where(at < high[:, None], _cubic((at - center[:, None] + 0.5) / stretch), 0.0)
    weights /= weights.sum(axis=1, keepdims=True)
    return low, np.trunc(weights * (1 << FRACTION_BITS) + np.where(weights < 0, -0.5, 0.5))


def _apply(low: np.ndarray, weights: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """Weighted sums along the first axis, rounded and clipped to bytes. Exact: all sums stay whole.

    Goes through a few outputs at a time, which need a few of the input pixels each.
    """
    n, taps = weights.shape
    out = np.empty((n, *pixels.shape[1:]), np.uint8)
    for start in range(0, n, OUTPUTS):
        rows = slice(start, min(n, start + OUTPUTS))
        begin = low[rows][0]
        band = np.zeros((rows.stop - start, low[rows][-1] - begin + taps))
        at = (low[rows] - begin)[:, None] + np.arange(taps)
        np.put_along_axis(band, at, weights[rows], axis=1)
        part = pixels[begin : begin + band.shape[1]]
        flat = part.reshape(part.shape[0], -1).astype(np.float64)
        sums = band[:, : part.shape[0]] @ flat + float(1 << (FRACTION_BITS - 1))
        out[rows] = np.clip(np.floor(sums / (1 << FRACTION_BITS)), 0, 255).astype(np.uint8).reshape(-1, *pixels.shape[1:])
    return out


def _premultiply(rgba: np.ndarray) -> np.ndarray:
    product = rgba[..., :3].astype(np.int64) * rgba[..., 3:].astype(np.int64) + 128
    rgb = ((product >> 8) + product) >> 8
    return np.concatenate([rgb.astype(np.uint8), rgba[..., 3:]], axis=-1)


def _unpremultiply(rgba: np.ndarray) -> np.ndarray:
    alpha = rgba[..., 3:].astype(np.int64)
    rgb = rgba[..., :3].astype(np.int64)
    spread = np.minimum(255 * rgb // np.maximum(alpha, 1), 255)
    rgb = np.where((alpha == 0) | (alpha == 255), rgb, spread)
    return np.concatenate([rgb.astype(np.uint8), rgba[..., 3:]], axis=-1)


def resize_and_crop(pixels: np.ndarray, size: int) -> np.ndarray:
    """Shorter side to `size`, then the middle `size` × `size`; only those pixels are computed."""
    height, width = pixels.shape[:2]
    new_h, new_w = target_size(height, width, size)
    top, left = round((new_h - size) / 2.0), round((new_w - size) / 2.0)
    if (new_h, new_w) == (height, width):
        return pixels[top : top + size, left : left + size]
    alpha = pixels.shape[2] == 4
    if alpha:
        pixels = _premultiply(pixels)
    low, weights = axis_taps(height, new_h, top, size)
    needed = pixels[low[0] : low[-1] + weights.shape[1]]
    across = _apply(*axis_taps(width, new_w, left, size), needed.transpose(1, 0, 2)).transpose(1, 0, 2)
    pixels = _apply(low - low[0], weights, across)
    return _unpremultiply(pixels) if alpha else pixels


def to_planes(pixels: np.ndarray) -> np.ndarray:
    """Bytes (h, w, c) to normalised float planes (3, h, w)."""
    rgb = np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels[..., :3]
    scaled = rgb.astype(np.float32) / np.float32(255)
    return np.ascontiguousarray(((scaled - np.float32(MEAN)) / np.float32(STD)).transpose(2, 0, 1))


def from_planes(planes: np.ndarray) -> np.ndarray:
    """Normalised planes back to bytes (h, w, 3), clipped to the byte range."""
    scaled = planes.transpose(1, 2, 0).astype(np.float32) * np.float32(STD) + np.float32(MEAN)
    return (np.clip(scaled, 0, 1) * np.float32(255)).astype(np.uint8)
