"""Resampling and padding of one image or label raster, in numpy."""

from __future__ import annotations

import numpy as np


def weights(source: int, target: int) -> np.ndarray:
    """(target, source): each target pixel as a mean of source pixels, by covered length where it shrinks, linear where it grows."""
    if target >= source:
        at = np.clip((np.arange(target) + 0.5) * source / target - 0.5, 0, source - 1)
        away = np.abs(at[:, None] - np.arange(source))
        return np.maximum(0.0, 1 - away)
    edges = np.arange(target + 1) * source / target
    low, high = edges[:-1, None], edges[1:, None]
    covered = np.clip(np.minimum(high, np.arange(1, source + 1)) - np.maximum(low, np.arange(source)), 0, None)
    return covered / covered.sum(1, keepdims=True)


def resampled(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image (h, w, channels) of bytes in another size."""
    rows = np.tensordot(weights(image.shape[0], height), image.astype(np.float64), (1, 0))
    both = np.tensordot(weights(image.shape[1], width), rows, (1, 1)).swapaxes(0, 1)
    return np.clip(both + 0.5, 0, 255).astype(np.uint8)


def nearest(labels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Labels in another size: pixel (y, x) takes floor((y, x) * source / target)."""
    y, x = (np.arange(n) * m // n for n, m in zip((height, width), labels.shape, strict=True))
    return labels[np.ix_(y, x)]


def fitted(height: int, width: int, most: int) -> tuple[int, int]:
    """The size after shrinking so that the longer side is at most `most`; never larger than before, 1 px at least."""
    s = min(1.0, most / max(height, width))
    return max(1, round(height * s)), max(1, round(width * s))


def padded(a: np.ndarray, height: int, width: int, value: int) -> np.ndarray:
    """The raster filled up at its lower and right side."""
    more = [(0, max(0, n - m)) for n, m in zip((height, width), a.shape, strict=False)] + [(0, 0)] * (a.ndim - 2)
    return np.pad(a, more, constant_values=value)
