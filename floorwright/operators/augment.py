"""Training samples of (image, mask) rows: resized, padded, turned, flipped, cropped and recoloured, the same for the same seed."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from floorwright.functions.taxonomy import IGNORE
from floorwright.kernels import pixels as P

#: White around an image.
PAPER = 255
PAIR = "plan_id long, height int, width int, image binary, mask binary"


@dataclass(frozen=True)
class Augmentation:
    # Side of a sample, range of the scale, chances (first) and ranges of the changes of colour.
    crop: int = 512
    scale: tuple[float, float] = (0.6, 1.4)
    mirrored: float = 0.5
    on_plan: float = 0.8
    light: tuple[float, float, float] = (0.8, 0.25, 25)
    grey: float = 0.3
    tint: tuple[float, float] = (0.3, 15)
    blur: tuple[float, float, float] = (0.2, 0.2, 1.2)
    noise: tuple[float, float, float] = (0.2, 2, 10)


@dataclass(frozen=True)
class View:
    """How a sample looks at an image: sample (y, x) shows the image at turn @ ((y, x) - middle) / zoom + focus."""

    turn: np.ndarray
    zoom: float
    focus: np.ndarray
    middle: np.ndarray

    def seen(self, shape: tuple[int, ...], crop: int, fine: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, inside): what the samples' pixels show, each at fine x fine points: (n, n, 2) and whether that is in the image."""
        at = (np.arange(crop * fine) + 0.5) / fine
        grid = np.stack(np.meshgrid(at, at, indexing="ij"), 2) - self.middle
        places = grid @ self.turn.T / self.zoom + self.focus
        return places, ((places >= 0) & (places < shape[:2])).all(2)


def drawn(r: np.random.Generator, mask: np.ndarray, config: Augmentation) -> View:
    """A view: one of the eight turns and mirrorings, a zoom, and a focus that is mostly a pixel of the plan, put into the
    middle of the sample as far as the image reaches around it; where it doesn't fill the sample it lies anywhere in it."""
    turn = np.linalg.matrix_power(np.array([[0, -1], [1, 0]]), int(r.integers(4))) @ np.diag([1, -1 if r.random() < config.mirrored else 1])
    zoom, shape = r.uniform(*config.scale), np.array(mask.shape)
    plan = np.flatnonzero((mask != 0) & (mask != IGNORE)) if r.random() < config.on_plan else []
    focus = np.array(np.unravel_index(r.choice(plan), mask.shape)) + 0.5 if len(plan) else r.random(2) * shape
    ends = np.sort(np.stack([turn.T @ (end - focus) * zoom for end in (np.zeros(2), shape)]), 0)
    low, high = np.sort(np.stack([-ends[0], config.crop - ends[1]]), 0)  # where the middle has the image or the sample filled
    wide = ends[1] - ends[0] >= config.crop
    return View(turn, zoom, focus, np.where(wide, np.clip(config.crop / 2, low, high), low + r.random(2) * (high - low)))


def _smoothed(x: np.ndarray, inside: np.ndarray, sigma: float) -> np.ndarray:
    """A 3 x 3 Gaussian mean over what is inside; paper around it stays."""
    side = np.exp(-np.array([1, 0, 1]) / (2 * sigma * sigma))
    both = np.concatenate([x, np.ones(x.shape[:2] + (1,))], 2) * inside[:, :, None]
    for axis in (0, 1):
        near = np.pad(both, [(1, 1) if a == axis else (0, 0) for a in range(3)])
        both = sum(w * np.take(near, range(k, k + x.shape[axis]), axis) for k, w in enumerate(side))
    return np.where(inside[:, :, None], both[:, :, :-1] / np.maximum(both[:, :, -1:], 1e-9), x)


#: Changes of colour in the order in which they are tried: the setting, and what it does to colours (random numbers, colours, inside, ranges).
CHANGES: tuple[tuple[str, Callable[..., np.ndarray]], ...] = (
    ("light", lambda r, x, inside, gain, shift: x * (1 + r.uniform(-gain, gain)) + r.uniform(-shift, shift)),
    ("grey", lambda r, x, inside: np.repeat(x.mean(2, keepdims=True), 3, 2)),
    ("tint", lambda r, x, inside, most: x + r.uniform(-most, most, 3)),
    ("blur", lambda r, x, inside, least, most: _smoothed(x, inside, r.uniform(least, most))),
    ("noise", lambda r, x, inside, least, most: x + r.normal(0, r.uniform(least, most), x.shape)),
)


def sample(image: np.ndarray, mask: np.ndarray, seed: int, config: Augmentation = Augmentation()) -> tuple[np.ndarray, np.ndarray]:
    """One sample of (crop, crop) of an image (h, w, 3) and its mask: only what it shows is resampled, through one map.

    A pixel's colour is the mean of four points of the image, linear between its pixels; its label is the one in its middle.
    """
    r = np.random.default_rng(seed)
    view = drawn(r, mask, config)
    middle, inside = view.seen(mask.shape, config.crop, 1)
    at = np.floor(middle[inside]).astype(int)
    labels = np.full((config.crop, config.crop), IGNORE, np.uint8)
    labels[inside] = mask[at[:, 0], at[:, 1]]
    points, _ = view.seen(mask.shape, config.crop, 2)
    points = np.clip(points - 0.5, 0, np.array(mask.shape) - 1)
    base = np.minimum(points.astype(int), np.maximum(np.array(mask.shape) - 2, 0))
    part, colours = points - base, np.zeros((*points.shape[:2], 3))
    for dy in (0, 1):
        for dx in (0, 1):
            weight = np.abs(1 - dy - part[..., 0]) * np.abs(1 - dx - part[..., 1])
            colours += weight[..., None] * image[np.minimum(base[..., 0] + dy, mask.shape[0] - 1), np.minimum(base[..., 1] + dx, mask.shape[1] - 1)]
    colours = colours.reshape(config.crop, 2, config.crop, 2, 3).mean((1, 3))
    x = np.where(inside[:, :, None], colours, PAPER)
    for name, change in CHANGES:
        chance, *ranges = np.atleast_1d(getattr(config, name)).tolist()
        if r.random() < chance:
            x = change(r, x, inside, *ranges)
    return np.clip(x + 0.5, 0, 255).astype(np.uint8), labels


def _pairs(parts: Iterator[pd.DataFrame], change) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        out = []
        for r in pdf.itertuples():
            image, mask = np.frombuffer(r.image, np.uint8).reshape(r.height, r.width, 3), np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width)
            a, b = change(r.plan_id, image, mask)
            out.append((r.plan_id, *b.shape, a.tobytes(), b.tobytes()))
        yield pd.DataFrame(out, columns=["plan_id", "height", "width", "image", "mask"])


def augmented(pairs: DataFrame, epoch: int = 0, seed: int = 0, config: Augmentation = Augmentation()) -> DataFrame:
    """A sample of each pair (plan_id, height, width, image, mask); another epoch gives another one, a run over the same rows the same."""

    def change(plan: int, image: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sample(image, mask, zlib.crc32(f"{seed}/{epoch}/{plan}".encode()), config)

    return pairs.select("plan_id", "height", "width", "image", "mask").mapInPandas(lambda parts: _pairs(parts, change), PAIR)


def resized(pairs: DataFrame, most: int, multiple: int = 1) -> DataFrame:
    """Pairs whose longer side is at most `most`, filled up to a multiple: white paper, ignored labels."""

    def change(plan: int, image: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = P.fitted(*mask.shape, most)
        full = [-(-n // multiple) * multiple for n in size]
        return P.padded(P.resampled(image, *size), *full, PAPER), P.padded(P.nearest(mask, *size), *full, IGNORE)

    return pairs.select("plan_id", "height", "width", "image", "mask").mapInPandas(lambda parts: _pairs(parts, change), PAIR)
