"""Tiled scoring: tile starts, Gaussian windows, blending, test-time flips and pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorwright.kernels import pixels

Scorer = Callable[[np.ndarray], np.ndarray]
#: Named scorers: a factory for each, called once in every Python worker.
SCORERS: dict[str, Callable[[], Scorer]] = {}
# Channel means and deviations that images are normalised with.
MEAN, STD = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)


def register(name: str, factory: Callable[[], Scorer]) -> None:
    SCORERS[name] = factory


def scorer(name: str) -> Callable[[], Scorer]:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; there are {sorted(SCORERS)}")
    return SCORERS[name]


def onnx_scorer(path: str) -> Callable[[], Scorer]:
    """A factory for an ONNX model file: logits (n, classes, h, w) of images (n, 3, h, w)."""

    def make() -> Scorer:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x.astype(np.float32)})[0]

    return make


def tile_starts(length: Column, tile: int, overlap: float = 0.25) -> Column:
    """Starts of tiles that cover a side: every stride, and one that ends at the side's end."""
    stride = max(1, int(tile * (1 - overlap)))
    some = F.filter(F.sequence(F.lit(0), F.greatest(length - tile, F.lit(0)), F.lit(stride)), lambda s: s < length - tile)
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(F.array_append(some, (length - tile).cast("int")))


def tiles(plans: DataFrame, tile: int, overlap: float = 0.25) -> DataFrame:
    """(plan_id, ty, tx) of plans (plan_id, height, width)."""
    rows = plans.select("plan_id", "width", F.explode(tile_starts(F.col("height"), tile, overlap)).alias("ty"))
    return rows.select("plan_id", "ty", F.explode(tile_starts(F.col("width"), tile, overlap)).alias("tx"))


def _bell(at, tile: int):
    """Minus the exponent of a tile's weight at a place along one side; at: a column or an array."""
    off = at - (tile - 1) / 2.0
    return off * off / (2.0 * (tile / 4.0) ** 2)


def gaussian(at: Column, tile: int) -> Column:
    """Weight of a place in a tile along one side, 1 in the middle (before the floor of 1e-3 on the product)."""
    return F.exp(-_bell(at, tile))


def blend(scored: DataFrame, tile: int) -> DataFrame:
    """(plan_id, y, x, class_id, p): scored (plan_id, ty, tx, dy, dx, class_id, p) weighted and joined over all tiles."""
    peak = float(np.exp(-((0.5 / (0.25 * tile)) ** 2))) if tile % 2 == 0 else 1.0
    w = F.greatest(gaussian(F.col("dy"), tile) * gaussian(F.col("dx"), tile) / peak, F.lit(1e-3))
    own = scored.select("plan_id", (F.col("ty") + F.col("dy")).alias("y"), (F.col("tx") + F.col("dx")).alias("x"), "class_id", "p", w.alias("w"))
    return own.groupBy("plan_id", "y", "x", "class_id").agg((F.sum(F.col("p") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("p"))


#: Views of images (n, 3, h, w) that a score is averaged over, each with what turns its result back; the last for squares only.
VIEWS = [
    (lambda x: x, lambda p: p),
    (lambda x: np.flip(x, 3), lambda p: np.flip(p, 3)),
    (lambda x: np.flip(x, 2), lambda p: np.flip(p, 2)),
    (lambda x: np.flip(np.swapaxes(x, 2, 3), 2), lambda p: np.swapaxes(np.flip(p, 2), 2, 3)),
]


def shares(logits: np.ndarray) -> np.ndarray:
    """Logits (n, classes, h, w) as probabilities of the classes."""
    above = np.logaddexp.reduce(logits, axis=1)
    return np.exp(logits - above[:, None])


def over_views(score: Scorer, x: np.ndarray, tta: bool) -> np.ndarray:
    """Probabilities of images, averaged over the views that apply."""
    views = VIEWS[: 1 if not tta else 4 if x.shape[2] == x.shape[3] else 3]
    total = sum(back(shares(score(np.ascontiguousarray(view(x))))) for view, back in views)
    return total / len(views)


def normalised(image: np.ndarray) -> np.ndarray:
    """(h, w, 3) bytes to (3, h, w) floats."""
    return ((image.astype(np.float32) / 255 - MEAN) / STD).transpose(2, 0, 1)


def denormalised(x: np.ndarray) -> np.ndarray:
    return np.clip((x.transpose(1, 2, 0) * STD + MEAN) * 255 + 0.5, 0, 255).astype(np.uint8)


def window(tile: int) -> np.ndarray:
    """The weights of a whole tile: what gaussian() gives for both sides, 1 at the most, never below 1e-3."""
    side = _bell(np.arange(tile), tile)
    both = side[:, None] + side
    return np.exp(np.maximum(both.min() - both, np.log(1e-3))).astype(np.float32)


def starts(length: int, tile: int, overlap: float = 0.25) -> list[int]:
    """tile_starts() of a number: every stride, those beyond the last that fits moved back to it."""
    every = np.arange(0, length, max(1, int(tile * (1 - overlap))))
    return np.unique(every.clip(max=max(0, length - tile))).tolist()


def laid_out(image: np.ndarray, tile: int) -> np.ndarray:
    """An image (h, w, 3) on white paper of whole multiples of 32, a tile at least: a network always sees a whole tile."""
    size = [max(tile, -(-n // 32) * 32) for n in image.shape[:2]]
    return pixels.padded(image, *size, 255)


def scored_tiles(image: np.ndarray, score: Scorer, tile: int, overlap: float, batch: int, tta: bool) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, column, probabilities) of the tiles of a laid-out image, scored so many at a time."""
    windows = np.lib.stride_tricks.sliding_window_view(normalised(image), (tile, tile), (1, 2))
    rows, columns = (np.array(starts(n, tile, overlap)) for n in image.shape[:2])
    at = np.stack(np.meshgrid(rows, columns, indexing="ij"), 2).reshape(-1, 2)
    for own in np.array_split(at, range(batch, len(at), batch)):
        found = over_views(score, windows[:, own[:, 0], own[:, 1]].swapaxes(0, 1), tta)
        yield from ((int(r), int(c), p) for (r, c), p in zip(own, found, strict=True))


def probabilities(image: np.ndarray, score: Scorer, tile: int = 512, overlap: float = 0.25, batch: int = 4, tta: bool = False) -> np.ndarray:
    """(classes, h, w) of an image (h, w, 3): the mean over its tiles, weighted by their windows."""
    paper, weight, sums = laid_out(image, tile), window(tile), None
    for r, c, p in scored_tiles(paper, score, tile, overlap, batch, tta):
        own = np.concatenate([p, np.ones_like(p[:1])]) * weight  # the last layer sums the weights
        sums = np.zeros((len(own), *paper.shape[:2]), np.float32) if sums is None else sums
        sums[:, r : r + tile, c : c + tile] += own
    h, w = image.shape[:2]
    return (sums[:-1] / np.maximum(sums[-1], 1e-6))[:, :h, :w]


def predict(images: DataFrame, make: Callable[[], Scorer], tile: int = 512, overlap: float = 0.25, tta: bool = False, max_side: int = 2048) -> DataFrame:
    """(plan_id, height, width, data, confidence) of images (plan_id, height, width, data): labels as bytes, row by row.

    An image whose longer side is over max_side is scored in that size, and its labels are brought back to full size.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for pdf in parts:
            out = []
            for r in pdf.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                size = pixels.fitted(r.height, r.width, max_side)
                own = image if size == (r.height, r.width) else pixels.resampled(image, *size)
                p = probabilities(own, score, tile, overlap, tta=tta)
                labels = pixels.nearest(p.argmax(0).astype(np.uint8), r.height, r.width)
                out.append((r.plan_id, r.height, r.width, labels.tobytes(), float(p.max(0).mean())))
            yield pd.DataFrame(out, columns=["plan_id", "height", "width", "data", "confidence"])

    return images.select("plan_id", "height", "width", "data").mapInPandas(run, "plan_id long, height int, width int, data binary, confidence double")
