"""Main text of pages by a recurrent block labeller: a bidirectional LSTM over each page's leaf blocks, in numpy.

A block is read as a vector of hashed features: the tags on its path with their class and id words, the words of its
text (hashed, averaged), and its length, link share and place. A forward and a backward LSTM carry what stands before and
after it in the page, and a logistic output labels every block as article or not. The teacher of the fit is what markup
says outright (elements and class names of menus, footers, adverts, forms, comments and of articles); many
training pages are rewritten, with neutral tags or other names for one side, so that words, lengths and neighbours count,
or have groups of blocks put in under such names, so that all of these are known. The fit reads a bounded sample of pages; extraction covers every block of every page.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.common import bounded, in_one_task, lean, table, tidy
from floorwright.llm.html_blocks import Block, Node, blocks, chain
from floorwright.llm.text import steps

#: Names that say outright what a block belongs to.
OUTSIDE = frozenset("nav menu navbar navigation breadcrumb breadcrumbs header masthead banner footer foot copyright aside sidebar side widget ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay subscribe newsletter signup form search login share sharing social related recommended comment comments reply replies respond disqus pagination pager toolbar complementary contentinfo button fieldset select textarea dialog".split())
INSIDE = frozenset("article main post entry content story body-text articlebody postbody".split())
_NEUTRAL = frozenset("html body div section p span h1 h2 h3 h4 h5 h6 ul ol li table tbody tr td th blockquote pre b i em strong dl dt dd figure figcaption".split())


@dataclass(frozen=True)
class LabellerConfig:
    buckets: int = 4096
    width: int = 24
    hidden: int = 24
    #: Pages that the fit uses at most, chosen by a hash, and blocks of each at most that one step reads.
    pages: int = 600
    blocks: int = 120
    epochs: int = 10
    batch: int = 32
    rate: float = 0.01
    seed: int = 11


@dataclass
class Labeller:
    config: LabellerConfig
    weights: dict[str, np.ndarray]


@lru_cache(maxsize=1 << 17)
def _bucket(kind: str, word: str, buckets: int) -> int:
    return zlib.crc32(f"{kind}:{word}".encode()) % buckets


class _Words(dict):
    """Buckets of words; each is hashed when it first comes. Beyond so many it starts anew."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 17:
            self.clear()
        found = self[word] = zlib.crc32(f"w:{word}".encode()) % self.buckets
        return found


_words_in = lru_cache(maxsize=4)(_Words)


def features(own: list[Block], config: LabellerConfig) -> tuple[list[Node | None], list[list[int]], np.ndarray]:
    """For each block its path, its word buckets and its numbers."""
    words, numbers, known = [], np.zeros((len(own), 6), np.float32), _words_in(config.buckets)
    for k, b in enumerate(own):
        text = b.text.lower().split()
        words.append([known[w] for w in text])
        numbers[k] = (np.log1p(len(b.text)), np.log1p(len(text)), b.links / max(1, len(b.text)), k / len(own), 1 - k / len(own), b.text[-1] in ".!?\"'")
    return [b.node for b in own], words, numbers


def _path_buckets(b: Block, buckets: int) -> list[int]:
    return [_bucket("t", w, buckets) for w in b.words] or [_bucket("t", "", buckets)]


def _path_means(vectors: np.ndarray, nodes: list[Node | None]) -> np.ndarray:
    """The mean vector of each path's distinct words; a node adds its own to the sum of the path above, once for all its blocks."""
    buckets, out = len(vectors), np.empty((len(nodes), vectors.shape[1]), np.float32)
    sums: dict[int, tuple[np.ndarray, int]] = {}
    none = (np.zeros(vectors.shape[1], np.float32), 0)
    for k, node in enumerate(nodes):
        new, at = [], node
        while at is not None and id(at) not in sums:
            new.append(at)
            at = at.parent
        total, n = sums[id(at)] if at is not None else none
        for at in reversed(new):
            for w in at.words:
                total, n = total + vectors[_bucket("t", w, buckets)], n + 1
            sums[id(at)] = (total, n)
        out[k] = total / n if n else vectors[_bucket("t", "", buckets)]
    return out


def _mean(vectors: np.ndarray, ids: list[list[int]]) -> np.ndarray:
    """The mean vector of each list of buckets."""
    sizes = np.array([len(x) for x in ids])
    flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(sizes.sum()))
    out = np.zeros((len(ids), vectors.shape[1]), np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        out[full] = np.add.reduceat(vectors[flat], starts) / sizes[full][:, None]
    return out


def _initial(config: LabellerConfig) -> dict[str, np.ndarray]:
    r = np.random.default_rng(config.seed)
    d, h = 2 * config.width + 6, config.hidden
    make = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"emb": (r.standard_normal((config.buckets, config.width)) * 0.3).astype(np.float32), "out": make(2 * h + d, 1)[:, 0], "bias": np.zeros(1, np.float32)}
    for side in "fb":
        w |= {f"{side}x": make(d, 4 * h), f"{side}h": make(h, 4 * h), f"{side}c": np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)}
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, c0: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of x (steps, pages, features); a page's state stays as it is where its mask is 0."""
    t, p, _ = x.shape
    hid = wh.shape[0]
    h, c = np.zeros((p, hid), np.float32), np.zeros((p, hid), np.float32)
    pre = x.reshape(t * p, -1) @ wx + c0
    pre = pre.reshape(t, p, -1)
    out = np.empty((t, p, hid), np.float32)
    for k in range(t):
        g = pre[k] + h @ wh
        i, f, o, z = _sigmoid(g[:, :hid]), _sigmoid(g[:, hid : 2 * hid]), _sigmoid(g[:, 2 * hid : 3 * hid]), np.tanh(g[:, 3 * hid :])
        m = mask[k][:, None]
        new = f * c + i * z
        tc = np.tanh(new)
        if keep is not None:
            keep.append((h, c, i, f, o, z, tc, m))
        c = np.where(m, new, c)
        h = np.where(m, o * tc, h)
        out[k] = h
    return out


def _lstm_back(x: np.ndarray, dout: np.ndarray, keep: list, wx: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t, p, _ = x.shape
    hid = wh.shape[0]
    dh, dc = np.zeros((p, hid), np.float32), np.zeros((p, hid), np.float32)
    dpre = np.zeros((t, p, 4 * hid), np.float32)
    dwh = np.zeros_like(wh)
    for k in range(t - 1, -1, -1):
        h, c, i, f, o, z, tc, m = keep[k]
        dh = dh + dout[k]
        mdh = dh * m
        dnew = dc * m + mdh * o * (1 - tc * tc)
        dpre[k] = np.concatenate([dnew * z * i * (1 - i), dnew * c * f * (1 - f), mdh * tc * o * (1 - o), dnew * i * (1 - z * z)], 1)
        dwh += h.T @ dpre[k]
        dc = dc * (1 - m) + dnew * f
        dh = dh * (1 - m) + dpre[k] @ wh.T
    flat = dpre.reshape(t * p, -1)
    return (flat @ wx.T).reshape(x.shape), x.reshape(t * p, -1).T @ flat, dwh, flat.sum(0)


def _laid_out(feats: list[tuple], width: int, emb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, features) and its mask, from the pages' features."""
    t, p = max(len(f[0]) for f in feats), len(feats)
    x, mask = np.zeros((t, p, 2 * width + 6), np.float32), np.zeros((t, p), bool)
    paths, words = _path_means(emb, [i for f in feats for i in f[0]]), _mean(emb, [i for f in feats for i in f[1]])
    at = 0
    for k, f in enumerate(feats):
        n = len(f[0])
        x[:n, k] = np.concatenate([paths[at : at + n], words[at : at + n], f[2]], 1)
        mask[:n, k] = True
        at += n
    return x, mask


def _forward(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
    f = _lstm(x, mask, w["fx"], w["fh"], w["fc"], keep and keep[0])
    b = _lstm(x[::-1], mask[::-1], w["bx"], w["bh"], w["bc"], keep and keep[1])[::-1]
    top = np.concatenate([f, b, x], 2)
    return top, _sigmoid(top @ w["out"] + w["bias"])


def teacher(b: Block) -> int | None:
    """What markup says outright: 1 article, 0 not; None if it says nothing."""
    found = None
    for name in b.path:
        own = set(name.split("."))
        if own & OUTSIDE:
            return 0
        if own & INSIDE:
            found = 1
    return found


def _rewritten(own: list[Block], y: list[int], r: np.random.Generator) -> list[Block]:
    """The page with neutral tags for one of its sides, or with another name that says the same."""
    side, kind = r.integers(2), r.integers(3)
    other = sorted(OUTSIDE if side == 0 else INSIDE)
    name = "div" if kind == 0 else f"div.{other[r.integers(len(other))]}" if kind == 1 else f"section.c{r.integers(1000)}"
    out = []
    head = ("h1", "h2", "h3", "h4")[r.integers(4)]
    for b, v in zip(own, y, strict=True):
        if v:
            b = Block(b.text, chain(tuple(head if n == "h1" else n for n in b.path)), b.links)
        if v != side:
            out.append(b)
            continue
        path = [n if n in _NEUTRAL else name for n in b.path]
        out.append(Block(b.text, chain(tuple(path)), b.links))
    return out


def _added(own: list[Block], y: list[int], pool: list[str], r: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page with groups of blocks put in that their names alone show to be outside the article, wherever they stand."""
    own, y = list(own), list(y)
    names = sorted(OUTSIDE)
    for _ in range(1 + r.integers(4)):
        name = names[r.integers(len(names))]
        name = (name, f"div.{name}", f"section.{name}", f"div.c{r.integers(1000)}.{name}")[r.integers(4)]
        at = int(r.integers(len(own) + 1))
        inside = own[at - 1].path if at and y[at - 1] else own[at].path if at < len(own) and y[at] else ("html", "body")
        for _ in range(1 + r.integers(3)):
            text = pool[r.integers(len(pool))]
            if r.random() < 0.5:
                text = " ".join(text.split()[: 2 + r.integers(12)])
            path = (*inside[: 2 + r.integers(2)], name, *((("p", "h1", "h2", "h3", "li", "span")[r.integers(6)],) if r.random() < 0.6 else ()))
            own.insert(at, Block(text, chain(path), len(text) if r.random() < 0.3 else 0))
            y.insert(at, 0)
    return own, y


def fit(pages: list[str], config: LabellerConfig = LabellerConfig()) -> Labeller:
    """A labeller fitted on whole pages; one that never met a block that markup speaks for takes every block as text."""
    r = np.random.default_rng(config.seed)
    w = _initial(config)
    data = []
    for page in pages:
        own = blocks(page)
        y = [teacher(b) for b in own]
        known = [(b, v) for b, v in zip(own, y, strict=True) if v is not None]
        for i in range(0, len(known), config.blocks):
            data.append(known[i : i + config.blocks])
    if not data:
        return Labeller(config, w | {"out": np.zeros_like(w["out"]), "bias": np.ones_like(w["bias"])})
    pool = [b.text for own in data for b, _ in own]
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for _ in range(config.epochs):
        order = r.permutation(len(data))
        for s in range(0, len(order), config.batch):
            feats, lists, ys = [], [], []
            for i in order[s : s + config.batch]:
                own, y = [b for b, _ in data[i]], [k for _, k in data[i]]
                kind = r.random()
                if kind < 0.3 or kind > 0.9:
                    own = _rewritten(own, y, r)
                if kind > 0.6:
                    own, y = _added(own, y, pool, r)
                feats.append(features(own, config))
                lists.append(([_path_buckets(b, config.buckets) for b in own], feats[-1][1]))
                ys.append(y)
            x, mask = _laid_out(feats, config.width, w["emb"])
            target = np.zeros(mask.shape, np.float32)
            for k, y in enumerate(ys):
                target[: len(y), k] = y
            keep: tuple[list, list] = ([], [])
            top, p = _forward(w, x, mask, keep)
            d = (p - target) * mask / mask.sum()
            h = config.hidden
            dtop = d[:, :, None] * w["out"]
            g = {"out": np.tensordot(d, top, ([0, 1], [0, 1])), "bias": np.array([d.sum()])}
            dx = dtop[:, :, 2 * h :].copy()
            for side, rev, lo in (("f", 1, 0), ("b", -1, h)):
                dxs, g[f"{side}x"], g[f"{side}h"], g[f"{side}c"] = _lstm_back(x[::rev], dtop[::rev, :, lo : lo + h], keep[0 if side == "f" else 1], w[f"{side}x"], w[f"{side}h"])
                dx += dxs[::rev]
            demb = np.zeros_like(w["emb"])
            for k, f in enumerate(lists):
                for which, lo in ((0, 0), (1, config.width)):
                    sizes = [len(i) for i in f[which]]
                    flat = np.fromiter(itertools.chain.from_iterable(f[which]), np.int64, sum(sizes))
                    share = dx[: len(sizes), k, lo : lo + config.width] / np.maximum(1, np.array(sizes))[:, None]
                    np.add.at(demb, flat, np.repeat(share, sizes, 0))
            g["emb"] = demb
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            for k in w:  # Adam with clipped gradients
                q = g[k].astype(np.float32) * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                w[k] = w[k] - config.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Labeller(config, w)


def label(model: Labeller, pages: list[list[Block]], most: int = 20_000) -> list[np.ndarray]:
    """For each page the probability of each of its blocks; pages of like length are read together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((k for k, own in enumerate(pages) if own), key=lambda k: len(pages[k]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * len(pages[order[j]]) <= most and j - i < 512:
            j += 1
        x, mask = _laid_out([features(pages[k], model.config) for k in order[i:j]], model.config.width, model.weights["emb"])
        p = _forward(model.weights, x, mask)[1]
        for c, k in enumerate(order[i:j]):
            out[k] = p[: len(pages[k]), c]
        i = j
    return out


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages; null and empty html give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in steps(batches, "html"):
            own = [blocks(t.decode()) for t in raw]
            texts = [" ".join(x.text for x, p in zip(page, probs, strict=True) if p >= 0.5) for page, probs in zip(own, label(model, own), strict=True)]
            yield b.select(["page_id", "url"]).append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))

    lean(pages.sparkSession)
    own = pages.select("page_id", "url", "html")
    return own.mapInArrow(tidy(run), own.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)


def fit_from_table(pages: DataFrame, config: LabellerConfig = LabellerConfig()) -> Labeller:
    """Fits in one task on at most config.pages whole rows, chosen by a hash of page_id and html; repeated rows count once, null html is passed over."""
    rows = bounded(pages.where("html is not null"), F.xxhash64("page_id", "html"), config.pages)

    def make(ids: list, texts: list[str]) -> Labeller:
        return fit([t for _, t in sorted(zip(ids, texts, strict=True), key=lambda x: (zlib.crc32(str(x[0]).encode()), x[1]))], config)

    return in_one_task(rows.select("page_id", "html"), make) or fit([], config)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit_from_table(pages))
