"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, whole-text scores.

Vocabulary. Counts of all training tokens are made on the executors. The `hot` most frequent words stand in classes of
neighbouring rank; a token's probability is that of its class, given the state, times that of the word in the class,
given the state. All other words stand in classes by their first two bytes; there the word's share is its smoothed count
within its class, and a word that training never had is one more of count 0, so every distribution sums to one. The end
of a text is a hot word.

Fit. Class and word biases are the counts' logarithms, over all training tokens. The recurrent weights are fitted by
truncated backpropagation, windows of a few steps with the state carried on, in shards of the training texts on the
executors; each round ends in the average of the shards' weights. The rounds share out all training texts, each is read
once; the number of shards grows with the tokens, each holds about `shard_tokens`.

Scores. Whole texts run as lanes side by side, window after window, the state carried across windows and reset where a
text begins. Counts of rare words come from a join on the word's 64-bit hash, so no table of words is held whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.common import lean, table, tidy, tidy_group, written
from floorwright.llm.text import STEP, steps, word_hashes_and_heads

#: Rows of states for which probabilities are computed at once: what they need stays in the processor's cache.
_ROWS = 512
#: First bits of a hash by which held words are looked up.
_BITS = 18
#: The hash that stands for the end of a text.
END = np.uint64(0x5BD1E995CAFEF00D)


@dataclass(frozen=True)
class LanguageModelConfig:
    hot: int = 1024
    per_class: int = 32
    heads: int = 32
    #: Words whose counts every worker holds; those of the rest are joined.
    held: int = 65536
    width: int = 16
    window: int = 16
    lanes: int = 512
    rate: float = 0.04
    #: Added to the root of the squared gradients: holds back weights of which a shard tells little.
    damping: float = 1e-5
    #: Steps over which each shard's rate rises.
    warm: int = 10
    rounds: int = 2
    shard_tokens: int = 500_000
    #: crc32(doc_id as text) modulo folds that is held out.
    folds: int = 7
    held_out: int = 2
    seed: int = 3


def held_out(config: LanguageModelConfig) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % config.folds == config.held_out, F.lit(False))


def _tokens(texts: list[bytes], config: LanguageModelConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, head classes, offsets) of all tokens; every text ends in an end token."""
    h, at, heads = word_hashes_and_heads(texts)
    n = len(texts)
    ends = at[1:] + np.arange(n)
    hashes, classes = np.empty(len(h) + n, np.uint64), np.zeros(len(h) + n, np.int16)
    is_word = np.ones(len(h) + n, bool)
    is_word[ends] = False
    hashes[is_word], hashes[ends] = h, END
    classes[is_word] = (heads * 40503 >> 4) % config.heads
    return hashes, classes, np.concatenate(([0], ends + 1))


def word_counts(docs: DataFrame, config: LanguageModelConfig) -> DataFrame:
    """(h, head, n) over the tokens of all texts; counted within each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, c, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, at = np.unique(h, return_index=True, return_inverse=True)
            return u, c[first], np.bincount(at, weights=n, minlength=len(u)).astype(np.int64)

        def out() -> pa.RecordBatch:
            u, c, n = held[0]
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], ["h", "head", "n"])

        for _, texts in steps(batches):
            h, c, _ = _tokens(texts, config)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, c[first], n))
            if sum(len(x[0]) for x in held) > 1_500_000:
                held[:] = [merged()]
                if len(held[0][0]) > 750_000:
                    yield out()
                    held.clear()
        if held:
            held[:] = [merged()]
            yield out()

    return docs.select("text").mapInArrow(tidy(run), "h long, head int, n long").groupBy("h").agg(F.first("head").alias("head"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every worker holds: bounded by config.held words."""

    hashes: np.ndarray  # sorted
    ids: np.ndarray  # hot id, or hot + head class
    share: np.ndarray  # log10 of the word's share in its head class; 0 for hot words
    base: np.ndarray  # log10 of (c + 1) / (N + V + 1)
    head_total: np.ndarray  # log10 of N_k + V_k + 1 for each head class
    total: float  # log10 of N + V + 1
    hot_counts: np.ndarray
    head_counts: np.ndarray
    tokens: int

    @property
    def hot(self) -> int:
        return len(self.hot_counts)


def vocabulary(counts: DataFrame, config: LanguageModelConfig) -> Vocabulary:
    """Totals over all counts, and the config.held most frequent words (of equal counts the least hash)."""
    level = F.floor(F.log2("n") * 8)
    by = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level)
    least, have = 0, 0
    for r in by:
        least, have = r.level, have + r.words
        if have >= config.held:
            break
    top = counts.where(level >= least).orderBy(F.desc("n"), "h").limit(config.held).toArrow()
    h, head, n = (top.column(c).to_numpy() for c in ("h", "head", "n"))
    order = np.lexsort((h, -n))
    h, head, n = h[order].view(np.uint64), head[order], n[order]
    hot = min(config.hot, len(h))
    cut = int(n[hot - 1]) if hot else 0
    tot = {r.head: r for r in counts.groupBy("head").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    all_n, all_v = sum(r.n for r in tot.values()), sum(r.v for r in tot.values())
    head_n = np.array([tot[k].n if k in tot else 0 for k in range(config.heads)], np.float64)
    head_v = np.array([tot[k].v if k in tot else 0 for k in range(config.heads)], np.float64)
    np.subtract.at(head_n, head[:hot], n[:hot])
    np.subtract.at(head_v, head[:hot], 1)
    del cut
    total = math.log10(all_n + all_v + 1)
    head_total = np.log10(head_n + head_v + 1)
    ids = np.where(np.arange(len(h)) < hot, np.arange(len(h)), hot + head)
    share = np.where(np.arange(len(h)) < hot, 0.0, np.log10(n + 1) - head_total[head])
    by_hash = np.argsort(h)
    return Vocabulary(h[by_hash], ids[by_hash].astype(np.int32), share[by_hash], (np.log10(n + 1) - total)[by_hash], head_total, total, n[:hot].astype(np.float64), head_n + 1, all_n)


def _tanh(x: np.ndarray) -> None:
    """tanh in place, by the exponential, which numpy has in vector form; where that overflows, the tanh is 1."""
    x *= 2
    np.exp(x, out=x)
    x += 1
    np.divide(-2, x, out=x)
    x += 1


def _order(keys: np.ndarray, below: int) -> np.ndarray:
    """Places of the keys (from 0, below a number) in their order, equal ones as they stand; short numbers are sorted by digits."""
    return np.argsort(keys.astype(np.uint16) if below <= 1 << 16 else keys, kind="stable")


def _shifted(weights: np.ndarray, bias: np.ndarray) -> np.ndarray | None:
    """bias less a bound of the logits, so that their exponentials neither overflow nor all vanish, whatever the state (its
    parts are within -1 and 1); None if the bounds are too far apart, and each row needs its own maximum.

    weights: (..., width, places), bias: (..., places).
    """
    spread = np.abs(weights).sum(-2)
    most = (bias + spread).max(-1, keepdims=True)
    if not (most - (bias - spread).max(-1, keepdims=True) < 60).all():
        return None
    return bias - most


def _exp(x: np.ndarray, bias: np.ndarray, bounded: bool) -> np.ndarray:
    """The exponentials of x + bias in place, up to a factor for each row."""
    x += bias
    if not bounded:
        x -= x.max(1, keepdims=True)
    return np.exp(x, out=x)


class Network:
    """Gated recurrent network with a class-factored softmax. ids below hot are words; from hot on, head classes."""

    def __init__(self, vocab: Vocabulary, config: LanguageModelConfig, weights: dict[str, np.ndarray] | None = None):
        self.config, self.hot = config, vocab.hot
        self.word_classes = -(-max(1, vocab.hot) // config.per_class)
        self.classes = self.word_classes + config.heads
        self.inputs = vocab.hot + config.heads
        self.weights = weights or self._initial(vocab)

    def _initial(self, vocab: Vocabulary) -> dict[str, np.ndarray]:
        r, h, p = np.random.default_rng(self.config.seed), self.config.width, self.config.per_class
        make = lambda *shape, by=1.0: (r.standard_normal(shape) * by).astype(np.float32)
        counts = np.zeros(self.word_classes * p)
        counts[: self.hot] = vocab.hot_counts
        per = counts.reshape(-1, p)
        word = np.full(per.shape, -1e9, np.float32)  # places without a word have no probability
        word[per > 0] = np.log(per[per > 0])
        return {
            "emb": make(self.inputs, h, by=0.3), "wx": make(h, 3 * h, by=h**-0.5), "wh": make(h, 3 * h, by=h**-0.5), "b": np.zeros(3 * h, np.float32),
            "cw": make(h, self.classes, by=0.1), "cb": np.log(np.maximum(np.concatenate([per.sum(1), vocab.head_counts]), 0.5)).astype(np.float32),
            "ww": make(self.word_classes, h, p, by=0.1), "wb": word,
        }

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids < self.hot, ids // self.config.per_class, self.word_classes + ids - self.hot)

    def run(self, pre: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (steps, lanes, width) from the inputs' gate sums; h is set to 0 where a text begins."""
        w, n = self.weights["wh"], self.config.width
        out = np.empty((*pre.shape[:2], n), np.float32)
        turns, less = fresh.any(1), -pre[:, :, : 2 * n]
        with np.errstate(over="ignore"):
            for t in range(len(pre)):
                if turns[t]:
                    h = h * ~fresh[t][:, None]
                hw = h @ w
                g = less[t] - hw[:, : 2 * n]
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                z, r = g[:, :n], g[:, n:]
                c = r * hw[:, 2 * n :]
                c += pre[t][:, 2 * n :]
                _tanh(c)
                if keep is not None:
                    keep.append((h, hw[:, 2 * n :], z, r, c))
                h = np.subtract(h, c, out=out[t])
                h *= z
                h += c
        return out

    def log_probs(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Natural log of P(class) and, for hot words, of P(word | class), for each row of states."""
        w, out = self.weights, np.empty(len(ids))
        cls, rows = self.class_of(ids), np.arange(_ROWS)
        shifted, inner = _shifted(w["cw"], w["cb"]), _shifted(w["ww"], w["wb"])
        bias, ones = w["cb"] if shifted is None else shifted, np.ones(self.classes, np.float32)
        for i in range(0, len(ids), _ROWS):
            x = states[i : i + _ROWS] @ w["cw"]
            x += bias
            if shifted is None:
                x -= x.max(1, keepdims=True)
            own = x[rows[: len(x)], cls[i : i + _ROWS]]
            out[i : i + _ROWS] = own - np.log(np.exp(x, out=x) @ ones)
        order = _order(cls, self.classes)
        ends = np.searchsorted(cls[order], np.arange(self.word_classes + 1))
        sorted_, place = states[order], (ids - cls * self.config.per_class)[order]
        bias, ones, found = w["wb"] if inner is None else inner, np.ones(self.config.per_class, np.float32), np.empty(int(ends[-1]))
        for k in range(self.word_classes):
            for a in range(ends[k], ends[k + 1], _ROWS):
                b = min(a + _ROWS, ends[k + 1])
                x = sorted_[a:b] @ w["ww"][k]
                x += bias[k]
                if inner is None:
                    x -= x.max(1, keepdims=True)
                own = x[rows[: b - a], place[a:b]]
                found[a:b] = own - np.log(np.exp(x, out=x) @ ones)
        out[order[: len(found)]] += found
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, used: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of one window by truncated backpropagation, and the state after it."""
        w, n, p = self.weights, self.config.width, self.config.per_class
        x = w["emb"][inputs]
        keep: list = []
        states = self.run(x @ w["wx"] + w["b"], fresh, h, keep)
        flat, ids, mask = states.reshape(-1, n), targets.ravel(), used.ravel()
        cls = self.class_of(ids)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        share = (mask / np.float32(mask.sum()))[:, None]
        ds = np.empty_like(flat)
        shifted, inner = _shifted(w["cw"], w["cb"]), _shifted(w["ww"], w["wb"])
        bias, ones = w["cb"] if shifted is None else shifted, np.ones((self.classes, 1), np.float32)
        for i in range(0, len(ids), _ROWS):
            own = slice(i, i + _ROWS)
            y = _exp(flat[own] @ w["cw"], bias, shifted is not None)
            y *= share[own] / (y @ ones)
            y[np.arange(len(y)), cls[own]] -= share[own, 0]
            g["cw"] += flat[own].T @ y
            g["cb"] += y.sum(0)
            np.matmul(y, w["cw"].T, out=ds[own])
        at = np.flatnonzero(cls < self.word_classes)
        at = at[_order(cls[at], self.classes)]
        if len(at):  # rows in the order of their class; the softmax of all at once
            own, rows = cls[at], flat[at]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            spans = list(zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True))
            q, back = np.empty((len(at), p), np.float32), np.empty((len(at), n), np.float32)
            for k, a, b in spans:
                np.matmul(rows[a:b], w["ww"][k], out=q[a:b])
            _exp(q, (w["wb"] if inner is None else inner)[own], inner is not None)
            q *= share[at] / (q @ np.ones((p, 1), np.float32))
            q[np.arange(len(at)), ids[at] - own * p] -= share[at, 0]
            g["wb"][own[first]] = np.add.reduceat(q, first)
            for k, a, b in spans:
                np.matmul(rows[a:b].T, q[a:b], out=g["ww"][k])
                np.matmul(q[a:b], w["ww"][k].T, out=back[a:b])
            ds[at] += back
        ds, turns = ds.reshape(states.shape), fresh.any(1)
        dh, dpre = np.zeros_like(h), np.empty((*inputs.shape, 3 * n), np.float32)
        back = np.ascontiguousarray(w["wh"].T)
        dhw = np.empty((len(h), 3 * n), np.float32)
        for t in range(len(inputs) - 1, -1, -1):
            before, hc, z, r, c = keep[t]
            dh += ds[t]
            own, rest = dpre[t], 1 - z
            dc = np.multiply(dh, rest, out=own[:, 2 * n :])
            dc *= 1 - c * c
            dz = np.multiply(dh, before - c, out=dhw[:, :n])
            rest *= z
            dz *= rest
            np.multiply(dc, r, out=dhw[:, 2 * n :])
            dr = np.multiply(dhw[:, 2 * n :], hc, out=dhw[:, n : 2 * n])
            dr *= 1 - r
            own[:, : 2 * n] = dhw[:, : 2 * n]
            g["wh"] += before.T @ dhw
            dh *= z
            dh += dhw @ back
            if turns[t]:
                dh *= ~fresh[t][:, None]
        fd = dpre.reshape(-1, 3 * n)
        g["wx"], g["b"] = x.reshape(-1, n).T @ fd, fd.sum(0)
        order = _order(inputs.ravel(), self.inputs)  # rows of an input side by side, summed at once
        own = inputs.ravel()[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        g["emb"][own[first]] = np.add.reduceat((fd @ w["wx"].T)[order], first)
        return g, states[-1]


def laid_out(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts dealt into lanes, the longest first, each to the shortest lane; lanes by length, the longest first."""
    heap = [(0, k) for k in range(min(lanes, max(1, len(lengths))))]
    own: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n, k = heap[0]
        own[k].append(i)
        heapq.heapreplace(heap, (n + int(lengths[i]), k))
    return sorted(own, key=lambda x: -int(lengths[x].sum()))


class Lanes:
    """Texts side by side in lanes, read window by window; memory is in proportion to the tokens, however uneven the lanes.

    most: texts of more tokens are dealt out in runs of so many (in training, so that all lanes end at about the same time).
    """

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, lanes: int, first: int, most: int | None = None):
        begins = offsets[:-1]
        if most:
            offsets = np.unique(np.concatenate([offsets, *[np.arange(a, b, most) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b - a > most]]))
        own = laid_out(np.diff(offsets), lanes)
        self.count = len(own)
        self.sizes = np.array([int((offsets[np.array(x, np.int64) + 1] - offsets[x]).sum()) if x else 0 for x in own])
        order = np.array([i for x in own for i in x], np.int64)
        lengths = offsets[order + 1] - offsets[order]
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.places = within + np.repeat(offsets[order], lengths)  # lane after lane
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)
        self.ids, self.first = ids, first
        self.fresh, self.new = np.zeros(len(ids) + 1, bool), np.zeros(len(ids) + 1, bool)
        self.fresh[offsets[:-1]] = True
        self.new[begins] = True

    @property
    def steps(self) -> int:
        return int(self.sizes.max(initial=0))

    def window(self, t: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets, fresh, places) of the steps from t on, for the lanes still alive at t; places are -1 beyond a lane's end."""
        live = int((self.sizes > t).sum())  # lanes are in order of length
        step = t + np.arange(min(size, self.steps - t))[:, None]
        there = step < self.sizes[None, :live]
        at = self.places[np.where(there, self.starts[None, :live] + step, 0)]
        inputs = np.where(self.new[at], self.first, self.ids[np.maximum(at - 1, 0)])
        return inputs, self.ids[at], self.fresh[at] & there, np.where(there, at, -1)


def _ids(hashes: np.ndarray, heads: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, index into the held words or -1)."""
    last = np.cumsum(np.bincount((vocab.hashes >> np.uint64(64 - _BITS)).astype(np.int64), minlength=1 << _BITS)).astype(np.int32)
    first = np.append(np.int32(0), last[:-1])
    at, there = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    left = np.arange(len(hashes))
    own = (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
    now, ends = first[own], last[own]
    while True:  # words with the same first bits, one after the other
        more = now < ends
        left, now, ends = left[more], now[more], ends[more]
        if not len(left):
            break
        hit = vocab.hashes[now] == hashes[left]
        at[left[hit]], there[left[hit]] = now[hit], True
        miss = ~hit
        left, now, ends = left[miss], now[miss] + 1, ends[miss]
    return np.where(there, vocab.ids[at] if len(vocab.ids) else 0, vocab.hot + heads).astype(np.int32), np.where(there, at, -1)


def _pack(weights: dict[str, np.ndarray]) -> bytes:
    return b"".join(weights[k].astype(np.float32).tobytes() for k in sorted(weights))


def _unpack(data: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = data[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train_shard(texts: list[bytes], vocab: Vocabulary, config: LanguageModelConfig, weights: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], int]:
    """Weights after one pass over the texts, and how many tokens it had."""
    hashes, heads, offsets = _tokens(texts, config)
    ids, _ = _ids(hashes, heads, vocab)
    end = int(_ids(np.array([END]), np.zeros(1, np.int64), vocab)[0][0])
    lanes = min(config.lanes, max(8, len(ids) // (100 * config.window)))  # a shard of few tokens takes about 100 steps all the same
    laid = Lanes(ids, offsets, lanes, end, max(config.window, len(ids) // lanes // 4))
    net = Network(vocab, config, {k: v.copy() for k, v in weights.items()})
    w = net.weights
    m, v, spare = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(3))
    h = np.zeros((laid.count, config.width), np.float32)
    spans = range(0, laid.steps, config.window)
    for step, t in enumerate(spans, 1):
        inputs, targets, fresh, at = laid.window(t, config.window)
        g, h = net.gradients(inputs, targets, fresh, at >= 0, h[: at.shape[1]])
        norm = math.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        rate = config.rate * min(1.0, step / config.warm) * (1 - 0.9 * step / len(spans))
        for k in w:  # Adam with clipped gradients
            q, x = g[k].astype(np.float32, copy=False), spare[k]
            q *= np.float32(min(1.0, 1.0 / (norm + 1e-9)))
            m[k] *= np.float32(0.9)
            v[k] *= np.float32(0.99)
            m[k] += np.multiply(q, np.float32(0.1), out=x)
            v[k] += np.multiply(np.multiply(q, q, out=x), np.float32(0.01), out=x)
            np.sqrt(np.divide(v[k], np.float32(1 - 0.99**step), out=x), out=x)
            x += np.float32(config.damping)
            np.divide(m[k], x, out=x)
            w[k] -= np.multiply(x, np.float32(rate / (1 - 0.9**step)), out=x)
    return w, len(ids)


def fit(docs: DataFrame, vocab: Vocabulary, config: LanguageModelConfig) -> dict[str, np.ndarray]:
    """Weights from rounds of shards on the executors, averaged in two levels, by tokens. Each text is in one shard of one round."""
    shards = max(1, math.ceil(vocab.tokens / config.rounds / config.shard_tokens))
    weights = Network(vocab, config).weights
    sizes = sum(x.size for x in weights.values())
    docs = docs.select("text", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("h"))  # repeated rows are dealt out too
    dealt = lambda seed, n: F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(n)).cast("int")
    for turn in range(config.rounds):
        now = weights
        part = docs.where(dealt(config.seed, config.rounds) == turn).select(dealt(config.seed + 1, shards).alias("shard"), "text")

        def learn(t: pa.Table) -> pa.Table:
            w, n = train_shard([x.encode() for x in t.column("text").to_pylist() if x], vocab, config, now)
            return pa.table({"part": pa.array([t.column("shard")[0].as_py() % max(1, math.isqrt(shards))], pa.int32()), "tokens": pa.array([n], pa.int64()), "weights": pa.array([_pack(w)], pa.binary())})

        def average(t: pa.Table) -> pa.Table:
            n, total = t.column("tokens").to_pylist(), np.zeros(sizes)
            for k, x in zip(n, t.column("weights"), strict=True):
                total += k * np.frombuffer(x.as_buffer(), np.float32)
            return pa.table({"part": pa.array([0], pa.int32()), "tokens": pa.array([sum(n)], pa.int64()), "weights": pa.array([(total / max(1, sum(n))).astype(np.float32).tobytes()], pa.binary())})

        kind = "part int, tokens long, weights binary"
        found = part.groupBy("shard").applyInArrow(tidy_group(learn), kind).groupBy("part").applyInArrow(average, kind).groupBy(F.col("part") * 0).applyInArrow(average, kind).collect()
        if found:
            weights = _unpack(np.frombuffer(found[0].weights, np.float32), weights)
    return weights


def score_texts(texts: list[bytes], vocab: Vocabulary, config: LanguageModelConfig, weights: dict[str, np.ndarray], lanes: int = 256, window: int = 64) -> dict[str, list | np.ndarray]:
    """For each text: tokens, sums over held words, and the hashes of the rest."""
    hashes, heads, offsets = _tokens(texts, config)
    ids, held = _ids(hashes, heads, vocab)
    end = int(_ids(np.array([END]), np.zeros(1, np.int64), vocab)[0][0])
    laid = Lanes(ids, offsets, lanes, end)
    net = Network(vocab, config, weights)
    gates = weights["emb"] @ weights["wx"] + weights["b"]
    h = np.zeros((laid.count, config.width), np.float32)
    logp = np.empty(len(ids))
    for t in range(0, laid.steps, window):
        inputs, targets, fresh, at = laid.window(t, window)
        states = net.run(gates[inputs], fresh, h[: at.shape[1]])
        h, used = states[-1], at >= 0
        logp[at[used]] = net.log_probs(states[used], targets[used])
    known = held >= 0
    share = np.where(known, vocab.share[np.maximum(held, 0)], -vocab.head_total[heads]) if len(vocab.share) else -vocab.head_total[heads]
    base = np.where(known, vocab.base[np.maximum(held, 0)], -vocab.total) if len(vocab.base) else np.full(len(ids), -vocab.total)
    add = lambda x: np.add.reduceat(x, offsets[:-1]) if len(texts) else np.zeros(0)
    rest = np.flatnonzero(~known)
    cuts = np.searchsorted(rest, offsets)
    return {"n_tokens": np.diff(offsets), "held": add(known.astype(np.int64)), "base": add(base), "score": add(logp / math.log(10) + share), "rest": [hashes[rest[a:b]].view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]}


def score_documents(docs: DataFrame, config: LanguageModelConfig = LanguageModelConfig()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Learns from the rows that aren't held out; a null doc_id counts as not held out. Null and empty texts are one end
    token. Scores are log10 probabilities of whole texts, the end included.
    """
    lean(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    train = own.where(~held_out(config))
    counts = written(word_counts(train, config), "counts")
    vocab = vocabulary(counts, config)
    weights = fit(train, vocab, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in steps(batches, most=4 * STEP):
            r = score_texts(texts, vocab, config, weights)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(r[k]) for k in ("n_tokens", "held", "base", "score")], pa.array(r["rest"], pa.list_(pa.int64()))], ["doc_id", "n_tokens", "held", "base", "score", "rest"])

    parts = own.mapInArrow(tidy(run), "doc_id long, n_tokens long, held long, base double, score double, rest array<long>")
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "parts")  # the id is written with the row
    rare = parts.select("row", F.explode("rest").alias("h")).join(counts.select("h", "n"), "h")
    rare = rare.groupBy("row").agg(F.count("*").alias("rare"), F.sum(F.log10(F.col("n") + 1)).alias("gain"))
    out = parts.drop("rest").join(rare, "row", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    return out.select(
        "doc_id", held_out(config).alias("held_out"), "n_tokens", (F.col("held") + F.coalesce("rare", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"), (F.col("score") + gain).alias("score"),
    )


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
