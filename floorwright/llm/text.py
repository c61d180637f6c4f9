"""Words, word hashes and shingle sets of whole texts, in numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one step of a Python worker holds (a longer text is a step of its own).
STEP = 4 << 20
#: Bytes of text hashed at once: bounds the tables of powers and the running sums.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most so many bytes of text, each with its whole texts as UTF-8; null counts as empty."""
    for b in batches:
        col = b.column(b.schema.get_field_index(column)).cast(pa.binary())
        sizes = np.diff(np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)) if len(col) else np.zeros(0, np.int32)
        ends, i = np.cumsum(sizes, dtype=np.int64), 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
            yield b.slice(i, j - i), [x or b"" for x in col.slice(i, j - i).to_pylist()]
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + 1024)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def _piece_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _tables(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes buf[start:end]; the runs stand in order and don't overlap."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):  # pieces end between runs
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, side="right")))
        at = starts[k]
        out[k:last] = _piece_hashes(buf[at : ends[last - 1]], starts[k:last] - at, ends[k:last] - at)
        k = last
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes_and_heads(texts)[:2]


def word_hashes_and_heads(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets: text i has the words offsets[i] to offsets[i+1], first two bytes of each).

    Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z count as a-z.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8).copy()
    buf[(buf >= 65) & (buf <= 90)] += 32
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    turns = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = turns[0::2], turns[1::2]
    out = run_hashes(buf, starts, ends)
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    heads = buf[starts].astype(np.int64) * 256 + np.where(ends - starts > 1, buf[starts + 1], 0)
    return out, np.searchsorted(starts, bounds).astype(np.int64), heads


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; with fewer words than width, the whole sequence as one."""
    words, offsets = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * _MULTIPLIERS[j % 5] * np.uint64(2 * (j // 5) + 1)
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * _MULTIPLIERS[np.arange(b - a) % 5]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
