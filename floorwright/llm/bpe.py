"""Byte-level BPE ids of pre-tokens, remembered for each Python worker."""

from __future__ import annotations

import base64

import numpy as np
import regex

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that cuts a text into pre-tokens for this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers; then it starts anew.
_REMEMBERED = 500_000


class Bpe:
    """pre-tokens of a text, and the ids of a pre-token as little-endian 16- or 32-bit numbers."""

    def __init__(self, path: str = DEFAULT_RANKS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.dtype = np.dtype("<u2" if self.size < 1 << 16 else "<u4")
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[str, bytes] = {}

    def packed(self, pre: str) -> bytes:
        found = self.known.get(pre)
        if found is None:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
            found = self.known[pre] = np.array(self.encoding._encode_single_piece(pre), self.dtype).tobytes()
        return found

    def count(self, pre: str) -> int:
        return len(self.packed(pre)) // self.dtype.itemsize

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(b"".join(map(self.packed, self.cut(text))), self.dtype)


_loaded: dict[str, Bpe] = {}


def bpe(path: str = DEFAULT_RANKS) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]
