"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf holds a run of pre-tokens with their token counts; every node holds the characters and tokens below it. An edit
walks down by characters to the leaves that it touches, cuts again from two pre-tokens before its first character until a
new cut meets an old one behind its last, encodes only what is new in between, and updates the sums from those leaves up.
The pattern that cuts pre-tokens looks only ahead, so once cuts meet all that follows stays as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.bpe import DEFAULT_RANKS, Bpe, bpe
from floorwright.llm.common import table
from floorwright.llm.text import steps

LEAF = 64
#: Pre-tokens before an edit that are cut again: the pattern looks at most so many ahead.
CONTEXT = 2


class TokenTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, tokenizer: Bpe):
        self.tokenizer = tokenizer
        self.encoded = 0
        self._build(tokenizer.cut(text))

    def _build(self, pre: list[str]) -> None:
        self.runs = [pre[i : i + LEAF] for i in range(0, len(pre), LEAF)] or [[]]
        self.size = 1 << (len(self.runs) - 1).bit_length()
        self.runs += [[] for _ in range(self.size - len(self.runs))]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.encoded += len(pre)
        for k, run in enumerate(self.runs):
            if run:
                self.chars[self.size + k] = sum(map(len, run))
                self.tokens[self.size + k] = sum(map(self.tokenizer.count, run))
        for k in range(self.size - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def pieces(self) -> int:
        return sum(map(len, self.runs))

    def text(self) -> str:
        return "".join("".join(run) for run in self.runs)

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character `at`; of the last full one if `at` is the end."""
        k, before = 1, 0
        at = min(at, max(0, self.length - 1))
        while k < self.size:
            k *= 2
            if at >= before + self.chars[k]:
                before += self.chars[k]
                k += 1
        return k - self.size, before

    def _update(self, leaf: int, run: list[str]) -> None:
        self.runs[leaf] = run
        k = self.size + leaf
        self.chars[k] = sum(map(len, run))
        self.tokens[k] = sum(map(self.tokenizer.count, run))
        k >>= 1
        while k:
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            k >>= 1

    def edit(self, start: int, end: int, new: str) -> int:
        """Puts new in place of the characters start to end (clipped to the text); the new token count."""
        start = max(0, min(start, self.length))
        end = max(start, min(end, self.length))
        if start == end and not new:
            return self.total
        first, before = self._leaf(start)
        back = 0  # pre-tokens of context: may lie in leaves before
        while first and back < CONTEXT + 1:
            back += len(self.runs[first])
            offset, k = before, 0
            for k, p in enumerate(self.runs[first]):  # pre-tokens of this leaf that lie before the edit
                if offset + len(p) > start:
                    break
                offset += len(p)
            if back == len(self.runs[first]) and k >= CONTEXT + 1:
                break
            first -= 1
            before -= self.chars[self.size + first]
        last, last_before = self._leaf(max(end, start))
        run = [p for k in range(first, last + 1) for p in self.runs[k]]
        cuts, offset = [], before
        for p in run:
            cuts.append(offset)
            offset += len(p)
        begin = max(0, sum(c + len(p) <= start for c, p in zip(cuts, run, strict=True)) - CONTEXT)
        head, old = run[:begin], run[begin:]
        origin = cuts[begin] if begin < len(cuts) else offset
        shift = len(new) - (end - start)
        kept = "".join(old)
        here = kept[: start - origin] + new + kept[end - origin :]
        ends = {c + shift for c in cuts[begin:] if c >= end}  # old cuts behind the edit, in the new text
        nxt = last + 1
        while True:
            fresh, at, meets = [], origin, None
            for p in self.tokenizer.cut(here):
                if at in ends and at >= start + len(new):
                    meets = at - shift
                    break
                fresh.append(p)
                at += len(p)
            if meets is not None or nxt >= len(self.runs):
                break
            more = self.runs[nxt]  # no cut has met yet: read on
            if more:
                at = offset
                for p in more:
                    ends.add(at + shift)
                    cuts.append(at)
                    run.append(p)
                    at += len(p)
                here += "".join(more)
                offset = at
            last, nxt = nxt, nxt + 1
        tail = [p for c, p in zip(cuts, run, strict=True) if meets is not None and c >= meets]
        self.encoded += len(fresh)
        out = head + fresh + tail
        share = -(-len(out) // (last - first + 1)) if out else 0
        for k in range(first, last + 1):
            self._update(k, out[(k - first) * share : (k - first + 1) * share])
        if max(len(self.runs[k]) for k in range(first, last + 1)) > 16 * LEAF:
            done = self.encoded
            self._build([p for r in self.runs for p in r])
            self.encoded = done
        return self.total


EDITS = "array<struct<start:int,end:int,text:string>>"


def count_tokens(docs: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_pretokens, n_encoded) for each row of docs (doc_id, text, edits).

    edits: array of (start, end, text) in characters of the text as earlier edits left it; clipped to it; null members
    count as 0 and as an empty text, null edits as none. n_tokens: tokens before, n_tokens_after: after all edits;
    n_pretokens: pre-tokens before; n_encoded: pre-tokens that edits cut and encoded anew. Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe(ranks)
        for b, texts in steps(batches):
            out = []
            for t, edits in zip(texts, b.column("edits").to_pylist(), strict=True):
                tree = TokenTree(t.decode(), tokenizer)
                before, pieces, done = tree.total, tree.pieces, tree.encoded
                for e in edits or []:
                    if e:
                        tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                out.append((before, tree.total, pieces, tree.encoded - done))
            cols = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_tokens", "n_tokens_after", "n_pretokens", "n_encoded"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("edits").cast(EDITS).alias("edits"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_after long, n_pretokens long, n_encoded long")


def sample_edits(docs: DataFrame) -> DataFrame:
    """docs with edits that follow from each text's length: one put in, one taken out, one replaced, and the end extended."""
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda share: F.floor(n * share).cast("int")
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(t).alias("text"))
    return docs.withColumn("edits", F.array(edit(at(1 / 3), at(1 / 3), " newly added, words"), edit(at(1 / 2), at(1 / 2) + 9, ""), edit(at(2 / 3), at(2 / 3) + 5, "it's  1 "), edit(n + 100, n + 100, " The end.")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(sample_edits(table(spark, sf_dir, "documents").select("doc_id", "text")))
