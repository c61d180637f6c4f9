"""Token ids packed into rows of a fixed length: best-fit decreasing, with a segment tree over capacities.

Texts are tokenized whole. One of more ids than a row holds is cut into full rows and a rest, in order, so nothing is
lost. The pieces of a block of texts (as many as a step of a worker reads) are placed longest first, each into the open
row with the least room that still takes it; the tree holds for each range of room how many open rows have it, and finds
the least sufficient room in one walk. A packed row has its ids, padded, the cumulative lengths of its segments and
positions that start again in each segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.bpe import DEFAULT_RANKS, bpe
from floorwright.llm.common import table
from floorwright.llm.text import STEP, steps


@dataclass(frozen=True)
class PackingConfig:
    length: int = 2048
    #: Put after each text; -1: nothing. It is the first id that the vocabulary leaves free.
    end_id: int = 50256
    pad_id: int = 50256
    ranks: str = DEFAULT_RANKS


class CapacityTree:
    """Counts of open rows by room, 0 to most, as a segment tree; finds the least room that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = self.leaves + room
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of at least need, taken out; None if there is none."""
        k = self.leaves + need
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):  # up, until a fuller subtree to the right
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        while k:
            self.count[k] -= 1
            k >>= 1
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows as lists of the indices of their pieces; each size is at most length. Equal sizes keep their order."""
    tree, rows = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[i])
        if found is None:
            room, row = length, len(rows)
            rows.append([i])
        else:
            room, row = found
            rows[row].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], row)
    return rows


SCHEMA = "pack_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<int>"


def pack(docs: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """Packed rows of docs (doc_id, text; other columns are ignored).

    ids: config.length little-endian ids (16 bits if the vocabulary allows, else 32), padded. position_ids: as many 32-bit
    numbers, from 0 in each segment, 0 in the padding. cu_seqlens: 0 and the end of each segment. doc_ids and starts: for
    each segment its document and at which id of the document it begins. Null and empty texts have no ids and no segment.
    pack_id is unique, not dense. Repeated rows are packed each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, n = bpe(config.ranks), config.length
        end = np.array([config.end_id] if config.end_id >= 0 else [], tokenizer.dtype)
        number = TaskContext.get().partitionId() << 33
        for b, texts in steps(batches, most=2 * STEP):
            pieces, owner, start = [], [], []
            for doc, t in zip(b.column("doc_id").to_pylist(), texts, strict=True):
                if t:
                    ids = np.concatenate([tokenizer.ids(t.decode()), end])
                    for k in range(0, len(ids), n):
                        pieces.append(ids[k : k + n])
                        owner.append(doc)
                        start.append(k)
            rows = best_fit([len(p) for p in pieces], n)
            for i in range(0, len(rows), 512):
                out: list[list] = [[] for _ in range(7)]
                for row in rows[i : i + 512]:
                    sizes = np.array([len(pieces[k]) for k in row])
                    used = int(sizes.sum())
                    ids = np.full(n, config.pad_id, tokenizer.dtype)
                    ids[:used] = np.concatenate([pieces[k] for k in row])
                    at = np.zeros(n, "<i4")
                    at[:used] = np.arange(used) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    for col, v in zip(out, (number, ids.tobytes(), used, [0, *np.cumsum(sizes).tolist()], at.tobytes(), [owner[k] for k in row], [start[k] for k in row]), strict=True):
                        col.append(v)
                    number += 1
                kinds = (pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files: the id matrix is the column ids, row after row, with its segments beside it."""
    packed.write.parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """(pack_id, n_tokens, cu_seqlens, doc_ids, starts, ids_crc32, positions_crc32) of packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = [pa.array([zlib.crc32(x.as_buffer()) for x in b.column(c)], pa.int64()) for c in ("ids", "position_ids")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("pack_id", "n_tokens", "cu_seqlens", "doc_ids", "starts")] + crc, ["pack_id", "n_tokens", "cu_seqlens", "doc_ids", "starts", "ids_crc32", "positions_crc32"])

    return packed.mapInArrow(run, "pack_id long, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, starts array<int>, ids_crc32 long, positions_crc32 long")


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
