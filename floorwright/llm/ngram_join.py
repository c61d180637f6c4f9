"""N-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row for each text and a column for each distinct word shingle; the product of it with its
transpose holds every overlap count. It is never formed whole, and a row travels packed (its hashes in one binary value):

1. Columns, first pass. Of each text only the p(n) smallest shingle hashes go on, p(n) = n - ceil(.75 n) + ceil(n / 8).
   Two texts that link share at least ceil(min(n, n') / 8) of them, whatever else they hold. Blocks of columns (ranges
   of the hash) count which of these shingles occur in two texts or more; texts with fewer such shingles than
   ceil(ceil(.75 n) / 8) can't link with anything and leave here. Columns that recur within one batch of texts are
   counted there and sent once, so a very common passage costs one entry for each batch. Of the texts that are left the
   same is done over whole sets: those with fewer recurring shingles than ceil(.75 n) leave too.
2. Exact copies of a set are one row from here on.
3. Contraction. In each of a few rounds every row is multiplied with one row of another component, the one it meets most
   often in the columns that are smallest under several hash orders; the overlap of both whole sets is counted, and links
   join components. The work is linear in the rows, however large a group of near copies is.
4. Blocks of columns count, for each row, the columns that hold rows of another component. With fewer of them than the
   size-derived bound ceil(.75 n) a row can't link with another component, and leaves; this is repeated while rows leave.
5. The rest of the product, between components only. Each row's columns are ordered by how many components they hold,
   rarest first, and cut at the size-derived bound: the columns left out can't be the only ones that a linked pair shares.
   Rows that these columns connect are dealt into blocks; each pair of blocks is multiplied in one task, which accumulates
   the overlap counts of its rows over chunks of columns and keeps the pairs that reach the bound their sizes set. What
   leaves the task is the least row that each row's links reach, not the pairs. Rows of the largest component aren't
   multiplied with each other.

Steps 1, 4 and 5 lose no link between components; step 3 only saves work, so its number of rounds changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floorwright.llm.common import dropped, lean, small, tidy, tidy_group, written
from floorwright.llm.components import components
from floorwright.llm.text import STEP, mix, shingle_sets, steps

WIDTH, PERCENT = 5, 75
#: Rows of a block of columns in step 1, as entries of eight bytes.
BLOCK = 1 << 19
#: Sets that a worker takes at once.
SLICE = 500
#: Rounds of contraction and the hash orders in each.
ROUNDS, ORDERS = 2, 8
#: Parts into which the rows of one column are dealt, each with a row of its own to be multiplied with.
SALTS = 64
#: Rows of a block of the product and columns of a chunk of it.
ROWS, CHUNK = 512, 4096
#: Meetings of two entries in a chunk, for each pair of rows, beyond which a filled-in product is the faster one.
DENSE = 24


def needed(n: int | np.ndarray, percent: int = PERCENT):
    """ceil(percent / 100 * n): the least overlap of a set of n with any set it links with."""
    return -(-percent * n // 100)


def kept(n: int | np.ndarray, percent: int = PERCENT):
    """How many of the smallest hashes of a set of n go on to the product."""
    return np.minimum(n, n - needed(n, percent) + -(-n // 8))


def least_shared(n: int | np.ndarray, percent: int = PERCENT):
    """How many of those any linked set has among its own."""
    return np.maximum(1, -(-needed(n, percent) // 8))


def set_sizes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, h1, h2) for each row: the size of its shingle set and a hash of the set in two halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in steps(batches):
            sets = shingle_sets(texts, width)
            h1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
            h2 = [int(np.bitwise_xor.reduce(mix(s + np.uint64(1))).view(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "n", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n long, h1 long, h2 long")


def _kept_of_texts(width: int, percent: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for b, texts in steps(batches, most=STEP):
            yield b.column("doc_id").to_numpy(zero_copy_only=False), [s[: kept(len(s), percent)].copy() for s in shingle_sets(texts, width)]

    return read


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            own = b.slice(i, SLICE)
            yield own.column("doc_id").to_numpy(zero_copy_only=False), [np.frombuffer(x.as_buffer(), np.uint64) for x in own.column("hashes")]


def _recurring(rows: DataFrame, read, blocks: int) -> DataFrame:
    """(doc_id, shared): how many of the shingles that read() finds for a row occur in another row too; only rows with any."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in read(batches):
            if not sum(map(len, sets)):
                continue
            h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            uniq, at, times = np.unique(h, return_inverse=True, return_counts=True)
            again = times[at] > 1
            here = np.bincount(row[again], minlength=len(sets))
            counted = np.flatnonzero(here)
            block = lambda x: ((x >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
            dups = uniq[times > 1]
            h, row = h[~again], row[~again]
            order = np.argsort(block(h) * len(sets) + row, kind="stable")
            h, row = h[order], row[order]
            ends, dup_ends = np.searchsorted(block(h), np.arange(blocks + 1)), np.searchsorted(block(dups), np.arange(blocks + 1))
            out = [(int(h[0] if len(h) else dups[0]) % blocks, None, ids[counted].tobytes(), here[counted].astype(np.int32).tobytes(), None)]
            for k in range(blocks):
                i, j = ends[k], ends[k + 1]
                if j > i or dup_ends[k + 1] > dup_ends[k]:
                    rows, n = np.unique(row[i:j], return_counts=True)
                    out.append((k, h[i:j].tobytes(), ids[rows].tobytes(), n.astype(np.int32).tobytes(), dups[dup_ends[k] : dup_ends[k + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["block", "hashes", "ids", "counts", "dups"])

    def count(t: pa.Table) -> pa.Table:
        who, n, own, owner = [], [], [], []
        for hashes, ids, counts, dups in zip(*(t.column(c).to_pylist() for c in ("hashes", "ids", "counts", "dups")), strict=True):
            i, c = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32)
            if hashes is None:
                who.append(i)
                n.append(c.astype(np.int64))
            else:
                own += [np.frombuffer(hashes, np.uint64), np.frombuffer(dups, np.uint64)]
                owner += [np.repeat(i, c), np.full(len(dups) // 8, np.iinfo(np.int64).min)]
        if own:
            h, o = np.concatenate(own), np.concatenate(owner)
            _, at, times = np.unique(h, return_inverse=True, return_counts=True)
            # the hashes that one batch has counted as recurring stand here beside those of other batches
            i, c = np.unique(o[(times[at] > 1) & (o != np.iinfo(np.int64).min)], return_counts=True)
            who.append(i)
            n.append(c)
        return pa.table({"doc_id": np.concatenate(who) if who else np.zeros(0, np.int64), "shared": np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)})

    entries = rows.mapInArrow(tidy(cut), "block int, hashes binary, ids binary, counts binary, dups binary")
    return entries.groupBy("block").applyInArrow(tidy_group(count), "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, hashes): whole sets as sorted hashes of eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in steps(batches):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "n", "hashes"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, hashes binary")


def _columns(sets: DataFrame) -> DataFrame:
    """(doc_id, n, h): a row for each shingle of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ns = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
            for i in range(0, b.num_rows, 500):
                h = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("hashes").slice(i, 500)]
                times = [len(x) for x in h]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[i : i + 500], times)), pa.array(np.repeat(ns[i : i + 500], times)), pa.array(np.concatenate(h))], ["doc_id", "n", "h"])

    return sets.mapInArrow(tidy(run), "doc_id long, n long, h long")


def _smallest(sets: DataFrame, seed: int) -> DataFrame:
    """(doc_id, n, component, k, h): for each row and each of several hash orders the smallest column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                own = b.slice(i, SLICE)
                cols = [np.frombuffer(x.as_buffer(), np.uint64) for x in own.column("hashes")]
                starts, h = np.cumsum([0] + [len(c) for c in cols[:-1]]), np.concatenate(cols)
                for k in range(ORDERS):
                    least = np.minimum.reduceat(mix(h + np.uint64((seed * ORDERS + k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), starts)
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n"), own.column("component"), pa.array(np.full(len(cols), k, np.int32)), pa.array(least.view(np.int64))], ["doc_id", "n", "component", "k", "h"])

    return sets.select("doc_id", "n", "component", "hashes").mapInArrow(tidy(run), "doc_id long, n long, component long, k int, h long")


def _suggested(sets: DataFrame, seed: int, percent: int) -> DataFrame:
    """(a, b): for each row the row of another component that it meets in most of its smallest columns, if there is one.

    A column's rows are dealt into parts by a hash; each part has one row that its others meet, and these meet the column's.
    """
    own = _smallest(sets, seed).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(SALTS)))
    who = F.struct(F.xxhash64("doc_id", F.lit(seed + 1)).alias("x"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    parts = own.groupBy("k", "h", "part").agg(F.min(who).alias("p"), F.count("*").alias("rows"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    tops = parts.groupBy("k", "h").agg(F.min("p").alias("top"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("k", "h", "top")
    one = own.join(parts.where("lo <> hi").select("k", "h", "part", "p"), ["k", "h", "part"]).select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), "p.*")
    two = parts.join(tops, ["k", "h"]).select(F.col("p.b").alias("a"), F.col("p.nb").alias("na"), F.col("p.cb").alias("ca"), F.col("top.b").alias("b"), F.col("top.nb").alias("nb"), F.col("top.cb").alias("cb"))
    met = one.select("a", "na", "ca", "b", "nb", "cb").unionByName(two).where((F.col("ca") != F.col("cb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
    met = met.groupBy("a", "b").agg(F.count("*").alias("times"))
    return met.groupBy("a").agg(F.max_by("b", F.struct("times", F.xxhash64("b", F.lit(seed)))).alias("b"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose whole sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("ha"), b.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("ha")), "a")
    return left.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb").mapInArrow(tidy(run), "a long, b long")


def _between(sets: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, shared): how many columns of a row hold a row of another component; only rows with any."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                ids, comps = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "component"))
                cols = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("hashes")]
                h, row = np.concatenate(cols), np.repeat(np.arange(len(cols)), [len(c) for c in cols])
                here = _of_several(h, comps[row])
                n = np.bincount(row[here], minlength=len(cols))
                met = np.unique(h[here])
                h, row = h[~here], row[~here]
                yield from _packed(blocks, h, ids[row], comps[row], met, ids[n > 0], n[n > 0])

    def count(t: pa.Table) -> pa.Table:
        h, ids, comps, met, who, n = (np.concatenate([np.frombuffer(x.as_buffer(), k) for x in t.column(c)]) for c, k in _ENTRY)
        # a column that one batch has found in several components may stand here beside those of other batches
        here = _of_several(np.concatenate([h, met, met]), np.concatenate([comps, np.full(len(met), np.iinfo(np.int64).min), np.full(len(met), np.iinfo(np.int64).max)]))[: len(h)]
        i, c = np.unique(ids[here], return_counts=True)
        return pa.table({"doc_id": np.concatenate([who, i]), "shared": np.concatenate([n, c.astype(np.int64)])})

    entries = sets.select("doc_id", "component", "hashes").mapInArrow(tidy(cut), "block int, " + ", ".join(f"{c} binary" for c, _ in _ENTRY))
    return entries.groupBy("block").applyInArrow(tidy_group(count), "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))


_ENTRY = [("h", np.uint64), ("ids", np.int64), ("comps", np.int64), ("met", np.uint64), ("who", np.int64), ("n", np.int64)]


def _of_several(h: np.ndarray, comps: np.ndarray) -> np.ndarray:
    """Whether an entry's column holds entries of several components."""
    if not len(h):
        return np.zeros(0, bool)
    order = np.lexsort((comps, h))
    a, c = h[order], comps[order]
    first = np.concatenate(([True], a[1:] != a[:-1]))
    group = np.cumsum(first) - 1
    begins = np.flatnonzero(first)
    ends = np.append(begins[1:], len(a)) - 1
    out = np.empty(len(h), bool)
    out[order] = (c[begins] != c[ends])[group]
    return out


def _packed(blocks: int, h: np.ndarray, ids: np.ndarray, comps: np.ndarray, met: np.ndarray, who: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each block of columns that has any of the entries; what is counted already goes with the first."""
    block = lambda x: ((x >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    order, of = np.argsort(h), np.arange(blocks + 1)
    h, ids, comps = h[order], ids[order], comps[order]
    i, j = np.searchsorted(block(h), of), np.searchsorted(block(met), of)
    out: list[tuple] = [((int(who[0]) if len(who) else 0) % blocks, b"", b"", b"", b"", who.astype(np.int64).tobytes(), n.astype(np.int64).tobytes())]
    for k in np.flatnonzero((np.diff(i) > 0) | (np.diff(j) > 0)).tolist():
        at = slice(i[k], i[k + 1])
        out.append((k, h[at].tobytes(), ids[at].tobytes(), comps[at].tobytes(), met[j[k] : j[k + 1]].tobytes(), b"", b""))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 6), strict=True)], ["block", *[c for c, _ in _ENTRY]])


def _blocks(sets: DataFrame) -> int:
    return int(min(4096, max(24, (sets.agg(F.sum("n")).first()[0] or 0) // BLOCK)))


def links(docs: DataFrame, sizes: DataFrame, width: int = WIDTH, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b) between texts whose sets differ, enough of them to connect every component.

    sizes: what set_sizes() gives for docs, written. Exact copies of a set stand under the least doc_id that has it.
    rounds: of contraction; with any number, 0 included, the components are the same.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    entries = sizes.agg(F.sum("n")).first()[0] or 0
    blocks = int(min(4096, max(24, entries * 3 // 8 // BLOCK)))
    shared = _recurring(docs.where("doc_id is not null"), _kept_of_texts(width, percent), blocks)
    first = sizes.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "n")
    some = F.greatest(F.lit(1), F.ceil(F.ceil(F.lit(percent) * F.col("n") / 100) / 8))
    left = written(first.join(shared, "doc_id").where(F.col("shared") >= some).select("doc_id").distinct(), "candidates")
    every = written(_sets(docs.join(small(left, left.count()), "doc_id", "left_semi"), width), "sets")
    dropped(left)
    # among these, over whole sets: with fewer recurring shingles than the least overlap nothing can link
    least = F.greatest(F.lit(1), F.ceil(F.lit(percent) * F.col("n") / 100))
    shared = _recurring(every, _whole_sets, _blocks(every))
    left = written(every.select("doc_id", "n").join(shared, "doc_id").where(F.col("shared") >= least).select("doc_id").distinct(), "candidates")
    sets = written(every.join(small(left, left.count()), "doc_id", "left_semi"), "sets")
    dropped(left)
    dropped(every)
    found = [spark.createDataFrame([], "a long, b long")]

    def all_found() -> DataFrame:
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def placed(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
        if comp is None:
            return rows.withColumn("component", F.col("doc_id"))
        of = rows.select("doc_id").join(comp.withColumnRenamed("node", "doc_id"), "doc_id")
        of = written(of.distinct(), "placed")
        return rows.join(small(of, of.count()), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))

    comp = None
    for turn in range(rounds):
        new = written(_linked(_suggested(placed(sets, comp), 2 * turn, percent), sets, percent), "links")
        found.append(new)
        if not new.count():
            break
        comp = components(all_found())
    while True:
        now = placed(sets, comp)
        open_ = written(now.select("doc_id", "n").join(_between(now, _blocks(sets)), "doc_id").where(F.col("shared") >= least).select("doc_id"), "open")
        n_open, before = open_.count(), sets.count()
        rest = written(sets.join(small(open_, n_open), "doc_id", "left_semi"), "sets")
        dropped(sets)
        dropped(open_)
        sets = rest
        if not n_open:
            return all_found()
        if n_open * 10 > before * 9:
            break
    own = _columns(sets).join(placed(sets.select("doc_id"), comp), "doc_id").select("doc_id", "n", "h", F.col("component").alias("comp"))
    own = written(own, "columns")
    held = own.select("h", "comp").distinct().groupBy("h").agg(F.count("*").alias("held")).where("held > 1")
    y = written(own.join(held, "h"), "shared")
    rank = F.expr("row_number() over (partition by doc_id order by held, h)")
    # columns of one component count first: of n columns, n - least + 1 have one that a linked row has too
    take = F.col("n") - least + 1 - (F.col("n") - F.expr("count(*) over (partition by doc_id)"))
    used = written(y.withColumn("rank", rank).withColumn("take", take).where("rank <= take").select("h", "doc_id"), "used")
    dropped(own)
    dropped(y)
    groups = components(_met(used)).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "cluster")
    rows = placed(sets, comp).join(groups, "doc_id")
    found.append(written(_product(written(rows, "rows"), percent), "links"))
    dropped(used)
    return all_found()


def _met(used: DataFrame) -> DataFrame:
    """(a, b): pairs of rows that share a column, as few as connect all rows of each column; a column's rows are dealt into parts."""
    own = used.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = own.groupBy("h", "part").agg(F.min("doc_id").alias("b"))
    tops = parts.groupBy("h").agg(F.min("b").alias("top"))
    one = own.join(parts, ["h", "part"]).select(F.col("doc_id").alias("a"), "b")
    return one.unionByName(parts.join(tops, "h").select(F.col("b").alias("a"), F.col("top").alias("b"))).where("a <> b").distinct()


def _overlaps(column: np.ndarray, row: np.ndarray, left: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Overlap counts (n_a * n_b) over one chunk of columns; entries are in order of their column.

    Sparse, column by column: each entry of a left row meets those of the right rows of its column. Where these are more
    than DENSE for each pair of rows, the chunk is filled in and multiplied; counts of a chunk are exact in 32 bits.
    """
    ca, ra, cb, rb = column[left], row[left], column[~left], row[~left]
    first, last = np.searchsorted(cb, ca), np.searchsorted(cb, ca, side="right")
    times = last - first
    total = int(times.sum())
    if total > DENSE * n_a * n_b:
        x, y = np.zeros((n_a, CHUNK), np.float32), np.zeros((n_b, CHUNK), np.float32)
        x[ra, ca] = 1
        y[rb, cb] = 1
        return (x @ y.T).astype(np.int64).ravel()
    at = np.arange(total) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    return np.bincount(np.repeat(ra, times) * n_b + rb[at], minlength=n_a * n_b)


def _product(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what any links between rows of a cluster connect.

    rows: doc_id, n, component, cluster, hashes. In each cluster the rows of its largest component are one side, the others
    are multiplied with each other and with that side, block by block.
    """
    of = rows.groupBy("cluster", "component").agg(F.count("*").alias("rows"))
    most = of.groupBy("cluster").agg(F.max_by("component", F.struct("rows", "component")).alias("major"), F.max("rows").alias("top"), F.sum("rows").alias("rows"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / ROWS)).cast("int")
    most = written(most.where("rows > top").select("cluster", "major", blocks(F.col("rows") - F.col("top")).alias("others"), blocks(F.col("top")).alias("majors")), "clusters")
    own = rows.join(small(most, most.count()), "cluster").withColumn("is_major", F.col("component") == F.col("major"))
    own = own.withColumn("t", F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("others"))).cast("int"))
    kept = ["cluster", "doc_id", "n", "component", "hashes"]

    def side(df: DataFrame, number: int, kind: int, i, j) -> DataFrame:
        return df.select(*kept, F.lit(number).alias("side"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    def spread(df: DataFrame, first, last) -> DataFrame:
        return df.withColumn("k", F.explode(F.sequence(first, last)))

    rest, major, t, k = own.where("not is_major"), own.where("is_major"), F.col("t"), F.col("k")
    last = F.col("others") - 1
    dealt = side(spread(rest, t, last), 0, 0, t, k).unionByName(side(spread(rest, F.lit(0), t), 1, 0, k, t))
    dealt = dealt.unionByName(side(spread(rest, F.lit(0), F.col("majors") - 1), 0, 1, t, k)).unionByName(side(spread(major, F.lit(0), last), 1, 1, k, t))

    def multiply(block: pa.Table) -> pa.Table:
        which, ids, n, comps = (block.column(c).to_numpy() for c in ("side", "doc_id", "n", "component"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in block.column("hashes")]
        a, b = np.flatnonzero(which == 0), np.flatnonzero(which == 1)
        none = pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        if not len(a) or not len(b):
            return none
        row = np.empty(len(ids), np.int64)
        row[a], row[b] = np.arange(len(a)), np.arange(len(b))
        h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        _, column = np.unique(h, return_inverse=True)
        in_a = which[of] == 0
        both = np.zeros(column.max() + 1, np.int8)
        both[column[in_a]] |= 1
        both[column[~in_a]] |= 2
        shared = np.cumsum(both == 3) - 1
        keep = both[column] == 3
        column, of, in_a = shared[column[keep]], of[keep], in_a[keep]
        order = np.argsort(column, kind="stable")
        column, of, in_a = column[order], of[order], in_a[order]
        overlap = np.zeros(len(a) * len(b), np.int64)
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
            i, j = np.searchsorted(column, (c, c + CHUNK))
            overlap += _overlaps(column[i:j] - c, row[of[i:j]], in_a[i:j], len(a), len(b))
        overlap = overlap.reshape(len(a), len(b))
        hit = 100 * overlap >= percent * (n[a][:, None] + n[b][None, :] - overlap)
        hit &= comps[a][:, None] != comps[b][None, :]
        a, b, hit = a[hit.any(1)], b[hit.any(0)], hit[hit.any(1)][:, hit.any(0)]
        if not len(a):
            return none
        top, x, y = np.iinfo(np.int64).max, ids[a], ids[b]
        while True:  # the least row reached; only the least neighbour could part what another link joins
            nx = np.minimum(x, np.where(hit, y[None, :], top).min(1))
            ny = np.minimum(y, np.where(hit, nx[:, None], top).min(0))
            if (nx == x).all() and (ny == y).all():
                break
            x, y = nx, ny
        out = pa.table({"a": np.concatenate([ids[a], ids[b]]), "b": np.concatenate([x, y])})
        return out.filter(pc.not_equal(out.column("a"), out.column("b")))

    return dealt.groupBy("cluster", "kind", "i", "j").applyInArrow(tidy_group(multiply), "a long, b long")


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text; other columns are ignored).

    n_shingles: size of the set of distinct shingles. component_id: least doc_id reachable by links, itself included; two
    rows link if 100 * overlap >= percent * union of their sets. Null and empty texts and texts without words have an
    empty set, link with nothing and are their own component. Rows that repeat a doc_id are one node and each come back.
    A null doc_id links with nothing and has a null component_id.
    """
    lean(docs.sparkSession)
    sizes = written(set_sizes(docs, width), "sizes")
    found = links(docs, sizes, width, percent, rounds)
    first = sizes.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("first"))
    copies = sizes.where("doc_id is not null").join(first, ["n", "h1", "h2"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    comp = components(found.unionByName(copies))
    out = sizes.select("doc_id", F.col("n").alias("n_shingles")).join(comp, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
