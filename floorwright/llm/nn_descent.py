"""Near duplicates among embeddings by NN-descent on a neighbour graph.

Vectors with the same label and the same direction bit for bit are one vertex. The first graph comes from leaves of
random hyperplane codes (leaves over a bound are dealt into several), with as many bits as the vertex's own label needs
and as many tables as these bits need. In each round every vertex compares the neighbours
it has and those that have it with each other; what is nearer replaces what is farther in their lists. Lists that end up
saturated (all entries at or above the threshold) are enlarged to the whole neighbourhood: their vertices' components,
taken with a margin below the threshold, are compared in tiles. An audit compares sampled vertices with all rows, each
vertex by itself and those outside the tiled groups apart; while it finds too few of their links, lists and leaves grow and
rounds go on, and after the last attempt whole labels are compared in tiles. Edges at or above the threshold are the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floorwright.llm.common import small, table, written
from floorwright.llm.components import components


@dataclass(frozen=True)
class DescentConfig:
    threshold: float = 0.93
    margin: float = 0.03
    neighbours: int = 12
    tables: int = 8
    leaf: int = 256
    rounds: int = 2
    tile: int = 512
    #: Rows of a tile where whole labels are compared.
    whole: int = 2048
    #: The audit: how many vertices it compares with all rows, and the share of their links that has to be found.
    audit: int = 256
    recall: float = 0.97
    #: The chance, at least, that a pair at the threshold meets in a leaf of an attempt, before leaves are dealt.
    meet: float = 0.985
    attempts: int = 3


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for v in b.column("embedding"):
            x = np.array(v.values.to_numpy(zero_copy_only=False), np.float64) if v.is_valid else np.zeros(0)
            top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if top > 0:
                x = x / top
                x = x / np.sqrt(x @ x)
            out.append(x.tobytes() if top > 0 else None)
        yield b.select(["vec_id", "label"]).append_column("unit", pa.array(out, pa.binary()))


def _vertices(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their vertex, vertices): vertex is the least vec_id of a label and direction; copies: how many have it."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = own.mapInArrow(_unit, own.select("vec_id", "label").schema.add("unit", "binary"))
    rows = written(rows.withColumn("key", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.md5("unit"))), "units")
    good = rows.where("vec_id is not null and label is not null and unit is not null").dropDuplicates(["vec_id", "label", "key"])
    same = good.groupBy("label", "key").agg(F.min("vec_id").alias("vertex"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    same = written(same, "vertices")
    rows = rows.select("vec_id", "label", "key").join(same.select("label", "key", "vertex", "copies"), ["label", "key"], "left")
    return rows.select("vec_id", "vertex", "copies"), same.select("vertex", "label", "unit", "copies")


def _matrix(col: pa.ChunkedArray, kind=np.float64) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in col]


def _nearest(ids: np.ndarray, vectors: list[np.ndarray], k: int) -> pa.Table:
    """For each row its k nearest others of the same dimension, as (a, b, sim)."""
    a, b, s = [], [], []
    dims = np.array([len(v) for v in vectors])
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        if len(at) < 2:
            continue
        m = np.stack([vectors[i] for i in at]).astype(np.float32)
        sim = m @ m.T
        np.fill_diagonal(sim, -2)
        n = min(k, len(at) - 1)
        best = np.argpartition(-sim, n - 1, axis=1)[:, :n]
        a.append(np.repeat(ids[at], n))
        b.append(ids[at][best].ravel())
        s.append(np.take_along_axis(sim, best, 1).ravel())
    keep = np.concatenate(a) != np.concatenate(b) if a else None
    return pa.table({"a": np.concatenate(a)[keep], "b": np.concatenate(b)[keep], "sim": np.concatenate(s)[keep]} if a else {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "sim": np.zeros(0, np.float32)})


_EDGE = "a long, b long, sim float"


def _tables(bits: int, config: DescentConfig) -> int:
    """How many tables it takes for a pair at the threshold to meet: more bits, more tables."""
    both = (1 - math.acos(config.threshold) / math.pi) ** bits
    return max(config.tables, math.ceil(math.log(1 - config.meet) / math.log(1 - both))) if bits else 1


def _bits(count: Column, config: DescentConfig) -> Column:
    """Bits of a code for a label of so many vertices; one that fits a leaf isn't cut."""
    return F.greatest(F.lit(0), F.ceil(F.log2(count / config.leaf))).cast("int")


def _leaves(vertices: DataFrame, counts: DataFrame, labels: int, config: DescentConfig, seed: int) -> DataFrame:
    """Edges among vertices of one leaf; each vertex is in one leaf of each table of its label."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            units = _matrix(b.column("unit"))
            out = []
            for v, bits in zip(units, b.column("bits").to_pylist(), strict=True):
                n = _tables(bits, config)
                if (len(v), bits) not in planes:
                    planes[len(v), bits] = np.random.default_rng(seed + len(v)).standard_normal((n * bits, len(v)))
                out.append(((planes[len(v), bits] @ v > 0).reshape(n, bits).astype(np.int64) << np.arange(bits)).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("vertex"), b.column("label"), pa.array([x.astype(np.float32).tobytes() for x in units], pa.binary()), pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], ["vertex", "label", "unit", "codes"])

    cut = vertices.join(small(counts.select("label", _bits(F.col("count"), config).alias("bits")), labels), "label").select("vertex", "label", "unit", "bits")
    coded = cut.mapInArrow(codes, vertices.select("vertex", "label", "unit").schema.add("codes", T.ArrayType(T.LongType())))
    dealt = written(coded.select("vertex", "label", "unit", F.size("codes").alias("tables"), F.posexplode("codes").alias("tab", "code")), "leaves")
    sizes = dealt.groupBy("label", "tab", "code").agg(F.ceil(F.count("*") / (2 * config.leaf)).alias("parts"))
    full = written(sizes.where("parts > 1"), "leaf-sizes")
    parts = F.coalesce("parts", F.lit(1))
    dealt = dealt.join(small(full, full.count()), ["label", "tab", "code"], "left").withColumn("part", F.pmod(F.xxhash64("vertex", "tab"), parts))

    def near(t: pa.Table) -> pa.Table:
        most = config.neighbours if t.column("tables")[0].as_py() == 1 else max(4, config.neighbours // 2)
        return _nearest(t.column("vertex").to_numpy(), _matrix(t.column("unit"), np.float32), most)

    return dealt.groupBy("label", "tab", "code", "part").applyInArrow(near, _EDGE)


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each vertex, as edges. An exact top-k by aggregation of bounded lists."""
    best = edges.groupBy("a", "b").agg(F.max("sim").alias("sim")).groupBy("a", F.pmod(F.xxhash64("b"), F.lit(8)).alias("part"))
    best = best.agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "b")), asc=False), 1, k).alias("l"))
    best = best.groupBy("a").agg(F.slice(F.sort_array(F.flatten(F.collect_list("l")), asc=False), 1, k).alias("l"))
    return best.select("a", F.explode("l").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.sim").alias("sim"))


def _round(graph: DataFrame, vertices: DataFrame, k: int) -> DataFrame:
    """New edges: for each vertex its neighbours, and of those that have it the nearest in each of k parts, among themselves."""
    back = graph.groupBy("b", F.pmod(F.xxhash64("a"), F.lit(k)).alias("part")).agg(F.max_by("a", F.struct("sim", "a")).alias("a"))
    members = graph.select(F.col("a").alias("c"), F.col("b").alias("vertex")).unionByName(back.select(F.col("b").alias("c"), F.col("a").alias("vertex")))
    members = members.distinct().join(vertices.select("vertex", "unit"), "vertex")

    def near(t: pa.Table) -> pa.Table:
        return _nearest(t.column("vertex").to_numpy(), _matrix(t.column("unit")), 4)

    return members.groupBy("c").applyInArrow(near, _EDGE)


def _tiles(members: DataFrame, config: DescentConfig) -> DataFrame:
    """(vertex, links, to): in each group of members the links of each vertex, copies counted, and the least vertex that
    links within the tile reach."""
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / config.tile).cast("int").alias("tiles"))
    m = members.join(sizes, "group").withColumn("t", F.pmod(F.xxhash64("vertex"), F.col("tiles")).cast("int"))
    right = m.select("*", F.explode(F.sequence(F.lit(0), F.col("t"))).alias("i")).select("group", "i", F.col("t").alias("j"), F.lit(1).alias("side"), "vertex", "copies", "unit")
    left = m.select("*", F.explode(F.sequence(F.col("t"), F.col("tiles") - 1)).alias("j")).select("group", F.col("t").alias("i"), "j", F.lit(0).alias("side"), "vertex", "copies", "unit")

    def compare(t: pa.Table) -> pa.Table:
        side, ids, copies = (t.column(c).to_numpy() for c in ("side", "vertex", "copies"))
        units = _matrix(t.column("unit"))
        dims = np.array([len(u) for u in units])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        one = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        for d in np.unique(dims):
            a, b = np.flatnonzero((side == 0) & (dims == d)), np.flatnonzero((side == 1) & (dims == d))
            if not len(a) or not len(b):
                continue
            hit = np.stack([units[i] for i in a]) @ np.stack([units[i] for i in b]).T >= config.threshold
            hit &= ids[a][:, None] != ids[b][None, :]
            a, b, hit = a[hit.any(1)], b[hit.any(0)], hit[hit.any(1)][:, hit.any(0)]
            if not len(a):
                continue
            top, x, y = np.iinfo(np.int64).max, ids[a], ids[b]
            while True:  # the least vertex reached; a link to the least neighbour alone could part what another link joins
                nx = np.minimum(x, np.where(hit, y[None, :], top).min(1))
                ny = np.minimum(y, np.where(hit, nx[:, None], top).min(0))
                if (nx == x).all() and (ny == y).all():
                    break
                x, y = nx, ny
            out.append((ids[a], hit @ copies[b], x))
            if not one:
                out.append((ids[b], hit.T @ copies[a], y))
        if not out:
            return pa.table({"vertex": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})
        v, n, least = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"vertex": v[n > 0], "links": n[n > 0].astype(np.int64), "to": least[n > 0]})

    # dealt by tile, not by group: a group of a third of all rows is many tasks
    return left.unionByName(right).repartition("group", "i", "j").groupBy("group", "i", "j").applyInArrow(compare, "vertex long, links long, to long")


def _audit(vertices: DataFrame, links: DataFrame, config: DescentConfig, among: DataFrame | None = None) -> float:
    """The share of its links that was found, on average over sampled vertices with links; the sample, dealt over the labels
    of among (of all vertices without it), is compared with all rows."""
    key = F.xxhash64("vertex", F.lit(7))
    sample = (vertices if among is None else among).groupBy("label", F.pmod(F.xxhash64("vertex"), F.lit(config.audit)).alias("part")).agg(F.min_by(F.struct("vertex", "unit"), key).alias("v"))
    sample = sample.select("v.vertex", "label", "v.unit").orderBy(key).limit(config.audit).collect()
    by = [(r.vertex, r.label, np.frombuffer(r.unit, np.float64)) for r in sample]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(by), np.int64)
        for b in batches:
            ids, labels, copies, units = b.column("vertex").to_numpy(), np.array(b.column("label").to_pylist(), object), b.column("copies").to_numpy(), _matrix(b.column("unit"))
            dims = np.array([len(u) for u in units])
            for d in np.unique(dims):
                at, mine = np.flatnonzero(dims == d), [k for k, x in enumerate(by) if len(x[2]) == d]
                if mine:
                    sim = np.stack([by[k][2] for k in mine]) @ np.stack([units[i] for i in at]).T
                    for row, k in zip(sim, mine, strict=True):
                        found[k] += copies[at][(row >= config.threshold) & (labels[at] == by[k][1]) & (ids[at] != by[k][0])].sum()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in by], pa.int64()), pa.array(found)], ["vertex", "n"])

    if not by:
        return 1.0
    true = vertices.mapInArrow(count, "vertex long, n long").groupBy("vertex").agg(F.sum("n").alias("n"))
    got = true.where("n > 0").join(links.select("vertex", "links"), "vertex", "left").agg(F.avg(F.least("n", F.coalesce("links", F.lit(0))) / F.col("n"))).first()
    return 1.0 if got[0] is None else got[0]


def near_duplicates(vectors: DataFrame, config: DescentConfig = DescentConfig()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label; other columns are ignored).

    Vectors link if their labels are equal and not null, their dimensions are equal and their cosine, in double precision,
    is at or above the threshold. Vectors that are null, empty or zero or hold null or non-finite components link with
    nothing. n_links counts other vectors; rows that repeat a vec_id with its vector count once. A null vec_id links with
    nothing, has no component and is kept.
    """
    rows, vertices = _vertices(vectors)
    counts = written(vertices.groupBy("label").count(), "labels")
    labels = counts.count()
    sims = vertices.select("vertex", "copies")
    graph, links, joins = None, None, None
    for attempt in range(config.attempts):
        now = replace(config, neighbours=config.neighbours << attempt, leaf=config.leaf << attempt)
        edges = _leaves(vertices, counts, labels, now, 1000 * attempt)
        graph = written(_lists(edges if graph is None else edges.unionByName(graph), now.neighbours), "graph")
        for _ in range(config.rounds + attempt):
            graph = written(_lists(graph.unionByName(_round(graph, vertices, now.neighbours)), now.neighbours), "graph")
        near = written(_exact(graph.where(F.col("sim") >= config.threshold - config.margin), vertices, config), "near")
        full = near.where(F.col("sim") >= config.threshold).groupBy("a").count().where(F.col("count") >= now.neighbours)
        groups = written(components(near.select("a", "b")).select(F.col("node").alias("vertex"), F.col("component").alias("group")), "groups")
        dense = groups.join(groups.join(full.select(F.col("a").alias("vertex")), "vertex").select("group").distinct(), "group", "left_semi")
        tiled = written(_tiles(dense.join(vertices, "vertex"), config), "tiles")
        pairs = near.where(F.col("sim") >= config.threshold)
        pairs = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        sparse = pairs.join(dense.select(F.col("vertex").alias("a")), "a", "left_anti")
        listed = sparse.join(sims.withColumnRenamed("vertex", "b"), "b").groupBy(F.col("a").alias("vertex")).agg(F.sum("copies").alias("links"))
        links = written(listed.unionByName(tiled.groupBy("vertex").agg(F.sum("links").alias("links"))), "links")
        joins = pairs.unionByName(tiled.select(F.col("vertex").alias("a"), F.col("to").alias("b")))
        apart = vertices.join(dense.select("vertex"), "vertex", "left_anti")
        if _audit(vertices, links, config) >= config.recall and _audit(vertices, links, config, apart) >= config.recall:
            break
    else:
        tiled = written(_tiles(vertices.withColumn("group", F.col("label")), replace(config, tile=config.whole)), "tiles")
        links = written(tiled.groupBy("vertex").agg(F.sum("links").alias("links")), "links")
        joins = tiled.select(F.col("vertex").alias("a"), F.col("to").alias("b"))
    comp = components(joins).withColumnRenamed("node", "vertex")
    out = rows.join(links, "vertex", "left").join(comp, "vertex", "left")
    n = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    first = F.coalesce("component", "vertex", "vec_id")
    return out.select("vec_id", n.cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), first).alias("component_id"), F.coalesce(F.col("vec_id") == first, F.lit(True)).alias("kept"))


def _exact(edges: DataFrame, vertices: DataFrame, config: DescentConfig) -> DataFrame:
    """Edges with their similarity in double precision where single precision can't tell the side of the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [float(np.frombuffer(x.as_buffer(), np.float64) @ np.frombuffer(y.as_buffer(), np.float64)) for x, y in zip(b.column("ua"), b.column("ub"), strict=True)]
            yield b.select(["a", "b"]).append_column("sim", pa.array(s, pa.float64()))

    close = F.abs(F.col("sim") - config.threshold) < 1e-4
    doubt = edges.where(close).join(vertices.select(F.col("vertex").alias("a"), F.col("unit").alias("ua")), "a").join(vertices.select(F.col("vertex").alias("b"), F.col("unit").alias("ub")), "b")
    return edges.where(~close).select("a", "b", F.col("sim").cast("double").alias("sim")).unionByName(doubt.select("a", "b", "ua", "ub").mapInArrow(run, "a long, b long, sim double"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
