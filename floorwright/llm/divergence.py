"""Audit of how sources differ in their terms, with late string materialization: only digests of terms are shuffled.

1. Tasks count, for each group (lang, source), the occurrences of each term and the texts that have it. What goes on is
   the term's 64-bit digest with two numbers; the terms' own texts stay behind. Counts are summed by (lang, source,
   digest), and the digests that stand in enough texts of a lang are kept.
2. The texts are read again: each task gives its distinct terms once, those with a kept digest go on, and a digest's
   minimum and maximum string are taken. Where these differ the digest is split: its terms are counted once more under
   their own strings, and each has to stand in enough texts by itself. For all others the minimum is the term's string.
3. Shares, their differences and ranks are computed on digests. Strings are joined back for what is returned.

Differences of two sources are summed in tiles: some sources by some sources over some of a lang's terms, in one task;
a term that is in neither source of a pair adds the same to its sum, whichever it is, and is only counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.common import dropped, lean, small, table, tidy, written
from floorwright.llm.text import run_hashes, steps

_LETTERS = np.array([b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Entries that a task holds before it gives its counts away.
_HELD = 1 << 20


@dataclass(frozen=True)
class DivergenceConfig:
    #: Texts of a lang that have to have a term.
    least_texts: int = 30
    #: Added to each count, and what all shares sum to.
    smoothing: int = 5
    scale: int = 1_000_000_000
    #: Ranks of the part `term`.
    top: int = 50
    #: Bits of a digest; fewer than 64 only to try out collisions.
    bits: int = 64
    #: Sources of a tile's side and terms of a tile.
    sources: int = 128
    terms: int = 1024


def terms(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """(all terms in order, offsets: text i has those from offsets[i] to offsets[i+1]).

    A term is a maximal run of A-Z, a-z and code points above 127; only A-Z are lower-cased.
    """
    if not texts:
        return pa.array([], pa.binary()), np.zeros(1, np.int64)
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = _LETTERS[buf]
    turns = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = turns[0::2], turns[1::2]
    data, offsets = _LOWER[buf[inside]], np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(starts, bounds).astype(np.int64)


def digests(distinct: pa.BinaryArray, bits: int = 64) -> np.ndarray:
    """A digest of so many bits for each term."""
    offsets = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, distinct.offset * 4).astype(np.int64)
    data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
    return (run_hashes(data, offsets[:-1], offsets[1:]) >> np.uint64(64 - bits)).view(np.int64)


def _merged(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of keys with their sums."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return [k[at] for k in keys], [np.add.reduceat(s[order], at) if len(at) else s for s in sums]


def _entries(b: pa.RecordBatch, texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms of the texts; and for each of a text's terms: row of b, place among the distinct, occurrences)."""
    own, offsets = terms(texts)
    coded = own.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    n = max(1, len(coded.dictionary))
    key, times = np.unique(row * n + code, return_counts=True)
    return coded.dictionary, key // n, key % n, times


def term_counts(docs: DataFrame, config: DivergenceConfig) -> DataFrame:
    """(lang, source, h, n, d): occurrences of a digest in a group and the texts that have it; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            g, h, n, d = held[0]
            names = list(groups)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in names], pa.string()).take(pa.array(g)), pa.array([x[1] for x in names], pa.string()).take(pa.array(g)), pa.array(h), pa.array(n), pa.array(d)], ["lang", "source", "h", "n", "d"])

        def merge() -> None:
            g, h, n, d = (np.concatenate(x) for x in zip(*held, strict=True))
            (g, h), (n, d) = _merged([g, h], [n, d])
            held[:] = [[g, h, n, d]]

        for b, texts in steps(batches):
            own = np.array([groups.setdefault(x, len(groups)) for x in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)], np.int64)
            distinct, row, code, times = _entries(b, texts)
            # two terms of a text with one digest count as two texts here: too many, never too few; split later
            (g, h), (n, d) = _merged([own[row], digests(distinct, config.bits)[code]], [times.astype(np.int64), np.ones(len(row), np.int64)])
            held.append([g, h, n, d])
            if sum(len(x[0]) for x in held) > _HELD:
                merge()
                if len(held[0][0]) > _HELD // 2:
                    yield out()
                    held.clear()
        if held:
            merge()
            yield out()

    found = docs.select("lang", "source", "text").mapInArrow(tidy(run), "lang string, source string, h long, n long, d long")
    return found.groupBy("lang", "source", "h").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _strings(docs: DataFrame, config: DivergenceConfig) -> DataFrame:
    """(h, term): each task's distinct terms with their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.BinaryArray] = []
        for _, texts in steps(batches):
            held.append(terms(texts)[0].unique())
            if sum(len(x) for x in held) > _HELD:
                held[:] = [pa.concat_arrays(held).unique()]
                if len(held[0]) > _HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(digests(held[0], config.bits)), held[0].cast(pa.string())], ["h", "term"])
                    held.clear()
        if held:
            own = pa.concat_arrays(held).unique()
            yield pa.RecordBatch.from_arrays([pa.array(digests(own, config.bits)), own.cast(pa.string())], ["h", "term"])

    return docs.select("text").mapInArrow(tidy(run), "h long, term string")


def _split_counts(docs: DataFrame, split: DataFrame, config: DivergenceConfig) -> DataFrame:
    """(lang, source, h, term, n, d) of the terms with a digest of split (h), each under its own string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in steps(batches):
            distinct, row, code, times = _entries(b, texts)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("lang").take(at), b.column("source").take(at), pa.array(digests(distinct, config.bits)[code]), distinct.cast(pa.string()).take(pa.array(code)), pa.array(times.astype(np.int64))], ["lang", "source", "h", "term", "n"])

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, h long, term string, n long")
    return found.join(small(split, split.count()), "h", "left_semi").groupBy("lang", "source", "h", "term").agg(F.sum("n").alias("n"), F.count("*").alias("d"))


def _share(count: Column, total: Column, config: DivergenceConfig) -> Column:
    """1 + floor(scale * (count + smoothing) / total), in whole numbers of any size."""
    x = ((count + config.smoothing).cast("decimal(28,0)") * F.lit(config.scale).cast("decimal(10,0)")).alias("x")
    return (F.call_function("div", x, total.cast("decimal(28,0)")) + 1).cast("long")


def audit(docs: DataFrame, config: DivergenceConfig = DivergenceConfig()) -> DataFrame:
    """(lang, source, part, item, value, rank) over docs (text, lang, source; other columns are ignored).

    Nulls of the three count as ''. A lang keeps the V terms that stand in at least least_texts of its texts. A group
    (lang, source), and a lang, gives each kept term the share p = 1 + floor(scale * (count + smoothing) / (N + smoothing
    * V)) with N its occurrences of kept terms. Part pair: each other source of the lang with the sum of |p - p'| over the
    kept terms, 0 without any. Part term: the group's terms with p above the lang's p, with the difference, of each group
    the first `top`. Ranks go by value, the largest first, then by item in bytes. Repeated rows each count; an empty table
    gives no rows, and neither does a lang's only group without terms.
    """
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    lean(docs.sparkSession)
    counts = written(term_counts(own, config), "counts")
    kept = written(counts.groupBy("lang", "h").agg(F.sum("d").alias("d")).where(F.col("d") >= config.least_texts).select("lang", "h"), "kept")
    wanted = written(kept.select("h").distinct(), "wanted")
    strings = _strings(own, config).join(small(wanted, wanted.count()), "h", "left_semi")
    strings = written(strings.groupBy("h").agg(F.min("term").alias("term"), F.max("term").alias("last")), "strings")
    dropped(wanted)
    split = written(strings.where("term <> last").select("h"), "split")
    clean = written(kept.join(small(split, split.count()), "h", "left_anti"), "clean")
    # of a split digest the term's own string is kept with the counts
    known = counts.join(small(clean, clean.count()), ["lang", "h"]).select("lang", "source", "h", F.lit("").alias("own"), "n")
    if split.take(1):
        again = written(_split_counts(own, split, config), "again")
        enough = again.groupBy("lang", "h", "term").agg(F.sum("d").alias("d")).where(F.col("d") >= config.least_texts).drop("d")
        known = known.unionByName(again.join(enough, ["lang", "h", "term"]).select("lang", "source", "h", F.col("term").alias("own"), "n"))
    known = written(known, "known")
    in_lang = written(known.groupBy("lang", "h", "own").agg(F.sum("n").alias("all_n")), "in_lang")
    of_lang = in_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("all_total"))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = written(groups.na.fill(0, ["total", "v", "all_total"]).withColumn("total", F.col("total") + config.smoothing * F.col("v")).withColumn("all_total", F.col("all_total") + config.smoothing * F.col("v")), "groups")
    n_groups = groups.count()
    shares = known.join(small(groups, n_groups), ["lang", "source"])
    shares = written(shares.select("lang", "source", "h", "own", _share(F.col("n"), F.col("total"), config).alias("p")), "shares")
    return _pairs(shares, groups, n_groups, config).unionByName(_tops(shares, groups, in_lang, strings, config))


def _tops(shares: DataFrame, groups: DataFrame, in_lang: DataFrame, strings: DataFrame, config: DivergenceConfig) -> DataFrame:
    of_lang = groups.groupBy("lang").agg(F.first("all_total").alias("all_total"))
    q = in_lang.join(of_lang, "lang").select("lang", "h", "own", _share(F.col("all_n"), F.col("all_total"), config).alias("q"))
    over = shares.join(q, ["lang", "h", "own"]).where("p > q").select("lang", "source", "h", "own", (F.col("p") - F.col("q")).alias("value"))
    # ties at the last rank all stay until their strings decide; a group's terms are dealt into parts first
    by = "(partition by lang, source{part} order by value desc)"
    some = over.withColumn("part", F.pmod(F.xxhash64("h", "own"), F.lit(16))).withColumn("r", F.expr(f"rank() over {by.format(part=', part')}")).where(F.col("r") <= config.top)
    some = some.withColumn("r", F.expr(f"rank() over {by.format(part='')}")).where(F.col("r") <= config.top)
    text = some.join(strings.select("h", "term"), "h").withColumn("item", F.when(F.col("own") == "", F.col("term")).otherwise(F.col("own")))
    ranked = text.withColumn("rank", F.expr("row_number() over (partition by lang, source order by value desc, item)"))
    return ranked.where(F.col("rank") <= config.top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pairs(shares: DataFrame, groups: DataFrame, n_groups: int, config: DivergenceConfig) -> DataFrame:
    size = config.sources
    numbered = groups.withColumn("k", F.expr("row_number() over (partition by lang order by source) - 1"))
    tiles = F.ceil(F.expr("count(*) over (partition by lang)") / size).cast("int")
    zero = F.when(F.col("v") > 0, _share(F.lit(0), F.greatest(F.col("total"), F.lit(1)), config)).otherwise(0)
    numbered = written(numbered.withColumns({"tiles": tiles, "zero": zero, "parts": F.greatest(F.lit(1), F.ceil(F.col("v") / config.terms)).cast("int")}).select("lang", "source", "k", "tiles", "zero", "parts", "v"), "numbered")
    block = F.floor(F.col("k") / size).cast("int")

    def spread(rows: DataFrame) -> DataFrame:
        """A row for each tile that its source stands in, as one of the first side and as one of the second."""
        kinds = [(block, F.col("other"), 0, F.sequence(block, F.col("tiles") - 1)), (F.col("other"), block, 1, F.sequence(F.lit(0), block))]
        out = [rows.withColumn("other", F.explode(which)).select("lang", "part", i.alias("i"), j.alias("j"), F.lit(side).alias("side"), "k", "h", "own", "p") for i, j, side, which in kinds]
        return out[0].unionByName(out[1])

    part = F.pmod(F.xxhash64("h", "own"), F.col("parts")).cast("int")
    entries = shares.join(small(numbered, n_groups), ["lang", "source"]).withColumn("part", part)
    # a group's share of a term that it doesn't have, for each part of the terms
    bare = numbered.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("lang", "part", "k", "tiles", F.lit(0).cast("long").alias("h"), F.lit(None).cast("string").alias("own"), F.col("zero").alias("p"))
    rows = spread(entries.select("lang", "part", "k", "tiles", "h", "own", "p")).unionByName(spread(bare))

    def tile(t: pa.Table) -> pa.Table:
        side, k, h, p = (t.column(c).to_numpy() for c in ("side", "k", "h", "p"))
        own = t.column("own").combine_chunks().dictionary_encode()
        code = own.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        term = code >= 0
        _, at = np.unique(np.stack([h, code])[:, term], axis=1, return_inverse=True)
        at = at.ravel()
        n = int(at.max()) + 1 if len(at) else 0
        held = []
        for one in (0, 1):
            base = np.flatnonzero((side == one) & ~term)
            base = base[np.argsort(k[base])]
            grid = np.repeat(p[base][:, None], n, 1)
            mine = side[term] == one
            grid[np.searchsorted(k[base], k[term][mine]), at[mine]] = p[term][mine]
            held.append((k[base], grid))
        (ka, a), (kb, b) = held
        total = np.zeros((len(ka), len(kb)), np.int64)
        for x in range(len(ka)):
            for y in range(0, len(kb), 64):
                total[x, y : y + 64] = np.abs(a[x][None, :] - b[y : y + 64]).sum(1)
        lang = pa.array([t.column("lang")[0].as_py()] * total.size, pa.string())
        return pa.table({"lang": lang, "a": np.repeat(ka, len(kb)), "b": np.tile(kb, len(ka)), "total": total.ravel(), "met": np.full(total.size, n, np.int64)})

    kinds = "lang string, a int, b int, total long, met long"
    sums = rows.groupBy("lang", "part", "i", "j").applyInArrow(tile, kinds).where("a < b").groupBy("lang", "a", "b").agg(F.sum("total").alias("total"), F.sum("met").alias("met"))
    of = lambda c: numbered.select("lang", F.col("k").alias(c), F.col("source").alias(f"source_{c}"), F.col("zero").alias(f"zero_{c}"), *(["v"] if c == "a" else []))
    named = sums.join(small(of("a"), n_groups), ["lang", "a"]).join(small(of("b"), n_groups), ["lang", "b"])
    value = F.col("total") + (F.col("v") - F.col("met")) * F.abs(F.col("zero_a") - F.col("zero_b"))
    both = named.select("lang", "source_a", "source_b", value.alias("value"))
    each = both.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").unionByName(both.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), "value"))
    rank = F.expr("row_number() over (partition by lang, source order by value desc, item)")
    return each.withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = f"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') t from documents),
w as (select id, lang, source, unnest(regexp_extract_all(translate(t, '{_UPPER}', '{_SMALL}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
c as (select id, lang, source, term, count(*)::hugeint n from w group by all),
k as (select lang, term from c group by all having count(*) >= 30),
v as (select lang, count(*)::hugeint v from k group by all),
g as (select distinct lang, source from d),
x as (select lang, source, term, sum(n)::hugeint n from c join k using (lang, term) group by all),
gn as (select g.lang, g.source, coalesce((select sum(n) from x where x.lang = g.lang and x.source = g.source), 0)::hugeint total from g),
p as (select gn.lang, gn.source, k.term, coalesce(x.n, 0)::hugeint n, 1 + (1000000000::hugeint * (coalesce(x.n, 0)::hugeint + 5)) // (gn.total + 5 * v.v) p
  from gn join k using (lang) join v using (lang) left join x on x.lang = gn.lang and x.source = gn.source and x.term = k.term),
ln as (select lang, sum(n)::hugeint total from x group by all),
q as (select x.lang, x.term, 1 + (1000000000::hugeint * (sum(x.n)::hugeint + 5)) // (any_value(ln.total) + 5 * any_value(v.v)) q from x join ln using (lang) join v using (lang) group by all),
pair as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(pair.f, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
tops as (select lang, source, 'term' part, term item, (p - q)::bigint as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int rank from (select * from pairs union all select * from tops))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 50
"""
