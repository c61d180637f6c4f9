"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

An item of m distinct shingles is contained in a document if at least need(m) = ceil(.75 m) of them are in it. Items are
partitioned by size, a partition for each power of two of m. A partition has its own signature length k: the signatures of
its items are their k smallest shingle hashes (bottom-k MinHash), with the largest m - need(m) + 1 of its items as k, the
least length for which no document that contains an item can miss all of its signature. A document is probed with all its
shingles, so a short item is found anywhere inside a long text, and only in the partitions that it can fill: those whose
least need is at most the document's own number of shingles (a document of several rows in all of them). What the signatures find is then counted over whole sets.

The document side is never shuffled: it meets the signatures in a broadcast join if these have been counted and are small,
and in a shuffle join on the hash else, with each document's rows dealt into parts so that a very common hash isn't one
task. Only hits move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.common import BROADCAST_ROWS, small, table, written

WIDTH, PERCENT = 5, 75
#: Parts of a hash in a shuffle join.
PARTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: runs of anything but space and 0x09-0x0D, A-Z lower-cased; null and empty texts have none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingle_hashes(own: Column, width: int = WIDTH) -> Column:
    """Hashes of all runs of width words; with fewer words one hash of the whole sequence, without words none."""
    rolled = F.transform(F.sequence(F.lit(0), F.size(own) - width), lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(width)]))
    return F.when(F.size(own) >= width, rolled).when(F.size(own) > 0, F.array(F.xxhash64(F.concat_ws(" ", own), F.lit("whole")))).otherwise(F.array().cast("array<bigint>"))


def _shingles(df: DataFrame, key: str, width: int) -> DataFrame:
    """(key, h): a row for each shingle, repeats included. A null key is passed over."""
    own = df.select(F.col(key).cast("long").alias(key), words(F.col("text")).alias("w")).where(F.col(key).isNotNull())
    return own.select(key, F.explode(shingle_hashes(F.col("w"), width)).alias("h"))


def _need(m: Column, percent: int) -> Column:
    return F.ceil(m * percent / 100).cast("int")


def containment(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, overlap, item_shingles): documents that hold at least percent % of an item's distinct shingles.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Texts are whole. Null and empty texts and null
    ids match nothing; rows that repeat an id count as one text each way: an item's shingles are those of all its rows,
    and a document's hits are those of all its rows. Items of fewer than width words match texts that are the same words.
    """
    own = _shingles(items, "item_id", width).distinct()
    sizes = own.groupBy("item_id").agg(F.count("*").alias("m"))
    sizes = sizes.withColumns({"need": _need(F.col("m"), percent), "band": F.floor(F.log2("m")).cast("int")})
    bands = sizes.groupBy("band").agg(F.max(F.col("m") - F.col("need") + 1).alias("k"), F.min("need").alias("least"))
    ranked = own.join(sizes.join(F.broadcast(bands), "band"), "item_id")  # at most 63 bands
    ranked = ranked.withColumn("rank", F.expr("row_number() over (partition by item_id order by h)"))
    index = written(ranked.select("item_id", "h", "m", "need", "least", (F.col("rank") <= F.col("k")).alias("signed")), "items")
    # a hash of several partitions stands for the one that the smallest document can fill
    signatures = index.where("signed").groupBy("h").agg(F.min("least").alias("least"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    split = _with_fill(texts.select("doc_id", words(F.col("text")).alias("w")), width)
    probes = split.select("doc_id", "n", F.explode(shingle_hashes(F.col("w"), width)).alias("h"))
    hits = written(_met(probes, signatures).where("n is null or least <= n").select("doc_id").distinct(), "hits")
    # only these documents are read again, for the exact count over whole sets
    again = texts.join(small(hits, hits.count()), "doc_id", "left_semi")
    exact = _met(_shingles(again, "doc_id", width).distinct(), index.select("item_id", "h", "need", "m", "signed"))
    counted = exact.groupBy("doc_id", "item_id").agg(F.count("*").alias("overlap"), F.first("m").alias("item_shingles"), F.first("need").alias("need"), F.max("signed").alias("signed"))
    return counted.where("signed and overlap >= need").select("doc_id", "item_id", "overlap", "item_shingles")


def _with_fill(split: DataFrame, width: int) -> DataFrame:
    """split (doc_id, w) with n, the most shingles that the document can have; null where its doc_id stands in several rows,
    so that it is probed in all partitions. Only ids are shuffled; with very many such ids n is null everywhere."""
    again = written(split.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    rows = again.count()
    n = F.greatest(F.size("w") - (width - 1), F.lit(1))
    if rows > BROADCAST_ROWS:
        return split.withColumn("n", F.lit(None).cast("int"))
    if rows:
        split = split.join(F.broadcast(again.withColumn("again", F.lit(True))), "doc_id", "left")
        n = F.when(F.col("again").isNull(), n)
    return split.select("doc_id", "w", n.alias("n"))


def _met(probes: DataFrame, index: DataFrame) -> DataFrame:
    """probes joined with index on h: broadcast if the counted index is small, else by h and a part of the documents."""
    rows = index.count()
    if rows <= BROADCAST_ROWS:
        return probes.join(F.broadcast(index), "h")
    dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return probes.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).join(dealt, ["h", "part"]).drop("part")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SHINGLES = f"""
select {{key}}, w, len(w) n from (
  select {{key}}, list_filter(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w
  from {{table}} where text is not null and {{key}} is not null)"""

_EXPLODED = """
select distinct {key}, unnest(case when n >= 5 then list_transform(range(1, n - 3), lambda i: array_to_string(w[i:i+4], ' ')) when n > 0 then ['whole ' || array_to_string(w, ' ')] else [] end) s
from ({own})"""

ORACLE = f"""
with i as ({_EXPLODED.format(key="item_id", own=_SHINGLES.format(key="item_id", table="benchmark"))}),
m as (select item_id, count(*) item_shingles from i group by item_id),
d as ({_EXPLODED.format(key="doc_id", own=_SHINGLES.format(key="doc_id", table="documents"))}),
o as (select doc_id, item_id, count(*) overlap from d join i using (s) group by doc_id, item_id)
select doc_id, item_id, overlap, item_shingles from o join m using (item_id) where 100 * overlap >= 75 * item_shingles
"""
