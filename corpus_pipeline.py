"""From raw documents to piece ids: toxic ones go, of near duplicates one stays, benchmark text goes, the rest is encoded.

Every stage takes a table with doc_id and text and whatever other columns it has, and gives back the same columns (the last
adds piece_ids and n_pieces, and replaces columns of these names). A row's identity is its doc_id with its text: rows that
repeat a doc_id with another text are documents of their own, in every stage. Null and empty texts are clean, link with
nothing, hold no benchmark item and have no pieces; they stay, each distinct row once. A null doc_id is one like any other,
but goes last where the least doc_id is chosen. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.common import dropped, small, table, written
from floorwright.llm.decontamination import containment
from floorwright.llm.ngram_join import ngram_components
from floorwright.llm.sentencepiece import encode_documents
from floorwright.llm.toxicity import fit_from_tables, score_documents


def _key() -> Column:
    """A row's identity as one number: its doc_id with its text (two of 10^9 rows meet by chance once in about 40 tables)."""
    return F.xxhash64(F.col("doc_id").cast("string"), "text")


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the compression-distance classifier scores at 0.5 or more; without labels none is rejected."""
    score = _unused(docs, "toxic_score")
    model = fit_from_tables(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle overlap the one with the least doc_id stays (ties: the least identity).

    Rows that repeat both doc_id and text are one document; of their other columns the least values stay.
    """
    key = _unused(docs, "key")
    keyed = docs.select(_key().alias("doc_id"), "text")
    groups = written(ngram_components(keyed).select(F.col("doc_id").alias(key), "component_id"), "groups")
    ids = docs.select(_key().alias(key), F.col("doc_id").cast("long").alias("id"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", key)
    first = groups.groupBy(key).agg(F.first("component_id").alias("component_id")).where(f"{key} <> component_id")
    linked = first.select("component_id").distinct()
    members = groups.join(small(linked, linked.count()), "component_id", "left_semi").distinct().join(ids, key)
    least = members.groupBy("component_id").agg(F.min(order)[key].alias("stays"))
    gone = written(members.join(least, "component_id").where(F.col(key) != F.col("stays")).select(key).distinct(), "copies")
    again = written(groups.groupBy(key).count().where("count > 1").select(key), "repeated")
    own = docs.withColumn(key, _key()).join(small(gone, gone.count()), key, "left_anti")
    again = small(again, again.count())
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = own.join(again, key, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias(key), *others)).alias(key))
    once = once.select(*[F.col(f"{key}.{c}") if c in others else F.col(c) for c in docs.columns])
    return own.join(again, key, "left_anti").select(*docs.columns).unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    key = _unused(docs, "key")
    leaks = containment(docs.select(_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = written(leaks.select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return docs.withColumn(key, _key()).join(small(leaks, leaks.count()), key, "left_anti").select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids and how many these are."""
    own = [c for c in docs.columns if c not in ("piece_ids", "n_pieces")]
    return encode_documents(docs.select(*own)).select(*[c for c in own if c != "decoded"], "piece_ids", F.size("piece_ids").alias("n_pieces"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL can't express the classifier, the groups or the encoding; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's table goes when the next one's is written; the last is read by the result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
