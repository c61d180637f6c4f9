"""Structured Streaming forms: running confusion matrix, log tail and best-so-far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from floorwright.functions.taxonomy import IGNORE
from floorwright.operators import metrics
from floorwright.sources.readers import LOG


def confusion(stream: DataFrame) -> DataFrame:
    """(target, pred, n) of a stream of (target, pred); state is at most the square of the classes."""
    return stream.where(F.col("target").isNotNull() & (F.col("target") != IGNORE)).groupBy("target", "pred").agg(F.count("*").alias("n"))


def running_summary(stream: DataFrame, classes: int, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of that name with the summary after each batch."""

    def each(batch: DataFrame, _: int) -> None:
        metrics.summary(metrics.per_class(batch, classes)).createOrReplaceGlobalTempView(name)

    return confusion(stream).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each).start()


def log_tail(spark: SparkSession, path: str) -> DataFrame:
    """A stream of log records as files arrive."""
    return spark.readStream.schema(LOG).json(path)


def best_so_far(log: DataFrame) -> DataFrame:
    """The best evaluation so far: the largest mIoU, of equals the earliest (update or complete mode)."""
    b = F.max(F.struct(F.col("eval.mIoU").alias("miou"), (-F.col("iter")).alias("o"))).alias("b")
    return log.where("eval is not null").groupBy().agg(b).select((-F.col("b.o")).alias("iter"), F.col("b.miou").alias("miou"))


def best_by_run(log: DataFrame) -> DataFrame:
    """A stream of (run, iter, miou) as (run, iter, miou) of each run's best so far, a row when it gets better (update mode).

    The state of a run is its best alone, so a restart from the checkpoint goes on from there. Only what is strictly better
    counts; of equals within a batch the earliest. Nulls are passed over.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else None
        best = before
        for pdf in parts:
            for it, miou in pdf.dropna().sort_values(["miou", "iter"], ascending=[False, True]).head(1)[["iter", "miou"]].itertuples(index=False):
                if best is None or miou > best[1] or best != before and miou == best[1] and it < best[0]:
                    best = (int(it), float(miou))
        if best != before:
            state.update(best)
            yield pd.DataFrame({"run": [key[0]], "iter": [best[0]], "miou": [best[1]]})

    own = log.where("run is not null").select(F.col("run").cast("long").alias("run"), F.col("iter").cast("long").alias("iter"), F.col("miou").cast("double").alias("miou"))
    return own.groupBy("run").applyInPandasWithState(update, "run long, iter long, miou double", "iter long, miou double", "update", GroupStateTimeout.NoTimeout)


def append_log(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends records as JSON lines, each once (the sink's own log of files). once: only what is there now."""
    out = stream.writeStream.outputMode("append").format("json").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
