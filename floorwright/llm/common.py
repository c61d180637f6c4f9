"""What the operators of this subpackage share: scratch tables and size-checked joins."""

from __future__ import annotations

import ctypes
import functools
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has been counted and has at most so many rows of a few numbers.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset and all run on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="floorwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def lean(spark: SparkSession) -> None:
    """Batches of at most 1000 rows between the JVM and Python workers: rows are whole texts or sets, and the default of 10,000
    of them is held several times over on both sides. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > 1000:
        spark.conf.set(name, "1000")


def give_back() -> None:
    """Hands memory that Arrow and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What a worker keeps from task to task, by module: a function that drops it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, drop: Callable[[], None]) -> None:
    """Says that this worker keeps something of a module (tables, caches), and how it is dropped when it turns to another."""
    _kept[module] = drop


def turns_to(module: str) -> None:
    """Drops what the worker keeps of other modules."""
    others = [m for m in _kept if m != module]
    for m in others:
        _kept.pop(m)()
    if others:
        give_back()


def tidy(run: Callable) -> Callable:
    """run, a function of mapInArrow, but what its task took goes back to the system when it ends: workers are used again by
    other stages, and each would keep the most that any of its tasks ever took."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns_to(run.__module__)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def tidy_group(make: Callable) -> Callable:
    """The same for a function of applyInArrow."""

    @functools.wraps(make)
    def tidied(group: pa.Table) -> pa.Table:
        turns_to(make.__module__)
        out = make(group)
        del group
        give_back()
        return out

    return tidied


def bounded(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most so many of the distinct rows: those whose hash `key` is least. Only hashes are sorted and only one number reaches the driver."""
    own = rows.withColumn("_key", key)
    last = own.select("_key").distinct().orderBy("_key").limit(most).agg(F.max("_key")).first()[0]
    return own.where(F.col("_key") <= F.lit(last)).dropDuplicates(["_key"]).drop("_key")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/floorwright/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the table that written() made; only once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the limit, else as it is (a shuffle join)."""
    return F.broadcast(df) if rows <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no column of it, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_one_task(rows: DataFrame, make: Callable[..., Any]) -> Any:
    """What make() gives for the columns of rows, as lists: computed by one task on an executor, so that a sample of bounded
    rows never passes the driver; only the result (a model) comes back. None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            columns = [[x for b in held for x in b.column(k).to_pylist()] for k in range(held[0].num_columns)]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(*columns))], pa.binary())], ["made"])

    found = rows.repartition(1).mapInArrow(tidy(run), "made binary").collect()
    return pickle.loads(found[0].made) if found else None
