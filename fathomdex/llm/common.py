"""What several operators share: working tables, skew-safe lookups, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomdex.session import BATCH_BYTES, bound_batches

#: A key with at least this share of all rows is hot; so there are at most so many hot keys.
MOST_HOT_KEYS = 10_000
#: A table of at most so many narrow rows is broadcast whole.
MOST_BROADCAST = 100_000
_made: dict[str, list[str]] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. In local mode, where all tasks share one
    machine, a folder of our own if none is named; on a cluster that is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not (found := spark.sparkContext.getCheckpointDir()):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fathomdex-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: later stages start from
    files that no executor's loss takes away."""
    spark = df.sparkSession
    path = f"{work_dir(spark).rstrip('/')}/fathomdex-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_tables = (path,)
    return out


def made_so_far(spark: SparkSession) -> int:
    """How many working tables there are."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def drop_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes the working tables made since made_so_far gave mark, but for those behind keep.

    Call it when all that reads them has been written itself: later stages, and what is
    computed anew after an executor's loss, start from the tables that are kept.
    """
    kept = {path for df in keep for path in df.work_tables}
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    _delete(spark, [path for path in made[mark:] if path not in kept])
    made[mark:] = [path for path in made[mark:] if path in kept]


def drop_tables(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes these working tables, which nothing reads any more."""
    gone = {path for df in tables for path in df.work_tables}
    _delete(spark, sorted(gone))
    _made[spark.sparkContext.applicationId] = [path for path in _made.get(spark.sparkContext.applicationId, []) if path not in gone]


def drop_work_tables(spark: SparkSession) -> None:
    """Deletes the tables that `materialize` has written in this application. Results that
    haven't been written or collected yet read them, so call this last."""
    _delete(spark, _made.pop(spark.sparkContext.applicationId, []))


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done, which it does once the driver
    has collected its garbage. A large job on a driver that seldom does keeps them all."""
    spark.range(1).collect()  # Spark holds on to the last query
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_batches(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """df.mapInPandas(f, schema) by batches of few bytes, which JVM and Python hold several times
    over. Workers live on idle, so a task gives back what it took."""
    bound_batches(df.sparkSession)
    return df.mapInPandas(partial(_giving_back, f), schema)


def _giving_back(f: Callable, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        yield from f(batches)
    finally:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, which the allocators of Arrow and C would keep."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def numbered_columns(docs: DataFrame) -> DataFrame:
    """docs with its columns called c0, c1, ... so that none is called like one of an operator's own."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def named_again(docs: DataFrame) -> list[Column]:
    """The columns of numbered_columns(docs) under the names they have in docs."""
    return [F.col(f"c{k}").alias(name) for k, name in enumerate(docs.columns)]


def doc_crc(col: str = "doc_id") -> Column:
    """crc32 of the id written as text; that of empty text where the id is null."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, keys: int | None = None) -> DataFrame:
    """rows inner-joined with table on key, whatever the skew. table has one narrow row for
    each key, and weight says how many of the rows have it; keys is the number of its rows,
    where it is known.

    A table of at most MOST_BROADCAST rows is broadcast. Of a larger one, keys with a ten-thousandth of all rows or more number ten thousand at most, so their
    part of the table is broadcast; every other key is small enough for a shuffled join,
    which is asked for.
    """
    if keys is not None and keys <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), key)
    least = max(2, -(-total // MOST_HOT_KEYS))
    hot = rows.join(F.broadcast(table.filter(F.col(weight) >= least)), key)
    cold = rows.join(F.broadcast(table.filter(F.col(weight) >= least).select(key)), key, "left_anti")
    return hot.unionByName(cold.join(table.filter(F.col(weight) < least).hint("merge"), key))


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node it is linked with.

    Each round hangs a node and its smaller neighbours under the smallest of them, then
    skips one level, so chains halve and stars are done at once. Up to MOST_BROADCAST nodes
    are broadcast; beyond, both joins go through `lookup`, so a node with very many
    neighbours or children doesn't meet in one task either.
    Every round is written to the shared folder; only counts reach the driver.
    """
    spark = edges.sparkSession
    mark = made_so_far(spark)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.select(low.alias("a"), high.alias("b")).filter("a < b").distinct(), f"{name}-edges")
    for _ in range(most_rounds):
        parent = materialize(now.groupBy("b").agg(F.min("a").alias("p"), F.count(F.lit(1)).alias("n")), f"{name}-parents")
        nodes, total = parent.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        above = parent.select(F.col("b").alias("p"), F.col("p").alias("q"))
        if nodes <= MOST_BROADCAST:
            tree = parent.join(F.broadcast(above), "p", "left")
        else:
            above = parent.groupBy("p").agg(F.count(F.lit(1)).alias("children")).join(above.hint("merge"), "p", "left")
            tree = lookup(parent, materialize(above, f"{name}-above"), "p", "children", nodes)
        tree = tree.select(F.coalesce("q", "p").alias("a"), "b", F.col("q").isNotNull().alias("moved"))
        rest = lookup(now.select("a", "b"), parent.filter("n > 1"), "b", "n", total, nodes).filter("a > p").select(F.col("p").alias("a"), F.col("a").alias("b"), F.lit(True).alias("moved"))
        then = tree.unionByName(rest).groupBy("a", "b").agg(F.max("moved").alias("moved"))
        now = materialize(then, f"{name}-round")
        drop_since(spark, mark, now)
        if not now.filter("moved").head(1):
            break
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    out = now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
    out.work_tables = now.work_tables
    return out
