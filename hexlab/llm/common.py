"""Helpers shared by the text operators: lineage cuts, bounded Arrow batches, components."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of whole documents that one Arrow batch may carry into Python.
BATCH_ROWS = 1000


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-hexlab-")


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a temporary one under a local master (tests)."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if not set_ and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (set_ or _own_folder()).rstrip("/")


#: Paths of tables written since ``collecting`` began, where it has.
_written: list[list[str]] = []


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in one folder for each value of ``by``, and read it back: later stages depend
    on files, not on executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=list(by) or None)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def collecting() -> Iterator[list[str]]:
    """Gives the list of the tables that are written inside, to be cleared once the result has been written."""
    _written.append([])
    try:
        yield _written[-1]
    finally:
        _written.pop()


def clear(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``cut`` has written; nothing may read them any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, so that Python memory does not follow the batch size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out round robin where ``df`` comes from fewer files than there are cores, as a file may hold one row
    group and give one task all the texts. Only the list of files is looked at, nothing is run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def bucket_of(key, bounds: list, low: int = 0):
    """Number of ``bounds`` (ascending) below ``key``, as a balanced tree of comparisons; null falls in 0."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(key > F.lit(bounds[mid]), bucket_of(key, bounds[mid + 1 :], low + mid + 1)).otherwise(
        bucket_of(key, bounds[:mid], low)
    )


#: Most bits of a map that is broadcast: 64 MB.
MAP_BITS = 29


def bitmap(keys: DataFrame, column: str, count: int) -> tuple[int, Broadcast]:
    """A broadcast bit map of 64-bit keys; at most 2**MAP_BITS bits, some 16 for each key below that. A filter only: it
    never misses a key, and lets more others pass the fuller it is."""
    bits = min(MAP_BITS, max(15, (16 * max(1, count)).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    found = keys.select((slot + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    whole = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in found:
        whole[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return bits, keys.sparkSession.sparkContext.broadcast(whole)


def listed(whole: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Numbers of the keys that the map may hold."""
    s = keys & ((1 << bits) - 1)
    return np.flatnonzero(whole[s >> 3] >> (s & 7).astype(np.uint8) & 1)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for every node, root the smallest reachable.

    Alternating large-star and small-star steps. Each step is a grouped minimum (combined before the
    shuffle, so a hub costs one row a task) and an equi-join that Spark may split where it is skewed.
    Lineage is cut after every round; the number of rounds is logarithmic in the longest chain.
    """
    e = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that the join stands on plain exchanges and a hub's rows can be split
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.*")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


__all__ = ["BATCH_ROWS", "F", "Window", "bitmap", "bucket_of", "clear", "collecting", "components", "cut", "listed", "partitions", "scratch", "small_batches", "spread", "table"]
