"""Tables written to the shared checkpoint folder, to cut the lineage of iterative jobs."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-hexlab-")


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where that is unset, a temporary one under a local master (tests)."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if not set_ and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (set_ or _own_folder()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out round robin where ``df`` comes from fewer files than there are cores, as a file may hold one row
    group and give one task all the rows. Only the list of files is looked at, nothing is run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)
