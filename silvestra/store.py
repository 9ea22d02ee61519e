"""Where intermediate tables go: the shared folder of the cluster."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
#: Collections of garbage before shuffle files count as gone.
_ROUNDS = 3


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one is set for a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="silvestra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, *by: str, codec: str = "snappy") -> str:
    """Writes the rows once to the shared folder, in folders by the columns given; returns where."""
    path = f"{shared_folder(df.sparkSession)}/silvestra-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.partitionBy(*by).option("compression", codec).parquet(path)
    return path


def written(df: DataFrame, *by: str, codec: str = "snappy") -> DataFrame:
    """The rows as a table written once, which cuts the lineage and outlives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, *by, codec=codec))


def deleted(spark: SparkSession, path: str) -> bool:
    """Deletes what was written there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if path in _WRITTEN:
        _WRITTEN.remove(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cleared(spark: SparkSession) -> int:
    """Deletes all tables that this process has written so, for when no result that reads them is needed; says how many."""
    return sum(deleted(spark, path) for path in list(_WRITTEN))


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to, which it does when the driver collects garbage.

    Listeners may still hold the last plan, and what is found is deleted by a thread of its own, so it takes rounds.
    """
    for _ in range(_ROUNDS):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
