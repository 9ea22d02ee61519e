"""Sources that change: a folder whose new, changed and deleted files are followed by a node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.builder import Fixup, Rules, shredded
from ..sources.content import Adapter

_SEEN = "silo_id string, modified timestamp, length long, gone boolean, batch int"


def files(spark: SparkSession, folder: str) -> DataFrame:
    """silo_id, name, modified, length, content of each file; dot-files are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return found.where(~name.startswith(".")).select(F.col("path").alias("silo_id"), F.col("path").alias("name"), F.col("modificationTime").alias("modified"), "length", "content")


def _manifest(spark: SparkSession, nodes: str) -> DataFrame:
    """The last that is known of each file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{nodes}/seen")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _SEEN)
    every = spark.read.schema(_SEEN).parquet(f"{nodes}/seen")
    return every.groupBy("silo_id").agg(F.max_by(F.struct("modified", "length", "gone", "batch"), "batch").alias("s")).select("silo_id", "s.*")


def refreshed(spark: SparkSession, folder: str, nodes: str, rules: Rules | None = None, adapters: tuple[Adapter, ...] = (), fixups: tuple[Fixup, ...] = ()) -> int:
    """Shreds what is new or changed since the last call, and notes what is gone; says how many files that were.

    Files are told by path, time and length, so unchanged ones aren't read. Nodes go to a folder of
    the batch first and the manifest last, so a call that fails is repeated as a whole.
    """
    seen, now = _manifest(spark, nodes), files(spark, folder)
    batch = (seen.agg(F.max("batch")).first()[0] or 0) + 1
    known = seen.where("not gone").select("silo_id", F.col("modified").alias("m"), F.col("length").alias("l"))
    fresh = now.join(known, (now["silo_id"] == known["silo_id"]) & (F.col("modified") == F.col("m")) & (F.col("length") == F.col("l")), "left_anti")
    gone = known.join(now.select("silo_id"), "silo_id", "left_anti").select("silo_id", F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("long").alias("length"), F.lit(True).alias("gone"))
    noted = fresh.select("silo_id", "modified", "length", F.lit(False).alias("gone")).unionByName(gone).withColumn("batch", F.lit(batch)).persist()
    n = noted.count()
    if n:
        chosen = noted.where("not gone").select(F.col("silo_id").alias("of"), F.col("modified").alias("m"))
        shredded(now.join(chosen, (now["silo_id"] == F.col("of")) & (now["modified"] == F.col("m")), "left_semi"), rules, adapters, fixups).write.mode("overwrite").parquet(f"{nodes}/nodes/batch={batch}")
        noted.write.mode("append").parquet(f"{nodes}/seen")
    noted.unpersist()
    return n


def watch(spark: SparkSession, folder: str, nodes: str, state: str, every: str = "5 seconds", rules: Rules | None = None, adapters: tuple[Adapter, ...] = (), fixups: tuple[Fixup, ...] = ()) -> StreamingQuery:
    """Keeps the node table up with the folder until the query is stopped, looking at it that often."""

    def look(_: DataFrame, __: int) -> None:
        refreshed(spark, folder, nodes, rules, adapters, fixups)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(look).option("checkpointLocation", state).trigger(processingTime=every).start()


def latest(spark: SparkSession, nodes: str) -> DataFrame:
    """The nodes of each file as it was last, without files that are gone."""
    last = _manifest(spark, nodes).where("not gone").select(F.col("silo_id").alias("__silo"), F.col("batch").alias("__last"))
    rows = spark.read.parquet(f"{nodes}/nodes")
    return rows.join(last, (F.col("silo_id") == F.col("__silo")) & (F.col("batch") == F.col("__last")), "left_semi").drop("batch")
