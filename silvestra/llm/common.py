"""What several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import stored, written as kept  # noqa: F401

#: Uncompressed bytes that one bucket of a packed exchange should hold.
BUCKET_BYTES = 24 << 20
#: Rows of a side that may be broadcast, when counted at 16 to 32 bytes a row.
BROADCAST_ROWS = 1_000_000


#: Rows of an Arrow batch between the JVM and Python; texts have kilobytes each.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data. Unless the session was started with a size of Arrow batches, it gets a small one, for less memory in a task."""
    if not spark.sparkContext.getConf().contains("spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; sizes the buckets of the exchanges."""
    return int(docs.select(F.sum(F.octet_length("text"))).first()[0] or 0)


def buckets_for(n_bytes: float) -> int:
    """How many buckets hold so many bytes: one each BUCKET_BYTES, a multiple of 4."""
    return max(4, -(-int(n_bytes / BUCKET_BYTES) // 4) * 4)
