"""J23 as new commit logs arrive: daily counts that never go down.

A scan reports whole-history counts per day, and the larger of two reports counts.
Maximum is order-free and repeatable, so the stream only appends what each batch
saw and readers take the maximum: a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contributions import repo_daily
from ..sources.history import COMMIT_MARK, parse_log

BLOCKS = "value string"


def log_stream(spark: SparkSession, folder: str, mark: str = COMMIT_MARK) -> DataFrame:
    """Commit blocks of log files as they appear in a folder."""
    return (
        spark.readStream.schema(BLOCKS)
        .option("lineSep", mark + "\n")
        .text(folder)
        .select(
            F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.log$", 1).alias("repo_id"),
            F.lit(0).cast("long").alias("seq"),
            "value",
        )
    )


def append_daily(blocks: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the daily counts of each batch; `checkpoint` belongs in shared storage."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = repo_daily(parse_log(batch)).withColumn("batch", F.lit(batch_id))
        counts.write.mode("overwrite").partitionBy("batch").option(
            "partitionOverwriteMode", "dynamic"
        ).parquet(target)

    return (
        blocks.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_daily(spark: SparkSession, target: str) -> DataFrame:
    """Largest reported count per repository and day."""
    return spark.read.parquet(target).groupBy("repo_id", "commit_date").agg(
        F.max("commit_count").alias("commit_count")
    )
