"""W1, J3, J4, A13, A16 over stored facts: laid out by scan, so that they don't move again.

Facts are written in buckets of the scan id (each bucket by one task, sorted) inside folders of
ranges of scan ids. Joins and groupings by scan then read the buckets where they are: only the
other side is shuffled. Queries over the latest scans name the folders that hold one of them, and
Spark prunes the others before it reads.

A scan with a large part of all rows makes one bucket long, and a bucket isn't split. The
writer counts the buckets; where one is `HOT` times the mean, `read_laid_out` reads the same files
without the buckets, so that Spark splits them and aggregates before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import latest_scan_ids

RANGE = "scan_range"
HOT = 3
#: Rows of a bucket on the average, and folders of a table, at most.
BUCKET_ROWS, FOLDERS = 2_000_000, 1_000
#: Up to so many folders are named to Spark; a query that needs more reads the table as a whole.
NAMED = 10_000


def write_laid_out(facts: DataFrame, table: str, path: str, buckets: int, width: int = 1000, key: str = "scan_id") -> None:
    """Store facts as the external table `table` in shared storage; rows without a scan are left out.

    `buckets` should give files of some hundred megabytes; `width` ids share a folder. Both are the
    least there is: a bucket is one task when it is read, so there are more of them for more rows
    (`BUCKET_ROWS`), and folders are wider where ids span more than `FOLDERS` of them.
    """
    spark = facts.sparkSession
    held = facts.filter(F.col(key).isNotNull())
    count, low, high = held.agg(F.count("*"), F.min(key), F.max(key)).first()
    buckets = max(buckets, -(-count // BUCKET_ROWS))
    width = max(width, -(-(high - low + 1) // FOLDERS)) if count else width
    rows = held.withColumn(RANGE, F.floor(F.col(key) / width).cast("long"))
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    (
        rows.repartition(RANGE, bucket).write.mode("overwrite").partitionBy(RANGE)
        .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    )
    sizes = spark.read.schema(rows.schema).parquet(path).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    hot = largest is not None and largest > HOT * max(total / buckets, 1)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('hot' = '{str(hot).lower()}', 'width' = '{width}')")


def _property(spark: SparkSession, table: str, name: str) -> str:
    return spark.sql(f"SHOW TBLPROPERTIES {table} ('{name}')").first()["value"]


def read_laid_out(spark: SparkSession, table: str) -> DataFrame:
    """The stored facts, by buckets unless one is hot."""
    if _property(spark, table, "hot") == "false":
        return spark.table(table)
    path = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first()["data_type"]
    return spark.read.schema(spark.table(table).schema).parquet(path)


def of_scans(spark: SparkSession, table: str, ids: DataFrame, key: str = "scan_id") -> DataFrame:
    """Facts of the scans `ids` (one column `id`); folders without any of them aren't read."""
    facts = read_laid_out(spark, table)
    width = int(_property(spark, table, "width"))
    held = ids.select(F.floor(F.col("id") / width).cast("long").alias(RANGE)).distinct().limit(NAMED + 1).collect()
    if len(held) <= NAMED:
        facts = facts.filter(F.col(RANGE).isin([r[0] for r in held if r[0] is not None]))
    return facts.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_semi").drop(RANGE)


def of_latest_scans(spark: SparkSession, table: str, scans: DataFrame) -> DataFrame:
    """Facts of the latest completed scan of each repository."""
    return of_scans(spark, table, latest_scan_ids(scans))
