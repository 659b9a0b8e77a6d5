"""Configuration rows, fact tables and their writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import strip


def pdn_types(spark: SparkSession, items: list) -> DataFrame:
    """Configured personal-data types to (pdn_type, identifier) rows.

    Items without a name or without a list of identifiers are dropped.
    """
    usable = [
        (str(i["name"]), [str(x) for x in i["identifiers"] if x])
        for i in items
        if isinstance(i, dict) and i.get("name") and isinstance(i.get("identifiers"), list)
    ]
    raw = spark.createDataFrame(usable, "name string, identifiers array<string>")
    return explode_types(raw)


def explode_types(raw: DataFrame) -> DataFrame:
    """(name, identifiers[]) to trimmed, non-empty (pdn_type, identifier) rows."""
    return (
        raw.filter(F.coalesce(F.col("name"), F.lit("")) != "")
        .select(strip(F.col("name")).alias("pdn_type"), F.explode("identifiers").alias("i"))
        .select("pdn_type", strip(F.col("i")).alias("identifier"))
        .filter(F.col("identifier") != "")
    )


def table_scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """S6."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def append_facts(
    rows: DataFrame, target: str, key: str = "scan_id", bucket: int = 1000, scans: DataFrame | None = None
) -> None:
    """Write result rows so that running a scan again replaces its rows.

    `scans` names the scans that were run, in a column `key`; without it they are those of
    the rows, and a scan whose result is now empty keeps its earlier rows. Partitions hold
    a range of scan ids (`key_bucket`), not one id each, which keeps the number of folders
    bounded at any number of scans. Other scans of a bucket stay. A bucket that would be
    left without rows holds one with a null key, which `read_facts` leaves out. A folder is
    written by one task, so there are as many files as folders, not as many times tasks.
    One writer at a time.
    """
    spark = rows.sparkSession
    number = F.floor(F.col(key) / bucket).cast("long")
    fresh = rows.withColumn("key_bucket", number)
    done = (rows if scans is None else scans).select(key).distinct()
    try:
        old = spark.read.schema(fresh.schema).parquet(target)
    except AnalysisException as missing:  # first write: the folder does not exist yet
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = fresh
    else:
        touched = done.select(number.alias("key_bucket")).distinct()
        kept = old.join(touched, "key_bucket", "left_semi").join(done, key, "left_anti").where(F.col(key).isNotNull())
        whole = kept.select(*fresh.columns).unionByName(fresh)
        empty = touched.join(whole.select("key_bucket").distinct(), "key_bucket", "left_anti")
        merged = whole.unionByName(empty, allowMissingColumns=True)
        merged = _materialised(merged, target)
    (
        merged.repartition("key_bucket").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("key_bucket")
        .parquet(target)
    )


def read_facts(spark: SparkSession, target: str, key: str = "scan_id") -> DataFrame:
    """The rows that `append_facts` has written."""
    return spark.read.parquet(target).where(F.col(key).isNotNull()).drop("key_bucket")


def _materialised(df: DataFrame, target: str) -> DataFrame:
    """Stage rows in a folder beside the target, as a table cannot replace itself."""
    staged = target.rstrip("/") + "__staged"
    df.write.mode("overwrite").parquet(staged)
    return df.sparkSession.read.parquet(staged)


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of the parents named in `incoming` are replaced by its rows.

    A parent with a null child in `incoming` loses all its children.
    """
    kept = existing.join(incoming.select(parent).distinct(), parent, "left_anti")
    child = [c for c in incoming.columns if c != parent]
    return kept.unionByName(incoming.dropna(subset=child, how="all"))
