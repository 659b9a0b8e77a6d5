"""A checkout tree, or a table of files, as `source_files`.

One scan feeds every consumer. A byte sequence that is not UTF-8 becomes the replacement
character, as in images or Latin-1 files, so any checkout can be read. Consumers that do
not select the content do not read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below `root/<repo_id>/...` as (repo_id, path, size_bytes, content)."""
    base = F.lit(root.rstrip("/") + "/")
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.col("length").alias("size_bytes"), "content")
    )
    relative = F.url_decode(F.replace(F.element_at(F.split(F.col("path"), base, 2), -1), F.lit("+"), F.lit("%2B")))
    cut = F.locate("/", relative)
    return raw.select(
        F.substring(relative, F.lit(1), cut - 1).alias("repo_id"),
        F.substring(relative, cut + 1, F.length(relative)).alias("path"),
        "size_bytes",
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The same four columns from a Parquet table."""
    return spark.read.parquet(path).select("repo_id", "path", "size_bytes", "content")
