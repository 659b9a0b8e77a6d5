"""Personal-data identifiers in source lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .comments import code_part, comment_part, numbered_lines
from .token_index import whole_word_matches


def within_size(source_files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files up to a size, all of them where none is given."""
    return source_files if max_bytes is None else source_files.filter(F.col("size_bytes") <= max_bytes)


def pdn_targets(source_files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files that are scanned; all but `content` is needed."""
    path = F.col("path")
    return within_size(source_files, max_bytes).filter(
        paths.not_test_path(path)
        & ~paths.in_skipped_dir(path)
        & paths.is_pdn_target(path)
    )


def listed_types(spark: SparkSession, types: list[tuple[str, str]]) -> DataFrame:
    """Configured pairs as a table whose size Spark knows, so that it sends them to the lines.

    A list of rows would become a table of unknown size: every token would move with its line.
    """
    names = ["pdn_type", "identifier"]
    columns = [pa.array([t[i] for t in types], pa.string()) for i in range(2)]
    return spark.createDataFrame(pa.table(columns, names))


def pdn_findings(
    source_files: DataFrame, types: DataFrame | list[tuple[str, str]], include_comments: bool = False,
    max_bytes: int | None = None, max_lines: int | None = None,
) -> DataFrame:
    """C11: one row per line, identifier and part.

    `types` are the configured (pdn_type, identifier) pairs, a table of any length. Lines
    meet identifiers by equal tokens (`token_index`), and only those pairs are searched.
    Files and lines of any size and number are scanned unless a bound is given.
    """
    if isinstance(types, list):
        types = listed_types(source_files.sparkSession, types)
    numbered = numbered_lines(pdn_targets(source_files, max_bytes))
    if max_lines is not None:
        numbered = numbered.filter(F.col("line_number") <= max_lines)
    parts = [F.struct(F.lit("code").alias("part"), code_part(F.col("line")).alias("text"))]
    if include_comments:
        parts.append(F.struct(F.lit("comment").alias("part"), comment_part(F.col("line")).alias("text")))
    split = numbered.select("repo_id", "path", "line_number", F.inline_outer(F.array(*parts)))
    return whole_word_matches(split, "text", types.select("pdn_type", "identifier"), "identifier").select(
        "repo_id", "path", "line_number", "pdn_type", F.col("identifier").alias("matched_identifier"), "part"
    )
