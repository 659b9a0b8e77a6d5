"""File profile of every repository, with A23-A25 and T3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dims, paths, text
from ..functions.common import share


def analysed_files(source_files: DataFrame) -> DataFrame:
    """Per visible file: kind flags, language and, for languages only, lines.

    Row-local; the content column is dropped here and never shuffled.
    """
    path = F.col("path")
    visible = source_files.filter(~paths.in_skipped_dir(path)).select(
        "repo_id",
        "path",
        "size_bytes",
        "content",
        paths.is_lockfile(path).alias("is_lockfile"),
        paths.is_doc_file(path).alias("is_doc"),
        paths.detect_language(path).alias("_language"),
        paths.is_test_file(path).alias("is_test"),
        paths.is_config_file(path).alias("is_config"),
    )
    language = F.when(~F.col("is_lockfile"), F.col("_language"))
    return visible.select(
        "repo_id",
        "path",
        "size_bytes",
        "is_lockfile",
        (F.col("is_doc") & ~F.col("is_lockfile")).alias("is_doc"),
        language.alias("language"),
        F.when(language.isNotNull(), text.count_lines(F.col("content"))).alias("loc"),
        "is_test",
        "is_config",
    )


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def file_totals(files: DataFrame) -> DataFrame:
    """One row per repository."""
    source = F.col("language").isNotNull()
    test, config = F.col("is_test"), F.col("is_config")
    return files.groupBy("repo_id").agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("loc"), F.lit(0)).alias("total_loc"),
        F.sum("size_bytes").alias("size_bytes"),
        _count(source & ~test & ~config).alias("file_count_source"),
        _count(source & test).alias("file_count_test"),
        _count(source & ~test & config).alias("file_count_config"),
        _count(F.col("loc") >= dims.LARGE_FILE_LINES).alias("large_files_count"),
        F.coalesce(F.avg("loc"), F.lit(0.0)).alias("avg_file_loc"),
        F.coalesce(F.bool_or("is_lockfile"), F.lit(False)).alias("has_lockfile"),
        F.coalesce(
            F.sum(F.when(F.col("language").isin("Markdown", "reStructuredText"), F.col("loc"))),
            F.lit(0),
        ).alias("doc_loc"),
        *[
            F.coalesce(F.bool_or(F.col("is_doc") & _mentions(words)), F.lit(False)).alias(name)
            for name, words in DOC_FLAGS.items()
        ],
    )


# Words in a document path and the score flag they raise.
DOC_FLAGS = {
    "has_readme": ["readme"],
    "has_install_docs": ["install", "setup"],
    "has_architecture_docs": ["architecture", "adr"],
    "has_changelog": ["changelog", "history"],
    "has_runbook": ["runbook"],
}


def _mentions(words: list[str]) -> Column:
    return F.lower("path").rlike("|".join(words))


def language_stats(files: DataFrame) -> DataFrame:
    """Files, lines and line share by language."""
    by_language = (
        files.filter(F.col("language").isNotNull())
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("file_count"), F.sum("loc").alias("loc"))
    )
    total = F.sum("loc").over(W.partitionBy("repo_id"))
    return by_language.withColumn("percentage", share(F.col("loc"), total))


def dir_count(source_files: DataFrame) -> DataFrame:
    """Distinct visible directories that hold a visible file or directory."""
    parts = F.split("path", "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    dirs = source_files.filter(F.size(parts) > 1).select(
        "repo_id", F.explode(prefixes).alias("dir")
    ).distinct()
    hidden = F.exists(
        F.split("dir", "/"), lambda p: p.isin(*dims.SKIP_DIRS) | p.startswith(".")
    )
    return dirs.filter(~hidden).groupBy("repo_id").agg(F.count("*").alias("dir_count"))


def large_files(files: DataFrame, lines: str = "loc") -> DataFrame:
    """Files with at least 500 lines."""
    return files.filter(F.col(lines) >= dims.LARGE_FILE_LINES).select("repo_id", "path", lines)


def top_large_files(files: DataFrame, lines: str = "loc") -> DataFrame:
    """Ten largest files of each repository with at least 500 lines.

    `row_number <= 10` becomes a per-task group limit before the shuffle.
    """
    rank = F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc(lines), "path"))
    return (
        large_files(files, lines)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= dims.TOP_FILES)
    )


def doc_files(files: DataFrame) -> DataFrame:
    return files.filter("is_doc").select("repo_id", "path")


def file_profile(source_files: DataFrame) -> DataFrame:
    """Totals and directory count, one row per repository."""
    return (
        file_totals(analysed_files(source_files))
        .join(dir_count(source_files), "repo_id", "left")
        .fillna(0, ["dir_count"])
    )
