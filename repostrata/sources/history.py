"""Exported commit logs and tag lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths
from ..functions.common import blank_to_null, strip
from ..functions.scalars import iso_parse
from ..functions.text import unix_newlines

# The line that starts each commit in an exported log. A log is written with
# --no-merges --numstat and this line, the sha, author name, author e-mail and
# ISO time at the head of each commit.
COMMIT_MARK = "@@repostrata-commit@@"

CHANGE_TYPE = "struct<path:string,insertions:bigint,deletions:bigint,language:string>"


def read_log_text(spark: SparkSession, path: str, mark: str = COMMIT_MARK) -> DataFrame:
    """One row per commit block of every log file `<repo_id>.log` under `path`.

    Blocks are cut by the reader, so a log is split over tasks like any text.
    `seq` orders the blocks of one log, newest first.
    """
    return (
        spark.read.option("lineSep", mark + "\n")
        .text(path)
        .select(
            F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.log$", 1).alias("repo_id"),
            _position().alias("seq"),
            "value",
        )
    )


def _position() -> Column:
    """File offset of the split and row in the task, as one number.

    Rows of one split come in file order; the row part of the generated id stays
    below 2^33.
    """
    block = F.col("_metadata.file_block_start").cast("decimal(19,0)")
    row = F.pmod(F.monotonically_increasing_id(), F.lit(2**33)).cast("decimal(12,0)")
    return (block * F.lit(10**12).cast("decimal(13,0)") + row).cast("decimal(38,0)")


def _numstat(lines: Column) -> Column:
    """Change lines to an array of structs; lines that are none are left out.

    Each step is its own array function, so a path is cleaned once and its
    extension is taken once.
    """

    def count(raw: Column) -> Column:
        return F.when(raw == "-", F.lit(0).cast("long")).when(
            raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("long")
        )

    fields = F.filter(F.transform(lines, lambda l: F.split(strip(l), "\t")), lambda p: F.size(p) >= 3)
    rows = F.transform(
        fields,
        lambda p: F.struct(
            paths.clean_filepath(F.get(p, F.lit(2))).alias("path"),
            count(F.get(p, F.lit(0))).alias("insertions"),
            count(F.get(p, F.lit(1))).alias("deletions"),
        ),
    )
    kept = F.filter(
        rows,
        lambda r: r["path"].isNotNull()
        & r["insertions"].isNotNull()
        & r["deletions"].isNotNull()
        & ~paths.in_history_skipped_dir(r["path"]),
    )
    return F.transform(
        kept,
        lambda r: F.struct(
            r["path"].alias("path"),
            r["insertions"].alias("insertions"),
            r["deletions"].alias("deletions"),
            paths.detect_language(r["path"]).alias("language"),
        ),
    ).cast(f"array<{CHANGE_TYPE}>")


def parse_log(blocks: DataFrame) -> DataFrame:
    """(repo_id, seq, value) blocks to commits with nested file changes.

    A block needs four header lines, a sha of at least seven characters and a
    readable time; anything else is dropped. Entirely row-local, no shuffle.
    """
    # exploded, so that no filter below makes Spark split the block again
    lines = F.array(F.split(strip(unix_newlines(F.col("value"))), "\n"))
    head = blocks.select("repo_id", "seq", F.explode_outer(lines).alias("lines")).filter(F.size("lines") >= 4)

    def header(i: int) -> Column:
        return strip(F.get("lines", F.lit(i)))

    commits = head.select(
        "repo_id",
        "seq",
        header(0).alias("sha"),
        header(1).alias("author_name"),
        header(2).alias("author_email"),
        header(3).alias("ts_raw"),
        iso_parse(header(3)).alias("ts"),
        _numstat(F.slice("lines", F.lit(5), F.size("lines"))).alias("file_changes"),
    )
    return commits.filter((F.length("sha") >= 7) & F.col("ts").isNotNull())


def history_limit(commits: DataFrame, newest: int) -> DataFrame:
    """S3: the newest N commits of each repository, 0 = all.

    The ranking filter is applied per task before the shuffle, so a repository
    with most of the commits sends at most N rows from each task.
    """
    if newest < 0:
        raise ValueError("newest must be 0 or more")
    if newest == 0:
        return commits
    rank = F.row_number().over(W.partitionBy("repo_id").orderBy("seq"))
    keys = commits.select("repo_id", "seq").withColumn("_rank", rank).filter(
        F.col("_rank") <= newest
    )
    return commits.join(keys.drop("_rank"), ["repo_id", "seq"], "left_semi")


def parse_tags(lines: DataFrame) -> DataFrame:
    """(repository_id, value, commit_sha) tag lines to tag rows.

    `value` holds seven tab-separated fields; `commit_sha` is the commit an
    annotated tag points to, as written by the exporter (null when unknown).
    """
    parts = F.split("value", "\t")

    def field(i: int) -> Column:
        return strip(F.get(parts, F.lit(i)))

    sha = F.when(field(1) == "tag", F.coalesce(blank_to_null(F.col("commit_sha")), field(2))).otherwise(
        field(2)
    )
    email = F.regexp_replace(field(5), "^<+|>+$", "")
    return lines.filter(F.size(parts) >= 7).select(
        "repository_id",
        field(0).alias("name"),
        blank_to_null(sha).alias("sha"),
        blank_to_null(field(6)).alias("message"),
        blank_to_null(field(4)).alias("tagger_name"),
        blank_to_null(email).alias("tagger_email"),
        iso_parse(field(3)).alias("tagged_at"),
    )
