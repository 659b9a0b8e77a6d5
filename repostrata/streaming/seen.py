"""J23 counted exactly as logs arrive: commit ids seen are keyed state, finished days shrink to a number.

A log is read again with every scan, so most of what arrives was counted before. State is kept
per repository, author-local day and share of the ids (so that one hot day of one repository is
spread over tasks): the ids counted so far. A day is finished when the watermark of *arrivals* is
`keep_days` beyond its end. Its ids are dropped then and the number stays; should a whole log bring
the day once more, the larger number counts, as in the merge of two reports. Commit times never
make a row late: the old history of a new repository counts in full.

Each batch writes the counts that changed, into a folder of its own, so a replayed batch
replaces itself. `compact` folds all batches so far into one table of a row per key, and readers meet that
and the batches after it.

Null ids, repositories or days aren't commits and are left out. A log must come in one batch (a
file does) if its days may be finished already.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEY = ["repo_id", "commit_date", "share"]
COUNTED = "repo_id long, commit_date date, share int, commit_count long"
STATE = "ids array<string>, commit_count long, finished boolean"
DAY_MS = 86_400_000


def _counter(keep_days: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, before, finished = state.get if state.exists else ([], 0, False)
        if state.hasTimedOut:
            state.update(([], before, True))
            return
        arrived: set[str] = set()
        for batch in batches:
            arrived.update(batch["commit_id"])
        if finished:
            total, ids = max(before, len(arrived)), []
        else:
            ids = sorted(arrived.union(known))
            total = len(ids)
            ends = ((key[1] - datetime.date(1970, 1, 1)).days + 1 + keep_days) * DAY_MS
            if ends <= state.getCurrentWatermarkMs():
                ids, finished = [], True
            else:
                state.setTimeoutTimestamp(max(ends, 1))
        state.update((ids, total, finished))
        if total != before:
            yield pd.DataFrame([(*key, total)], columns=[*KEY, "commit_count"])

    return count


def count_commits(commits: DataFrame, target: str, checkpoint: str, keep_days: int = 30, shares: int = 16,
                  every: int = 50) -> StreamingQuery:
    """Follow a stream of (repo_id long, commit_id string, commit_date date, arrived timestamp).

    `checkpoint` and `target` belong in shared storage. Batches are compacted every `every`.
    Rows that arrive more than a day behind the newest arrival are dropped by Spark and counted in its progress.
    """
    rows = commits.dropna(subset=["repo_id", "commit_id", "commit_date"]).select(
        F.col("repo_id").cast("long").alias("repo_id"), "commit_date", "arrived", "commit_id",
        F.pmod(F.xxhash64("commit_id"), F.lit(shares)).cast("int").alias("share"),
    )
    counted = rows.withWatermark("arrived", "1 day").groupBy(*KEY).applyInPandasWithState(
        _counter(keep_days), COUNTED, STATE, "update", GroupStateTimeout.EventTimeTimeout
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batches/batch={batch_id}")
        if batch_id % every == every - 1:
            compact(batch.sparkSession, target, batch_id)

    return (
        counted.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The table in a folder, empty where nothing was written."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _counts(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """Newest count per key: of the last compacted table (before a batch) and the batches after it
    (counts only grow)."""
    whole = _read(spark, f"{target}/whole", COUNTED + ", upto long")
    if before is not None:
        whole = whole.filter(F.col("upto") < before)
    last = whole.agg(F.max("upto")).first()[0]
    last = -1 if last is None else last
    newer = _read(spark, f"{target}/batches", COUNTED + ", batch long").filter(F.col("batch") > last)
    rows = whole.filter(F.col("upto") == last).drop("upto").unionByName(newer.drop("batch"))
    return rows.groupBy(*KEY).agg(F.max("commit_count").alias("commit_count"))


def compact(spark: SparkSession, target: str, upto: int) -> None:
    """Fold the batches up to `upto`, the last one written, into one table; a rerun writes the same."""
    _counts(spark, target, upto).write.mode("overwrite").parquet(f"{target}/whole/upto={upto}")


def counted_daily(spark: SparkSession, target: str) -> DataFrame:
    """Commits per repository and day."""
    return _counts(spark, target).groupBy("repo_id", "commit_date").agg(F.sum("commit_count").alias("commit_count"))

