"""Contributions by increments, exact daily streams and substring search against plain recomputation."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from repostrata.operators import contributions as co
from repostrata.operators import increments as inc
from repostrata.operators import postings as po
from repostrata.streaming import seen

COMMITS = (
    "repo_id long, seq long, sha string, author_name string, author_email string, ts_raw string, ts timestamp, "
    "file_changes array<struct<path:string,insertions:bigint,deletions:bigint,language:string>>, arrival long"
)


def history(spark, n=200, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        day = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=5 * i)
        name = rng.choice(["Ann Lee", "A. Lee", "Bo", "", None, "Łukasz Żak"])
        changes = [(rng.choice(["a/x.py", "b/y.go", "z.md", "a/x.py"]), rng.choice([1, 5, None]), 2, rng.choice(["Python", None, "Go"])) for _ in range(rng.randrange(4))]
        rows.append((rng.choice([1, 1, 2, 3]), n - i, f"{i:040}", name, rng.choice([None, "ann.lee@x.org"]), day.isoformat() + "+00:00", day, changes, 1 + i * 5 // n))
    return spark.createDataFrame(rows, COMMITS)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_spellings_are_resolved_like_commits(spark):
    commits = history(spark).drop("arrival")
    named = co.with_identity(commits)
    assert sorted_rows(co.contributions(commits)) == sorted_rows(co.contributions(named))
    assert sorted_rows(co.language_contributions(commits)) == sorted_rows(co.language_contributions(named))
    assert sorted_rows(co.module_contributions(commits)) == sorted_rows(co.module_contributions(named))


def test_spellings_with_overrides(spark):
    commits = history(spark).drop("arrival").withColumn("project_id", F.col("repo_id") % 2)
    overrides = spark.createDataFrame([(1, 1, "ann lee", "", "boss"), (2, 0, None, "ANN.LEE@x.org", "mail")], "id long, project_id long, raw_name string, raw_email string, canonical_username string")
    assert sorted_rows(co.contributions(commits, overrides)) == sorted_rows(co.contributions(co.with_identity(commits, overrides)))


def test_steps_give_the_whole(spark, tmp_path):
    store = str(tmp_path / "store")
    history(spark).write.partitionBy("arrival").parquet(str(tmp_path / "commits"))
    commits = spark.read.parquet(str(tmp_path / "commits"))
    whole = commits.drop("arrival")
    for there, want in ((0, 0), (1, 1), (3, 3), (3, 3)):  # the second time nothing is new
        assert inc.fold(commits.filter(F.col("arrival") <= there), store) == want
    assert inc.steps(spark, store) == [(1, 0), (3, 1)]
    inc.merge_steps(spark, store)
    inc.merge_steps(spark, store)
    assert inc.steps(spark, store) == [(3, 0)]
    assert inc.fold(commits, store) == 5 and inc.steps(spark, store) == [(3, 0), (5, 3)]
    assert sorted_rows(inc.contributions(spark, store)) == sorted_rows(co.contributions(whole))
    assert sorted_rows(inc.language_contributions(spark, store)) == sorted_rows(co.language_contributions(whole))
    assert sorted_rows(inc.module_contributions(spark, store)) == sorted_rows(co.module_contributions(whole))


def test_a_step_reads_new_arrivals_only(spark, tmp_path):
    history(spark).write.partitionBy("arrival").parquet(str(tmp_path / "commits"))
    new = inc.fresh(spark.read.parquet(str(tmp_path / "commits")), 3)
    read = new._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(arrival" in read
    assert {r[0] for r in new.select("_metadata.file_path").distinct().select(F.regexp_extract("file_path", r"arrival=(\d+)", 1)).collect()} == {"4", "5"}


def test_a_lost_step_is_written_again(spark, tmp_path):
    store = str(tmp_path / "store")
    commits = history(spark)
    inc.fold(commits.filter("arrival <= 2"), store)
    half = co.day_sums(commits.filter("arrival = 3").drop("arrival")).withColumn("age", F.lit(-4).cast("long"))
    half.write.parquet(f"{store}/days/4-2")  # lost before its mark
    assert inc.mark(spark, store) == 2
    inc.fold(commits.filter("arrival <= 4"), store)
    want = co.contributions(commits.filter("arrival <= 4").drop("arrival"))
    assert sorted_rows(inc.contributions(spark, store)) == sorted_rows(want)


def test_nothing_folded(spark, tmp_path):
    assert inc.fold(history(spark).filter("false"), str(tmp_path / "s")) == 0
    with pytest.raises(ValueError):
        inc.contributions(spark, str(tmp_path / "s"))


ROWS = "repo_id long, commit_id string, commit_date date, arrived timestamp"


def run_logs(spark, home, logs, **options):
    for rows in logs:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{home}/logs")
        stream = spark.readStream.schema(ROWS).parquet(f"{home}/logs")
        seen.count_commits(stream, f"{home}/counts", f"{home}/state", **options).awaitTermination()
    return {(r["repo_id"], r["commit_date"].day): r["commit_count"] for r in seen.counted_daily(spark, f"{home}/counts").collect()}


@pytest.mark.parametrize("every", [1, 50])
def test_each_commit_counts_once(spark, tmp_path, every):
    day, at = (lambda d: datetime.date(2024, 1, d)), (lambda d: datetime.datetime(2024, 1, d))
    old = [(1, f"c{i}", day(1 + i % 3), at(4)) for i in range(30)] + [(1, "c0", day(1), at(4)), (None, "x", day(1), at(4)), (1, None, day(1), at(4)), (1, "y", None, at(4))]
    again = [(1, f"c{i}", day(1 + i % 3), at(5)) for i in range(33)]  # one more commit a day
    late = [(1, f"c{i}", day(1 + i % 3), at(25)) for i in range(33)] + [(2, f"d{i}", day(2), at(25)) for i in range(7)] + [(1, "e", day(24), at(25))]
    whole = [(1, f"c{i}", day(1 + i % 3), at(26)) for i in range(36)] + [(2, f"d{i}", day(2), at(26)) for i in range(7)] + [(1, "e", day(24), at(26)), (1, "f", day(24), at(26))]
    got = run_logs(spark, str(tmp_path), [old, again, late, whole], keep_days=5, shares=3, every=every)
    assert got == {(1, 1): 12, (1, 2): 12, (1, 3): 12, (2, 2): 7, (1, 24): 2}


def test_no_rows_and_no_stream(spark, tmp_path):
    assert run_logs(spark, str(tmp_path), [[]]) == {}
    assert seen.counted_daily(spark, str(tmp_path / "none")).count() == 0


TEXTS = ["Ann Lee", "lee@x.org", "", None, "aaaa", "ÄÖ straße", "日本語の名前", "a%b_c", "x" * 3000 + "needle", "Lee Ann", "ab"]
STRINGS = ["lee", "LEE", "a", "aa", "aaa", "aaaaa", "ann l", "ße", "äö", "日本", "本語の", "%b", "_", "needle", "xxxxn", "zzz", "", None, "lee"]


@pytest.mark.parametrize("rarest", [1, 3, 99])
def test_search_finds_what_contains_finds(spark, rarest):
    rows = [(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + rows[:2], "`my id` int, `a.b` string, text string")
    queries = spark.createDataFrame([(s,) for s in STRINGS], "`the q` string")
    got = po.search(df, "my id", ["a.b", "text"], queries, "the q", rarest=rarest)
    assert got.columns == ["the q", "my id"]
    want = {(s, i) for i, *cells in rows for s in STRINGS if s for t in cells if t and s.lower() in t.lower()}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_search_with_a_stored_index(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    po.postings(df, "id", ["t"]).write.parquet(str(tmp_path / "index"))
    queries = spark.createDataFrame([("lee",), ("needle",)], "q string")
    got = po.search(df, "id", ["t"], queries, "q", spark.read.parquet(str(tmp_path / "index")))
    assert {tuple(r) for r in got.collect()} == {("lee", 0), ("lee", 1), ("lee", 9), ("needle", 8)}
    assert po.search(df, "id", ["t"], queries.filter("false"), "q").count() == 0
    assert po.search(df.filter("false"), "id", ["t"], queries, "q").count() == 0
