"""Facts laid out by scan: same rows, no exchange of the facts, folders pruned, hot scans split."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from repostrata.sources import layout


@pytest.fixture
def facts(spark):
    return spark.range(20_000).select((F.col("id") % 400 * 10).alias("scan_id"), F.concat(F.lit("l"), F.col("id") % 7).alias("language"), F.col("id").alias("loc"))


@pytest.fixture
def stored(spark, tmp_path):
    names = []

    def make(rows, buckets=4, width=1000):
        name = f"facts_{uuid.uuid4().hex}"
        layout.write_laid_out(rows, name, str(tmp_path / name), buckets, width)
        names.append(name)
        return name

    yield make
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouping_by_scan_has_no_exchange(spark, facts, stored):
    rows = layout.read_laid_out(spark, stored(facts))
    sums = rows.groupBy("scan_id", "language").agg(F.sum("loc").alias("loc"))
    assert "Exchange" not in plan(sums)
    want = facts.groupBy("scan_id", "language").agg(F.sum("loc").alias("loc"))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, want.collect()))


def test_join_moves_only_the_ids(spark, facts, stored):
    name = stored(facts)
    ids = spark.createDataFrame([(10,), (20,), (1990,), (1990,), (5,), (None,)], "id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = layout.of_scans(spark, name, ids)
        text = plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found.columns == facts.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, facts.filter("scan_id in (10, 20, 1990)").collect()))
    final = text.split("Initial Plan")[0]
    fact_side = final[final.index("FileScan") - 400 : final.index("FileScan")]
    assert "Exchange" not in fact_side and "Bucketed: true" in final
    assert re.search(r"PartitionFilters: \[[^\]]*scan_range", final)


def test_latest_scans(spark, facts, stored):
    scans = spark.createDataFrame(
        [(10, 1, "completed", "2024-01-01"), (20, 1, "completed", "2024-02-01"), (30, 1, "running", "2024-03-01"), (3990, 2, "completed", None)],
        "id long, project_repository_id long, status string, started_at string")
    got = layout.of_latest_scans(spark, stored(facts), scans)
    assert {r[0] for r in got.select("scan_id").distinct().collect()} == {20, 3990} and got.count() == 100


def test_a_hot_scan_is_read_in_splits(spark, facts, stored):
    hot = facts.withColumn("scan_id", F.when(F.col("loc") % 10 < 9, 70).otherwise(F.col("scan_id")))
    rows = layout.read_laid_out(spark, stored(hot, buckets=16))
    assert "Bucketed: true" not in plan(rows.groupBy("scan_id").count())
    assert rows.filter("scan_id = 70").count() == hot.filter("scan_id = 70").count()


def test_no_facts_and_no_scans(spark, facts, stored):
    empty = stored(facts.filter("false"))
    assert layout.read_laid_out(spark, empty).count() == 0
    odd = stored(facts.withColumn("scan_id", F.when(F.col("loc") > 5, F.col("scan_id") - 2000)))
    assert layout.read_laid_out(spark, odd).count() == 20_000 - 6
    none = spark.createDataFrame([], "id long")
    assert layout.of_scans(spark, odd, none).count() == 0
