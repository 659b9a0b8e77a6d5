"""Lookups in a table of answers where a few keys hold much of the rows.

A sketch of the most frequent keys (of bounded size) finds the hot ones. Their rows are
dealt over several salts and their answers copied to each, so that no task gets all rows
of a key; all other keys join as they are. Rows that want no answer take no part in the
exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that the sketch tells, and counters that it holds.
HOT_KEYS, COUNTERS = 32, 4096


def _name(keys: list[str]) -> Column:
    """The key columns as one text; lengths keep neighbours apart."""
    return F.concat_ws("", *[F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)) for k in keys])


def hot_keys(rows: DataFrame, keys: list[str], parts: int) -> dict[str, int]:
    """Keys with more rows than a `parts`-th of all, and how many times as many."""
    named = rows.select(_name(keys).alias("key"))
    total, top = named.agg(F.count("*"), F.call_function("approx_top_k", F.col("key"), F.lit(HOT_KEYS), F.lit(COUNTERS))).first()
    share = max(1, total // parts)
    return {t["item"]: -(-t["count"] // share) for t in top or [] if t["item"] is not None and t["count"] > share}


def lookup(rows: DataFrame, answers: DataFrame, keys: list[str], wanted: Column, parts: int | None = None) -> DataFrame:
    """`rows` with the other columns of `answers` (at most one row per key), null where there
    is no answer or none is `wanted`. Key columns are texts."""
    extra = [c for c in answers.columns if c not in keys]
    asking = rows.filter(wanted)
    silent = rows.filter(~F.coalesce(wanted, F.lit(False))).select("*", *[F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in extra])
    if parts is None:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(asking, keys, parts)
    if not hot:
        return asking.join(answers, keys, "left").select(*rows.columns, *extra).unionByName(silent)
    salts = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[_name(keys)], F.lit(1))
    spread = asking.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int"))
    copied = answers.withColumn("_salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
    return spread.join(copied, [*keys, "_salt"], "left").select(*rows.columns, *extra).unionByName(silent)
