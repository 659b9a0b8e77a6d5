"""P8, P9, P12, J8 for a table of search strings: substring search by postings of trigrams.

Texts are reduced to (gram, row) postings, where a gram is three characters of the lowercased
text. A search string occurs only in rows that hold all its grams; its rarest grams, by the
postings' own counts, are intersected and the few rows left are verified, so the grams decide
nothing alone. Strings of one or two characters are looked up as grams of that length, which are
posted only if such strings are asked. All strings are answered by one job, with joins by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct runs of `size` characters (code points); none in shorter or null texts."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.array_distinct(F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(size))))


def postings(rows: DataFrame, key: str, columns: list[str], sizes: list[int] | None = None) -> DataFrame:
    """(gram, key, place): every gram of the columns of a row; `place` is the column's number.

    May be stored, partitioned or bucketed by gram, and searched many times.
    """
    texts = rows.select(F.col(f"`{key}`").alias("key"), _texts(columns))
    found = [grams(F.col("text"), n) for n in sizes or [GRAM]]
    return texts.select(F.explode(F.concat(*found)).alias("gram"), "key", "place")


def _texts(columns: list[str]) -> Column:
    parts = [F.struct(F.lit(i).alias("place"), F.lower(F.col(f"`{c}`")).alias("text")) for i, c in enumerate(columns)]
    return F.inline(F.array(*parts))


def search(rows: DataFrame, key: str, columns: list[str], queries: DataFrame, query: str, index: DataFrame | None = None,
           rarest: int = 3) -> DataFrame:
    """(query, key) where a column of the row contains the string, letter case aside.

    Null and empty strings match nothing; a repeated string or key gives one pair. `index`
    holds stored `postings`, which must have the grams of all sizes asked (1 and 2 for
    shorter strings); by default they are made for this search. A gram that most rows hold is a hot
    key only for strings that have no rarer one.
    """
    wanted = queries.select(F.col(f"`{query}`").alias("query")).filter(F.col("query") != "").distinct().withColumn("needle", F.lower("query"))
    size = F.least(F.length("needle"), F.lit(GRAM))
    if index is None:
        sizes = [r[0] for r in wanted.select(size).distinct().collect()]  # at most three numbers
        if not sizes:
            return _pairs(rows, key, queries, query).limit(0)
        index = postings(rows, key, columns, sorted(sizes))
    of = F.coalesce(*[F.when(size == n, grams(F.col("needle"), n)) for n in range(1, GRAM + 1)])
    parts = wanted.withColumn("gram", F.explode(of))
    held = index.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("rows"))
    # a gram that no row holds comes first, so its string finds nothing
    counted = parts.join(held, "gram", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("rows", "gram"))
    chosen = counted.withColumn("rank", rank).filter(F.col("rank") <= rarest)
    chosen = chosen.withColumn("needed", F.count("*").over(Window.partitionBy("query"))).select("query", "needle", "gram", "needed")
    # Spark can't tell how much an explode makes of a row and would send postings and hits through the driver
    met = index.hint("merge").join(chosen, "gram").groupBy("query", "needle", "needed", "key", "place").agg(F.count_distinct("gram").alias("n"))
    near = met.filter(F.col("n") >= F.col("needed")).select("query", "needle", "key", "place")
    texts = rows.select(F.col(f"`{key}`").alias("key"), _texts(columns))
    hits = near.hint("merge").join(texts, ["key", "place"]).filter(F.contains("text", "needle"))
    return hits.select("query", "key").distinct().withColumnsRenamed({"query": query, "key": key})


def _pairs(rows: DataFrame, key: str, queries: DataFrame, query: str) -> DataFrame:
    """An empty frame of the result's columns."""
    return rows.select(F.lit(None).cast(queries.schema[query].dataType).alias(query), F.col(f"`{key}`").alias(key))
