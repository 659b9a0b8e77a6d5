"""Whole-word search for a table of identifiers, by an inverted index of tokens.

A token is a run of word characters. Where an identifier occurs as a whole word, each run
inside it is a token of the text; its longest run is its key. Texts are exploded to their
distinct tokens, joined by equality with the keys, and only those pairs are verified. The
plan is the same for ten identifiers and for a million; Spark broadcasts a small table of
identifiers by its measured size and sort-merges a large one, where keys that many texts
hold are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = r"(?U)\w+"
MARK = r"(?U)\W"


def whole_word_pattern(identifier: Column) -> Column:
    """Pattern that finds an identifier between word boundaries, with Unicode word characters."""
    return F.concat(F.lit(r"(?U)\b"), F.regexp_replace(identifier, r"([^\w])", r"\\$1"), F.lit(r"\b"))


def keyed(identifiers: DataFrame, identifier: str) -> DataFrame:
    """With `key` (the longest run, the first of them by code point, or the first mark of an
    identifier without one), `sure` (the key says it all) and `pattern`. Empty and null
    identifiers are left out."""
    word = F.col(identifier)
    runs = F.regexp_extract_all(word, F.lit(RUN), F.lit(0))
    longest = F.element_at(F.array_sort(runs, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1)
    key = F.when(F.size(runs) > 0, longest).otherwise(F.substring(word, 1, 1))
    return identifiers.filter(word != "").withColumn("key", key).withColumn("sure", F.col("key") == word).withColumn(
        "pattern", whole_word_pattern(word)
    ).withColumn("sure", F.col("sure") & word.rlike(RUN))


def tokens(text: Column, marks: bool) -> Column:
    """Distinct runs of a text, and its distinct other characters if `marks`."""
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    return F.array_distinct(F.concat(runs, F.regexp_extract_all(text, F.lit(MARK), F.lit(0))) if marks else runs)


def whole_word_matches(texts: DataFrame, text: str, identifiers: DataFrame, identifier: str) -> DataFrame:
    """Rows of `texts` with those of `identifiers` that occur in them as whole words."""
    table = keyed(identifiers, identifier)
    marks = not table.filter(~F.col("key").rlike(RUN)).isEmpty()
    met = texts.filter(F.col(text) != "").withColumn("key", F.explode_outer(tokens(F.col(text), marks))).join(table, "key")
    return met.filter(F.col("sure") | F.expr(f"`{text}` rlike pattern")).drop("key", "sure", "pattern")
