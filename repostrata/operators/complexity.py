"""Large files, large functions and fan-out, with W3 and A26.

A file is one row, so function starts and their lengths are found with array
functions inside the row; nothing is exploded but the import lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, paths, text
from ..functions.common import lookup, strip


def _by_language(language: Column, patterns: dict[str, str], words: dict[str, list[str]], build, otherwise: Column) -> Column:
    """`build(matches)` for the language of the file, where `matches` tests one line.

    A line is searched for the pattern only if it has one of the words that no match lacks;
    most lines have none, and finding a word costs a fraction of a regular expression.
    """

    def test(name: str):
        def matches(line: Column) -> Column:
            held = reduce(lambda a, b: a | b, [line.contains(w) for w in words[name]])
            return held & line.rlike("(?U)" + patterns[name])

        return matches

    return reduce(lambda chain, name: F.when(language == name, build(test(name))).otherwise(chain), patterns, otherwise)


def function_starts(lines: Column, language: Column) -> Column:
    """Positions of the lines that start a function."""
    found = _by_language(
        language, dims.FUNCTION_PATTERNS, dims.FUNCTION_WORDS,
        lambda matches: F.transform(lines, lambda l, i: F.when(matches(l), i)),
        F.array().cast("array<int>"),
    )
    return F.filter(found, lambda i: i.isNotNull())


def function_lengths(starts: Column, line_count: Column) -> Column:
    """Lines from each function start to the next one, or to the end."""
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(line_count))
    return F.filter(
        F.zip_with(starts, ends, lambda s, e: e - s), lambda n: n.isNotNull()
    )


def import_lines(lines: Column, language: Column) -> Column:
    """Distinct trimmed import lines of one file."""
    found = _by_language(
        language, dims.IMPORT_PATTERNS, dims.IMPORT_WORDS,
        lambda matches: F.filter(lines, matches), F.array().cast("array<string>"),
    )
    return F.array_distinct(F.transform(found, lambda l: strip(l)))


def complexity_files(source_files: DataFrame, languages: DataFrame) -> DataFrame:
    """Per file: lines, large functions and import lines.

    `languages` names the languages of each repository; a file counts only when
    its language is among them. The text is reduced to numbers and imports in its row
    before that join, so no text is shuffled.
    """
    path = F.col("path")
    language = lookup(dims.COMPLEXITY_EXTENSIONS, paths.suffix(path))
    coded = (
        source_files.filter(~paths.in_complexity_skipped_dir(path))
        .select("repo_id", "path", "content", language.alias("language"))
        .filter(F.col("language").isNotNull())
        .withColumn("lines", text.text_lines(F.col("content")))
    )
    # Starts and imports are columns of their own, so that each is found once.
    found = coded.select(
        "repo_id",
        "path",
        "language",
        F.size("lines").alias("lines"),
        function_starts(F.col("lines"), F.col("language")).alias("starts"),
        import_lines(F.col("lines"), F.col("language")).alias("imports"),
    )
    lengths = function_lengths(F.col("starts"), F.col("lines"))
    known = languages.select("repo_id", "language").distinct()
    return found.select(
        "repo_id",
        "path",
        "language",
        F.col("lines").cast("long").alias("lines"),
        F.size(F.filter(lengths, lambda n: n >= dims.LARGE_FUNCTION_LINES))
        .cast("long")
        .alias("large_functions"),
        "imports",
    ).join(known, ["repo_id", "language"], "left_semi").select("repo_id", "path", "language", "lines", "large_functions", "imports")


def fan_out(files: DataFrame) -> DataFrame:
    """Distinct import lines of a repository.

    The outer form of explode, because the plain one makes Spark test the array
    for emptiness first, which finds the imports of every file twice.
    """
    return (
        files.select("repo_id", F.explode_outer("imports").alias("line"))
        .filter(F.col("line").isNotNull())
        .distinct()
        .groupBy("repo_id")
        .agg(F.count("*").alias("fan_out"))
    )


def complexity(files: DataFrame) -> DataFrame:
    """One row per repository."""
    sizes = files.groupBy("repo_id").agg(
        F.count_if(F.col("lines") >= dims.LARGE_FILE_LINES).alias("files_above_threshold"),
        F.coalesce(F.sum("large_functions"), F.lit(0)).alias("functions_above_threshold"),
    )
    return sizes.join(fan_out(files), "repo_id", "left").fillna(0, ["fan_out"])
