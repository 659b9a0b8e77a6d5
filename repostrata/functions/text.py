"""Line counts and line arrays: F15 with the two notions of a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

# What ends a line when iterating a file, and when splitting text.
FILE_NEWLINE = r"\r\n?|\n"
TEXT_NEWLINES = "\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029"
TEXT_NEWLINE = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"


def _count(content: Column, newline: str) -> Column:
    open_end = (content != "") & ~content.rlike(f"(?:{newline})\\z")
    return (F.regexp_count(content, F.lit(newline)) + open_end.cast("int")).cast("long")


def count_lines(content: Column) -> Column:
    """Lines of a file; a last line without newline counts."""
    return _count(content, FILE_NEWLINE)


def count_text_lines(content: Column) -> Column:
    return _count(content, TEXT_NEWLINE)


def _lines(content: Column, newline: str) -> Column:
    """A newline at the very end closes the last line; an empty text has no line."""
    body = F.regexp_replace(content, f"(?:{newline})\\z", "")
    return F.when(content != "", F.split(body, newline, -1)).otherwise(
        F.array().cast("array<string>")
    )


def file_lines(content: Column) -> Column:
    return _lines(content, FILE_NEWLINE)


def text_lines(content: Column) -> Column:
    """Lines of a text. The rarer newlines are sought as plain characters and replaced first, so
    that the text is split at one character and not by a regular expression."""
    odd = reduce(lambda a, b: a | b, [content.contains(c) for c in TEXT_NEWLINES[1:]])
    unix = F.when(odd, F.regexp_replace(content, TEXT_NEWLINE, "\n")).otherwise(content)
    lines = let(unix, lambda t: F.split(F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t), "\n", -1))
    return F.when(content != "", lines).otherwise(F.array().cast("array<string>"))


def unix_newlines(content: Column) -> Column:
    return F.when(content.contains("\r"), F.regexp_replace(content, r"\r\n?", "\n")).otherwise(content)

