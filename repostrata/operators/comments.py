"""Code and comment part of every line.

Instead of carrying a state from line to line, the whole text is cut into tokens
by one regular expression per comment style: a block comment is one token even
when it spans lines. Comment tokens are wrapped in control characters line by
line, and the lines are split afterwards. One pass per file, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims, paths, text

OPEN, CLOSE = "\x02", "\x03"

C_TOKENS = r"[^/]+|//[^\n]*|(?s:/\*.*?(?:\*/|\z))|/"

_TRIPLE = r"{q}[^\n]*?{q}|{q}[^\n]*(?:\z|\n(?s:.*?)(?:{q}[^\n]*|\z))"
HASH_TOKENS = (
    "[^#\"']+|#[^\\n]*|"
    + _TRIPLE.format(q='"""')
    + "|"
    + _TRIPLE.format(q="'''")
    + "|[\"']"
)
# A docstring that ends on a later line: up to its closing quotes, then code.
HASH_BLOCK = r"^((?s:(\"\"\"|''')[^\n]*\n.*?(?:\2|\z)))([^\n]*)$"
HASH_INLINE = r"^(\"\"\"|''')[^\n]*?\1$"

# A block comment that is still open at the end of its first line, else a line.
SQL_TOKENS = r"(?>[^\n]*?/\*)(?![^\n]*\*/)[^\n]*(?:\n(?s:.*?)(?:\*/|\z)|\z)|[^\n]+|\n"
SQL_BLOCK = r"^([^\n]*?)/\*([^\n]*)(?:\n|\z)(?s:(.*))$"
SQL_INLINE = r"^([^\n]*?)/\*([^\n]*?)\*/([^\n]*)$"


def _mark(comment: Column) -> Column:
    """Wrap a comment, closing and reopening the mark at each line end."""
    return F.concat(
        F.lit(OPEN), F.replace(comment, F.lit("\n"), F.lit(f"{CLOSE}\n{OPEN}")), F.lit(CLOSE)
    )


def _c_token(t: Column) -> Column:
    block = t.startswith("/*")
    body = F.substring(t, F.lit(3), F.length(t))
    closed_inline = ~t.contains("\n") & t.rlike(r"^/\*.*\*/$") & (F.length(t) >= 4)
    block_body = F.when(closed_inline, F.regexp_replace(body, r"\*/$", "")).otherwise(body)
    return F.when(t.startswith("//"), _mark(body)).when(block, _mark(block_body)).otherwise(t)


def _hash_token(t: Column) -> Column:
    comment = t.startswith("#")
    triple = (F.length(t) >= 3) & (t.startswith('"""') | t.startswith("'''"))
    spans = triple & t.contains("\n")
    return (
        F.when(comment, _mark(F.substring(t, F.lit(2), F.length(t))))
        .when(
            spans,
            F.concat(
                _mark(F.regexp_extract(t, HASH_BLOCK, 1)), F.regexp_extract(t, HASH_BLOCK, 3)
            ),
        )
        .when(triple & t.rlike(HASH_INLINE), F.lit(""))
        .when(triple, _mark(t))
        .otherwise(t)
    )


def _sql_line(s: Column) -> Column:
    """A stretch of one line: its first block comment goes, then the rest after --."""
    has_block = s.rlike(SQL_INLINE)
    rest = F.when(
        has_block, F.concat(F.regexp_extract(s, SQL_INLINE, 1), F.regexp_extract(s, SQL_INLINE, 3))
    ).otherwise(s)
    block = F.when(has_block, _mark(F.regexp_extract(s, SQL_INLINE, 2))).otherwise("")
    dashes = F.locate("--", rest)
    code = F.when(dashes > 0, F.substring(rest, F.lit(1), dashes - 1)).otherwise(rest)
    tail = F.when(dashes > 0, _mark(F.substring(rest, dashes + 2, F.length(rest)))).otherwise("")
    return F.concat(code, block, tail)


def _sql_token(t: Column) -> Column:
    """An open block keeps its code in front; the line that closes it loses its head."""
    opens = t.contains("/*") & (t.contains("\n") | ~t.rlike(SQL_INLINE))
    later = F.regexp_extract(t, SQL_BLOCK, 3)
    inner = F.regexp_replace(later, r"[^\n]*\*/\z", "")
    closed = t.contains("\n")
    return (
        F.when(t == "\n", t)
        .when(
            opens,
            F.concat(
                F.regexp_extract(t, SQL_BLOCK, 1),
                _mark(F.regexp_extract(t, SQL_BLOCK, 2)),
                F.when(closed, F.concat(F.lit("\n"), _mark(inner))).otherwise(""),
            ),
        )
        .otherwise(_sql_line(t))
    )


def comment_style(path: Column) -> Column:
    ext = paths.suffix(path)
    return (
        F.when(ext.isin(*dims.HASH_EXTENSIONS), "hash")
        .when(ext.isin(*dims.C_STYLE_EXTENSIONS), "c")
        .when(ext.isin(*dims.SQL_EXTENSIONS), "sql")
        .otherwise("none")
    )


def marked_content(content: Column, style: Column) -> Column:
    """The text with every comment wrapped in control characters."""
    unix = F.regexp_replace(text.unix_newlines(content), f"[{OPEN}{CLOSE}]", " ")
    clean = F.when(unix.endswith("\n"), unix).otherwise(F.concat(unix, F.lit("\n")))

    def rebuilt(pattern: str, fix) -> Column:
        tokens = F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
        return F.array_join(F.transform(tokens, fix), "")

    return (
        F.when(style == "hash", rebuilt(HASH_TOKENS, _hash_token))
        .when(style == "c", rebuilt(C_TOKENS, _c_token))
        .when(style == "sql", rebuilt(SQL_TOKENS, _sql_token))
        .otherwise(clean)
    )


def code_part(line: Column) -> Column:
    return F.when(
        line.contains(OPEN), F.regexp_replace(line, f"{OPEN}[^{CLOSE}]*{CLOSE}", "")
    ).otherwise(line)


def comment_part(line: Column) -> Column:
    marked = F.regexp_extract_all(line, F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))
    return F.when(line.contains(OPEN), F.array_join(marked, "")).otherwise("")


def comment_split(source_files: DataFrame) -> DataFrame:
    """(repo_id, path, line_number, code, comment), one row per line."""
    return numbered_lines(source_files).select(
        "repo_id",
        "path",
        "line_number",
        code_part(F.col("line")).alias("code"),
        comment_part(F.col("line")).alias("comment"),
    )


def marked_lines(marked: Column) -> Column:
    """Lines of a marked text, which ends in a newline, perhaps inside a comment."""
    return F.split(F.regexp_replace(marked, f"\n[{OPEN}{CLOSE}]*\\z", ""), "\n", -1)


def numbered_lines(source_files: DataFrame) -> DataFrame:
    """Marked lines with their numbers. The text is marked once, in its own column."""
    marked = marked_content(F.col("content"), comment_style(F.col("path")))
    return (
        source_files.filter(F.col("content") != "")
        .select("repo_id", "path", marked.alias("marked"))
        .select("repo_id", "path", F.posexplode_outer(marked_lines(F.col("marked"))).alias("pos", "line"))
        .filter(F.col("pos").isNotNull())
        .select("repo_id", "path", (F.col("pos") + 1).cast("long").alias("line_number"), "line")
    )
