"""Words of texts as bytes, and item tables in blocks of bounded size.

A word is a run of ASCII letters, digits and anything beyond ASCII, with A-Z lower-cased;
UTF-8 keeps all of this a matter of single bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import running_totals

#: Bytes of a text that are split into words at a time.
SLICE = 1 << 22

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def cut_at(data: bytes, stops: bytes, size: int = SLICE) -> Iterator[bytes]:
    """Pieces of about `size` bytes that end before one of the bytes `stops`, or at the end."""
    at = 0
    while len(data) - at > size:
        ends = [e for e in (data.find(bytes([s]), at + size) for s in stops) if e >= 0]
        if not ends:
            break
        yield data[at : min(ends)]
        at = min(ends)
    yield data[at:] if at else data


def words_of(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded length."""
    for part in cut_at(text.translate(_TABLE), b" ", size):
        yield part.split()


def texts_of(column: pa.Array) -> list[bytes]:
    """A column of strings as bytes, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


class Numbers(dict):
    """Words to numbers from 1, by first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[Row]]:
    """The rows (item_id, text) with a text, in blocks of about `block_bytes` of text.

    Only one block is ever held by the driver and sent to the tasks, however many items
    there are. Blocks follow the order of (item_id, text).
    """
    named = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    sized = named.withColumn("_size", F.octet_length("text").cast("long"))
    total = sized.agg(F.sum("_size")).first()[0] or 0
    if total <= block_bytes:
        yield named.orderBy("item_id", "text").collect()
        return
    placed = running_totals(sized, ["item_id", "text"], {"_upto": "_size"}).withColumn(
        "_block", F.floor((F.col("_upto") - 1) / block_bytes)
    )
    for row in placed.groupBy("_block").agg(F.count("*")).orderBy("_block").collect():
        yield placed.where(F.col("_block") == row["_block"]).select("item_id", "text").orderBy("item_id", "text").collect()
