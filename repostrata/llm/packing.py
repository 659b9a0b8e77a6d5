"""Packing token sequences by minimum bin slack.

Every document becomes token ids with id 0 after them and is cut into pieces of the
window's length and one remainder. Only how many pieces of each length there are (at
most 1024 numbers) goes to the driver, where a bitset subset-sum finds, again and again,
the multiset of lengths that fills a window closest to its capacity. Each such pattern is
used as often as the counts allow. Pieces get their rank among those of their length from
stored per-partition counts, and the rank says which pattern, window and place they take:
no text or token is shuffled and no length, however frequent, meets in one task.

Defined cases: a null text is an empty one (the end id alone); rows with equal or null
ids are separate documents; a text of any length is cut whole; an empty table gives an
empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, store

WINDOW = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, place long"

#: Texts of these characters (Latin, Greek, Cyrillic) are split here, as the tokenizer would:
#: every version of Unicode in use agrees on their kinds.
LAST_PLAIN = 0x52F
PLAIN = re.compile(f"[\\x00-\\u{LAST_PLAIN:04x}]*")
#: Pieces of text whose ids a worker remembers (twice as many at most), and the longest of them.
KEEP_IDS, KEEP_CHARS = 400_000, 64

_encoders: dict = {}


class _Ids(dict):
    """Piece of text to ids, made by the tokenizer's own model and remembered, as 32-bit little-endian
    numbers. What was not asked for while KEEP_IDS others were is forgotten."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.model, self.older = tokenizer.model, {}
        printable = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        names = {c: chr(c) for c in printable} | {c: chr(256 + n) for n, c in enumerate(c for c in range(256) if c not in printable)}
        if set(names.values()) != set(ByteLevel.alphabet()):
            raise ValueError("the tokenizer's bytes have other names")
        self.names = {chr(c): name for c, name in names.items()}  # latin-1 character to name
        self.table = str.maketrans(self.names)

    def __missing__(self, piece: str) -> bytes:
        if len(self) > KEEP_IDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = _bytes([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.table))])
        if len(piece) <= KEEP_CHARS:
            self[piece] = ids
        return ids


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def plain_pattern(pattern: str) -> re.Pattern:
    """The tokenizer's pattern for plain texts, with the characters of each kind written out, which
    the regular expressions of the standard library split by in half the time."""
    import regex

    def ranges(kind: str) -> str:
        own = [c for c in range(LAST_PLAIN + 1) if regex.match(kind, chr(c))]
        starts, ends = [c for c in own if c - 1 not in own], [c for c in own if c + 1 not in own]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))

    letters, numbers, blanks = ranges(r"\p{L}"), ranges(r"\p{N}"), ranges(r"\s")
    for kind, own in ((r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"),
                      (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{blanks}]"), (r"\S", f"[^{blanks}]")):
        pattern = pattern.replace(kind, own)
    return re.compile(pattern)


def byte_encoder(tokenizer_path: str):
    """A function from texts to ids, those of the tokenizer file, as 32-bit little-endian numbers.

    The tokenizer first splits a text by a fixed pattern, and no merge crosses a split. So
    plain texts are split here, and the ids of each piece, made by the tokenizer's model,
    are remembered. Texts with other characters, and those that name a special token, go
    through the tokenizer whole.
    """
    if tokenizer_path in _encoders:
        return _encoders[tokenizer_path]
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    split, ids = plain_pattern(public_tokenizers.PATTERN).findall, _Ids(tokenizer)

    def encode(texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if (text.isascii() or PLAIN.fullmatch(text)) and not any(s in text for s in special):
                yield b"".join(map(ids.__getitem__, split(text)))
            else:
                yield _bytes(tokenizer.encode(text, add_special_tokens=False).ids)

    _encoders[tokenizer_path] = encode
    return encode


def encoder(tokenizer_path: str):
    """A function from texts to lists of ids, those of the tokenizer file."""
    encode = byte_encoder(tokenizer_path)
    return lambda texts: (np.frombuffer(ids, dtype="<u4").tolist() for ids in encode(texts))


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
           tokenizer_path: str | None = None) -> DataFrame:
    """Stored pieces: where each starts in its document, its length and crc32, the
    partition that made it and its place among the pieces of its length there."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path(TOKENIZER)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = byte_encoder(path), TaskContext.get().partitionId()
        seen, end = [0] * (window + 1), _bytes([END_ID])
        for batch in batches:
            out: list[tuple] = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for key, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                data = ids + end
                tokens = len(data) // 4
                for start in range(0, tokens, window):
                    own = data[4 * start : 4 * (start + window)]
                    length = len(own) // 4
                    out.append((key, start, length, zlib.crc32(own), tokens, part, seen[length]))
                    seen[length] += 1
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    NAMES = [c.split()[0] for c in PIECES.split(", ")]
    TYPES = [pa.int32() if c.endswith("int") else pa.int64() for c in PIECES.split(", ")]
    return store(map_arrow(docs.select(F.col(doc_id).cast("long"), F.col(text)), cut, PIECES), "pieces")


def fill(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, {length: how many}) that use up all counts.

    The longest remaining length is always in; a bitset holds the sums that others can
    add, one layer per length, and the best sum is traced back through the layers.
    """
    left, made = {n: c for n, c in counts.items() if c}, []
    while left:
        first = max(left)
        room, layers, bits = window - first, [], 1
        for n in sorted((n for n in left if n <= room), reverse=True):
            most = min(left[n] - (n == first), room // n)
            before, step = bits, 1
            while most > 0:
                take = min(step, most)
                bits |= (bits << (take * n)) & ((2 << room) - 1)
                most, step = most - take, step * 2
            layers.append((n, before))
            if bits >> room & 1:
                break
        rest, used = bits.bit_length() - 1, {first: 1}
        for n, before in reversed(layers):
            while not before >> rest & 1:
                used[n] = used.get(n, 0) + 1
                rest -= n
        times = min(left[n] // k for n, k in used.items())
        made.append((times, used))
        left = {n: c for n in left if (c := left[n] - times * used.get(n, 0))}
    return made


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
         tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece, with the sequence it goes to and its offset there."""
    cut = pieces(docs, doc_id, text, window, tokenizer_path)
    made = store(cut.groupBy("part", "length").count(), "counts")
    # at most `window` rows
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    # for each length: the ranks from which a pattern takes it, and what the pattern does with them
    steps: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    taken, sequence = dict.fromkeys(counts, 0), 0
    for times, used in fill(counts, window):
        offset = 0
        for n, k in sorted(used.items(), reverse=True):
            steps[n].append((taken[n], k, sequence, offset))
            taken[n] += k * times
            offset += n * k
        sequence += times
    plan = {n: np.array(rows, dtype=np.int64) for n, rows in steps.items()}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequences, offsets = np.empty_like(ranks), np.empty_like(ranks)
            for n in np.unique(lengths):
                own, rows = np.flatnonzero(lengths == n), plan[int(n)]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], side="right") - 1]
                turn = ranks[own] - row[:, 0]
                sequences[own] = row[:, 2] + turn // row[:, 1]
                offsets[own] = row[:, 3] + turn % row[:, 1] * n
            keep = batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pa.RecordBatch.from_arrays(
                [*keep.columns, pa.array(sequences), pa.array(offsets)], names=[*keep.schema.names, "sequence_id", "offset"]
            )

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = made.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["part", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("place")).alias("rank")
    )
    return map_arrow(
        ranked, put, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
