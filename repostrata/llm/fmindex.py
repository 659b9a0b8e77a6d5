"""Benchmark decontamination with an FM-index per training shard.

The documents of a task form shards of about `SHARD_WORDS` words. Over the words of a
shard the suffix array is built by prefix doubling, and from it the Burrows-Wheeler
transform as a wavelet matrix with ranks in constant time. The windows of the benchmark
(ten consecutive words of an item, or the whole of a shorter one) are searched backwards,
all at once; what occurs is located by stepping back to the next sampled suffix position.
Occurrences of a document are merged into spans, which can be cut out.

Scale: no shuffle and no pass through the driver but of the benchmark, which is sent in
blocks of at most `BLOCK_BYTES` of text, one pipelined step per block. A task holds one
shard; a document longer than a shard goes through several that overlap by nine words.

Defined cases: a null or empty text has no words and is clean; rows that share an id are
documents of their own, as are rows with a null id; items without a word, text or id
mark nothing (an item's id names it, so without one it can't be told which item is
leaked); items that share an id count once; equal windows of several items are searched
once and count for each; an empty benchmark leaves every document clean; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow
from .words import SLICE, Numbers, item_blocks, texts_of, words_of

WINDOW = 10
SHARD_WORDS = 1 << 20
#: Every so many positions of a shard keep their suffix position.
SAMPLE = 32
BLOCK_BYTES = 32 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Bits:
    """A bit vector with constant-time rank: words of 64 bits and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, dtype=np.uint8)]).view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.ones = int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of the suffixes of numbers in which 0 ends a document. Ends differ from one
    another, so that no comparison passes one; `seq` closes with an end."""
    ends = seq == 0
    rank = np.where(ends, np.cumsum(ends) - 1, seq + int(ends.sum()) - 1)
    bits = max(1, int(rank.max()).bit_length())
    n, width = len(seq), max(1, 62 // bits)
    padded = np.concatenate([rank, np.zeros(width, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(width):
        key = key << bits | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    places = np.arange(n)
    open_ = places
    while True:
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[open_]] = np.maximum.accumulate(np.where(fresh, open_, 0))
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        if not len(open_):
            return order
        mine = order[open_]
        key = rank[mine] * n + rank[mine + width]
        by = np.argsort(key, kind="stable")
        order[open_], key = mine[by], key[by]
        width *= 2


class FMIndex:
    """Words of one shard: transform, wavelet ranks, and sampled suffix positions."""

    def __init__(self, seq: np.ndarray, kinds: int):
        order = suffix_array(seq)
        transform = seq[order - 1]
        self.height = max(1, kinds.bit_length())
        counts = np.bincount(seq, minlength=1 << self.height)
        self.first = np.cumsum(counts) - counts
        self.size = len(seq)
        self.levels: list[tuple[Bits, int]] = []
        at = transform
        for shift in range(self.height - 1, -1, -1):
            bit = (at >> shift & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            at = np.concatenate([at[~bit], at[bit]])
        # where each word's run begins below the last level, whose order is by reversed bits
        turned = np.zeros(1 << self.height, dtype=np.int64)
        for shift in range(self.height):
            turned |= (np.arange(1 << self.height) >> shift & 1) << (self.height - 1 - shift)
        below = np.empty_like(turned)
        by = np.argsort(turned)
        below[by] = np.cumsum(counts[by]) - counts[by]
        self.shift = self.first - below
        kept = (order % SAMPLE == 0) | (transform == 0)
        self.kept, self.positions = Bits(kept), order[kept]

    def back(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """First row of a word, plus its count before row i of the transform."""
        at = i
        for depth, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where(word >> (self.height - 1 - depth) & 1, zeros + ones, at - ones)
        return at + self.shift[word]

    def step(self, i: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer."""
        at, word = i, np.zeros_like(i)
        for bits, zeros in self.levels:
            ones, bit = bits.rank(at), bits.at(at)
            at = np.where(bit, zeros + ones, at - ones)
            word = word << 1 | bit
        return at + self.shift[word]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of equally long phrases, one a row."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size, dtype=np.int64)
        alive = np.flatnonzero((phrases > 0).all(1))
        high[(phrases == 0).any(1)] = 0
        for j in range(phrases.shape[1] - 1, -1, -1):
            word = phrases[alive, j]
            low[alive], high[alive] = self.back(word, low[alive]), self.back(word, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows."""
        out, at, todo, steps = np.empty(len(rows), dtype=np.int64), rows, np.arange(len(rows)), 0
        while len(todo):
            found = self.kept.at(at)
            out[todo[found]] = self.positions[self.kept.rank(at[found])] + steps
            todo, at, steps = todo[~found], self.step(at[~found]), steps + 1
        return out


@dataclass
class Phrases:
    """The distinct windows of a block of items: words, windows by length as numbers of
    words, and the items of each window."""

    words: list[bytes]
    by_length: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]


def windows_of(rows: list, window: int = WINDOW) -> Phrases:
    """The windows of items (item_id, text)."""
    numbers, found = Numbers(), {}
    for row in rows:
        if row["item_id"] is None:
            continue
        own = [n for part in words_of(row["text"].encode("utf-8", "surrogatepass")) for n in numbers.of(part).tolist()]
        k = min(window, len(own))
        for at in range(len(own) - k + 1 if k else 0):
            found.setdefault(tuple(own[at : at + k]), set()).add(str(row["item_id"]))
    by_length: dict[int, list] = {}
    for phrase, items in sorted(found.items()):
        by_length.setdefault(len(phrase), []).append((phrase, sorted(items)))
    return Phrases(
        list(numbers), {k: np.array([p for p, _ in v], dtype=np.int64) for k, v in by_length.items()},
        {k: [i for _, i in v] for k, v in by_length.items()},
    )


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Intervals united; those that touch become one."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    return list(zip(starts[fresh].tolist(), ends[np.append(fresh[1:], True)].tolist(), strict=True))


@dataclass
class _Shard:
    """Pieces of documents of one index; `owner` and `base` tell where each begins."""

    numbers: Numbers = field(default_factory=Numbers)
    pieces: list[np.ndarray] = field(default_factory=list)
    owner: list[int] = field(default_factory=list)
    base: list[int] = field(default_factory=list)
    words: int = 0

    def add(self, piece: np.ndarray, owner: int, base: int) -> None:
        self.pieces.append(piece)
        self.owner.append(owner)
        self.base.append(base)
        self.words += len(piece)

    def hits(self, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, set[str]]]:
        """(owner, first words, ends, items) of each piece in which a window occurs."""
        if not self.words or not phrases.words:
            return
        end = np.zeros(1, dtype=np.int64)
        index = FMIndex(np.concatenate([x for p in self.pieces for x in (p, end)]), len(self.numbers))
        starts = np.cumsum([0, *[len(p) + 1 for p in self.pieces]])
        known = np.array([0, *[self.numbers.get(w, 0) for w in phrases.words]], dtype=np.int64)
        found: dict[int, list] = {}
        for k, windows in phrases.by_length.items():
            low, high = index.search(known[windows])
            n = high - low
            which = np.repeat(np.arange(len(n)), n)
            if not len(which):
                continue
            at = index.locate(np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which])
            piece = np.searchsorted(starts, at, side="right") - 1
            by = np.argsort(piece, kind="stable")
            cuts = np.flatnonzero(np.diff(piece[by])) + 1
            for own in np.split(by, cuts):
                p = int(piece[own[0]])
                first = at[own] - starts[p] + self.base[p]
                items = {i for w in np.unique(which[own]) for i in phrases.items[k][w]}
                found.setdefault(p, []).append((first, first + k, items))
        for p, parts in sorted(found.items()):
            yield (
                self.owner[p], np.concatenate([a for a, _, _ in parts]), np.concatenate([b for _, b, _ in parts]),
                set().union(*[i for _, _, i in parts]),
            )


def _code_points(text: str, hits: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as spans of the text."""
    spans, todo, start = [], iter(hits), 0
    now = next(todo, None)
    for n, word in enumerate(WORD.finditer(text)):
        if now and n == now[0]:
            start = word.start()
        if now and n == now[1] - 1:
            spans.append({"start": start, "end": word.end()})
            now = next(todo, None)
        if now is None:
            break
    return spans


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _search(df: DataFrame, phrases: Phrases, shard_words: int, slice_bytes: int, last: bool) -> DataFrame:
    """One block: adds to `hits` (runs of words) and `items`; the last one adds `spans`."""
    shared = df.sparkSession.sparkContext.broadcast(phrases)  # of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        waiting: list[pa.RecordBatch] = []  # batches whose documents are in the open shard
        state: dict[int, list] = {}  # documents with hits: interval arrays and items
        counts: list[int] = []
        shard = _Shard()

        def flush() -> None:
            nonlocal shard
            for owner, first, end, items in shard.hits(phrases):
                held = state.setdefault(owner, [[], set()])
                held[0].append((first, end))
                held[1] |= items
            shard = _Shard()

        def done() -> Iterator[pa.RecordBatch]:
            base = 0
            for batch in waiting:
                hits, items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                spans: list[list] = [[] for _ in hits]
                for row in range(batch.num_rows):
                    new = state.pop(base + row, None)
                    if new:
                        old = [(h["start"], h["end"]) for h in hits[row]]
                        runs = merged(
                            np.concatenate([*[a for a, _ in new[0]], np.array([a for a, _ in old], dtype=np.int64)]),
                            np.concatenate([*[b for _, b in new[0]], np.array([b for _, b in old], dtype=np.int64)]),
                        )
                        hits[row] = [{"start": a, "end": b} for a, b in runs]
                        items[row] = sorted(new[1] | set(items[row]))
                    if last and hits[row]:
                        spans[row] = _code_points(batch.column("text")[row].as_py(), [(h["start"], h["end"]) for h in hits[row]])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"), *([] if last else [batch.column("text")]),
                        pa.array(counts[base : base + batch.num_rows], pa.int64()), pa.array(hits, _ARROW_SPANS),
                        pa.array(items, pa.list_(pa.string())), *([pa.array(spans, _ARROW_SPANS)] if last else []),
                    ],
                    names=["row", *([] if last else ["text"]), "n_words", "hits", "items", *(["spans"] if last else [])],
                )
                base += batch.num_rows
            waiting.clear()
            counts.clear()

        for batch in batches:
            waiting.append(batch)
            for text in texts_of(batch.column("text")):
                seen, tail = 0, np.empty(0, dtype=np.int64)
                for part in words_of(text, slice_bytes):
                    piece = np.concatenate([tail, shard.numbers.of(part)])
                    shard.add(piece, len(counts), seen - len(tail))
                    seen += len(part)
                    tail = piece[-(WINDOW - 1) :]
                    if shard.words >= shard_words:
                        names = list(shard.numbers) if len(tail) else []
                        again = [names[n - 1] for n in tail.tolist()]
                        flush()
                        tail = shard.numbers.of(again)
                counts.append(seen)
            if shard.words == 0 or shard.words >= shard_words // 2:
                flush()
                yield from done()
        flush()
        yield from done()

    fields = [df.schema["row"], *([] if last else [df.schema["text"]]), T.StructField("n_words", T.LongType()), T.StructField("hits", SPANS),
              T.StructField("items", T.ArrayType(T.StringType())), *([T.StructField("spans", SPANS)] if last else [])]
    return map_arrow(df, run, T.StructType(fields))


def find(docs: DataFrame, benchmark: DataFrame, carry: list[str], text: str = "text", item_id: str = "item_id",
         item_text: str = "text", shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE) -> DataFrame:
    """Every row of `docs` as the struct `row` of the columns `carry`, with n_words, n_hit
    (words inside any occurrence of a window), items (ids of the items with occurring
    windows, as sorted strings) and spans (start, end in code points, to be removed)."""
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text}`").alias("text"),
        F.array().cast(SPANS).alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    blocks = item_blocks(benchmark, item_id, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        ahead = next(blocks, None)
        found = _search(found, windows_of(block), shard_words, slice_bytes, last=ahead is None)
        block = ahead
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select("row", "n_words", hit.alias("n_hit"), "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without the spans in which a window of the benchmark occurs."""
    found = find(docs, benchmark, docs.columns, text, item_id, item_text)
    whole = F.col("row").getField(text)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(whole).cast("long")))
    kept = F.array_join(
        F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda x: F.substring(whole, x["a"].cast("int") + 1, (x["b"] - x["a"]).cast("int"))), ""
    )
    cut = F.when(F.size("spans") > 0, kept).otherwise(whole)
    return found.select(*[(cut if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
