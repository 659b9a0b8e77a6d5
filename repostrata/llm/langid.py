"""Language identification by prediction by partial matching.

For every language a tree of byte contexts up to three bytes long, counted over the
lower-cased text of a bounded sample of labelled documents, predicts the next byte. A
byte not seen after a context is left to the context one byte shorter: the escape costs
distinct / (total + distinct), and what the longer context has seen is excluded below.
The statistics are frozen, so each language's exact code length of a document is a sum of
table entries, and the shortest names the language. The score is the probability of that
language if all were equally likely before.

A text that fits no learned language still has a shortest code. `known` tells whether its
code is about as short, by byte, as that of learned documents of the language found: a
fifth of the sample is kept out of the trees and gives each language's usual bits a byte.

Learning is bounded by about `train_rows` documents per language, drawn by hash. A tree
holds what was seen and nothing else, so its size follows from its own sample, whatever
the number of languages, and no context is left out. Every document is scored over its
whole text, `SLICE` bytes at a time.

Defined cases: a null text or one without a letter gets `und` with score 0 and isn't
known, as does every text when there is nothing to learn from; a tie goes to the language
first by code point; rows with equal ids are scored each by itself; a language of too few
documents to keep some out takes every text for known; an empty table gives an empty
result; other columns of the input are never looked at.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _ship, map_arrow, store

ORDER = 3
TRAIN_ROWS = 1000
#: One in so many sampled documents measures what is usual instead of being learned from.
KEPT_OUT = 5
#: A known text has at most so many times the bits a byte that only one in a hundred of
#: the language's own documents exceeds, after `FREE_BITS` for names and short texts.
LOOSE, FREE_BITS = 1.75, 400
UNDETERMINED = "und"
SLICE = 1 << 22
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Tree:
    """Frozen statistics of a language. `dense` are the bits of each byte after each other
    one; for each longer context length, the bits of what was seen (sorted codes of context
    and byte) and those of the escape (sorted codes of contexts)."""

    dense: np.ndarray
    seen: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of four after the others."""
        out = self.dense[grams & 0xFFFF]
        for length, own, escape in zip(range(2, ORDER + 1), self.seen, self.escapes, strict=True):
            part = grams & ((1 << 8 * (length + 1)) - 1)
            out = out + _found(escape, part >> 8, 0.0)
            here = _found(own, part, np.nan)
            out = np.where(np.isnan(here), out, here)
        return out


@dataclass
class Model:
    """A tree for each language, and the most bits a byte of a text that fits it."""

    languages: list[str]
    trees: list[Tree]
    limits: np.ndarray = field(default_factory=lambda: np.empty(0))


def _found(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray, missing: float) -> np.ndarray:
    keys, values = table
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, values[at], missing)


def _lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").replace(b"\0", b" ")


def _parts(text: str) -> Iterator[bytes]:
    """A text in slices, each with the three bytes before it; zeros stand before the start."""
    data = b"\0" * ORDER + _lowered(text)
    for at in range(0, len(data) - ORDER, SLICE):
        yield data[at : at + SLICE + ORDER]


def _windows(parts: list[bytes]) -> np.ndarray:
    """The four bytes that end at each byte of the parts, as numbers, but for those before a part."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
    codes = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    lens = np.array([len(p) for p in parts])
    starts = np.cumsum(lens) - lens
    keep = np.ones(len(codes), dtype=bool)
    for before in range(1, ORDER + 1):
        keep[starts[1:] - before] = False
    return codes[keep]


def _blocks(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Slices of texts, with the numbers of their texts, in blocks of about `SLICE` bytes."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for part in _parts(text):
            owners.append(i)
            parts.append(part)
            size += len(part)
            if size >= SLICE:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def count_grams(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) of a sample of (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.setdefault(lang, []).append(text or "")
            for lang, texts in rows.items():
                for _, parts in _blocks(texts):
                    grams, n = np.unique(_windows(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    counted = map_arrow(sample.select("lang", "text"), work, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def grow(gram: np.ndarray, n: np.ndarray) -> Tree:
    """The tree of counted four-byte windows."""
    below = np.full(256, 1 / 255)  # of a byte after no context
    seen, escapes, last = [], [], None
    dense = np.empty(0)
    for length in range(ORDER + 1):
        codes, inverse = np.unique(gram & ((1 << 8 * (length + 1)) - 1), return_inverse=True)
        counts = np.bincount(inverse, weights=n)
        contexts, at = np.unique(codes >> 8, return_inverse=True)
        total, kinds = np.bincount(at, weights=counts), np.bincount(at)
        shorter = below[codes & 255] if last is None else last[1][np.searchsorted(last[0], codes & ((1 << 8 * length) - 1))]
        rest = 1 - np.bincount(at, weights=shorter)
        own = counts / (total + kinds)[at]
        escape = kinds / (total + kinds) / np.maximum(rest, 1e-6)
        if length == 0:
            table = below * escape[0]
            table[codes] = own
        elif length == 1:
            spread = np.ones(256)
            spread[contexts] = escape
            dense = (spread[:, None] * table[None, :]).reshape(-1)
            dense[codes] = own
        else:
            seen.append((codes.astype(np.uint32), -np.log2(own).astype(np.float32)))
            escapes.append((contexts.astype(np.uint32), -np.log2(escape).astype(np.float32)))
        last = codes, own
    return Tree(-np.log2(np.maximum(dense, 1e-12)).astype(np.float32), seen, escapes)


def code_lengths(model: Model, texts: list[str]) -> np.ndarray:
    """Bits of every text under every language."""
    out = np.zeros((len(texts), len(model.trees)))
    for owners, parts in _blocks(texts):
        kinds, which = np.unique(_windows(parts), return_inverse=True)
        lens = np.array([len(p) - ORDER for p in parts])
        starts, kinds = np.cumsum(lens) - lens, kinds.astype(np.uint32)
        for number, tree in enumerate(model.trees):
            np.add.at(out[:, number], owners, np.add.reduceat(tree.bits(kinds)[which], starts, dtype=np.float64))
    return out


def train(docs: DataFrame, eligible: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          train_rows: int = TRAIN_ROWS) -> Model | None:
    """Learn from about `train_rows` eligible documents of each language, by hash."""
    named = docs.where(eligible).select(
        F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.lit("langid"), F.col(f"`{doc_id}`")).alias("h"),
    ).where("lang is not null")
    share = named.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(train_rows)) / F.count("*")).alias("share"))
    drawn = named.where("text is not null").join(F.broadcast(share), "lang").where(  # a row for each language, as in the model
        F.pmod("h", F.lit(1_000_003)) < F.col("share") * 1_000_003
    )
    sample = store(drawn.select("lang", "text", (F.pmod(F.xxhash64("h"), F.lit(KEPT_OUT)) == 0).alias("out")), "sample")
    counted = count_grams(sample.where("not out"))
    _ship(docs.sparkSession)
    grown = counted.groupBy("lang").applyInPandas(_grow_rows, "lang string, tree binary")
    trees = {r["lang"]: pickle.loads(r["tree"]) for r in grown.toLocalIterator()}  # as large as the sample allows
    if not trees:
        return None
    languages = sorted(trees)
    model = Model(languages, [trees[x] for x in languages], np.full(len(languages), np.inf))
    usual = _bits_a_byte(sample.where("out"), model).groupBy("lang").agg(F.percentile_approx("rate", 0.99).alias("rate"), F.count("*").alias("n"))
    for r in usual.where("n >= 20").toLocalIterator():
        model.limits[languages.index(r["lang"])] = LOOSE * r["rate"]
    return model


def _grow_rows(rows: pd.DataFrame) -> pd.DataFrame:
    tree = grow(rows["gram"].to_numpy(), rows["n"].to_numpy(dtype=float))
    return pd.DataFrame({"lang": rows["lang"].iloc[:1], "tree": [pickle.dumps(tree)]})


def _bits_a_byte(sample: DataFrame, model: Model) -> DataFrame:
    """(lang, rate) of labelled documents under their own language, less the free bits."""
    shared = sample.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        number = {x: i for i, x in enumerate(model.languages)}
        for batch in batches:
            own = [(x, t) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if x in number and LETTER.search(t)]
            bits = code_lengths(model, [t for _, t in own])
            rates = [_rate(bits[i, number[x]], t) for i, (x, t) in enumerate(own)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array(rates, pa.float64())], names=["lang", "rate"])

    return map_arrow(sample.select("lang", "text"), work, "lang string, rate double")


def _rate(bits: float, text: str) -> float:
    return max(0.0, bits - FREE_BITS) / len(text.encode("utf-8", "surrogatepass"))


def predict(docs: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Every row as the struct `row` of the columns `carry` (all, if not given) with
    lang_pred, score and known."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size
    carry = docs.columns if carry is None else carry

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = batch.column(0)
            texts = (rows.field(carry.index(text)) if text in carry else batch.column(1)).to_pylist()
            names, scores, known = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            own = [i for i, t in enumerate(texts) if model and t and LETTER.search(t)]
            if own:
                bits = code_lengths(model, [texts[i] for i in own])
                best, least = bits.argmin(1), bits.min(1)
                odds = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                for at, (i, b) in enumerate(zip(own, best, strict=True)):
                    names[i], scores[i] = model.languages[b], 1 / odds[at]
                    known[i] = _rate(least[at], texts[i]) <= model.limits[b]
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(names, pa.string()), pa.array(scores), pa.array(known)], names=["row", "lang_pred", "score", "known"]
            )

    keep = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *([] if text in carry else [F.col(f"`{text}`").alias("text")]))
    found = T.StructType([
        keep.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.BooleanType()),
    ])
    return map_arrow(keep, work, found)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", eligible: Column | None = None) -> DataFrame:
    """Learn from the labelled rows and predict every row."""
    usable = eligible if eligible is not None else F.lit(True)
    return predict(docs, train(docs, usable, text, lang, doc_id), text)
