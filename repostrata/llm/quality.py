"""Quality classifier: logistic regression over hashed word n-grams, learned by
follow-the-regularised-leader updates and scored as a sparse dot product.

A text is a row of words and of runs of other marks. Its features are hashed one- and
two-grams of them as written, and one- to three-grams of their shapes (letters by case,
digits, kind of mark, and whether a word repeats the one before), which also speak of
words never seen before. Each family's values are counts divided by the text's length.

Learning takes at most `train_rows` labelled documents, by hash order. They are dealt to
a fixed number of shards; in each of a few rounds every shard runs through its examples
from the common state, and the changes of all shards are added up. Every document is
scored over its whole text.

Defined cases: a null text counts as an empty one, and an empty one gets the score of the
bias alone; rows with equal ids are scored each by itself; an id labelled twice counts
once with its larger label; without labels of both kinds every score is the share of label 1 seen, or 0.5; an
empty table gives an empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import map_arrow, store

BITS = 18
TRAIN_ROWS = 20_000
SHARDS = 4
ROUNDS = 3
#: Learning rate and regularisation of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-3
KEEP_WORDS = 1_000_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


def _shape(word: str) -> int:
    """A small number for what a word looks like."""
    if not (word[0].isalnum() or word[0] == "_"):
        return 16 + zlib.crc32(word[:2].encode()) % 100 + 100 * (len(word) > 2)
    if word.isdigit():
        return 1
    if word.isupper():
        return 2 if len(word) > 1 else 3
    if word.islower():
        return 4 + (len(word) > 3) + (len(word) > 8) + (len(word) > 16)
    if word[0].isupper() and word[1:].islower():
        return 8
    return 9 + any(c.isdigit() for c in word)


class Words(dict):
    """Word to hash and shape in one number, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEEP_WORDS:
            self.clear()
        self[word] = code = zlib.crc32(word.encode("utf-8", "surrogatepass")) << 8 | _shape(word) & 255
        return code


def features(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all n-gram occurrences and the value of each."""
    found = TOKEN.findall(text)
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0)
    codes = np.array([words[w] for w in found], dtype=np.int64)
    mask = (1 << BITS) - 1
    shape = codes & 255
    shape[1:] += 256 * (codes[1:] == codes[:-1])
    with np.errstate(over="ignore"):
        word = (codes >> 8) * np.int64(0x9E3779B1)
        form = (shape + 1) * np.int64(0x85EBCA77C2B2)
        families = [
            word, word[:-1] * 31 + word[1:] * 7,
            form, form[:-1] * 37 + form[1:] * 11, form[:-2] * 41 + form[1:-1] * 13 + form[2:] * 3,
        ]
        places = [(f ^ (f >> 29) ^ (i * 0x5BD1E995)) & mask for i, f in enumerate(families)]
    values = [np.full(len(f), (1.0 if i < 2 else 2.0) / len(f)) for i, f in enumerate(families) if len(f)]
    return np.concatenate(places), np.concatenate(values)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of a state of the leader; the last one is the bias, which is not regularised."""
    strength = np.full(len(z), L1)
    strength[-1] = 0
    return np.where(np.abs(z) <= strength, 0, -(z - np.sign(z) * strength) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def updates(examples: Iterator[tuple[float, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of per-coordinate updates, in place."""
    for label, at, value in examples:
        w = weights_at(z, n, at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
        z[at] += g - sigma * w
        n[at] += g * g


def weights_at(z: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights at distinct places; the bias comes last."""
    own, strength = z[at], np.full(len(at), L1)
    strength[-1] = 0
    return np.where(np.abs(own) <= strength, 0, -(own - np.sign(own) * strength) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))


def _round(examples: DataFrame, z: np.ndarray, n: np.ndarray) -> DataFrame:
    """What one pass of each shard from the common state adds to it."""
    state = examples.sparkSession.sparkContext.broadcast((z, n))  # of fixed size

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.copy() for x in state.value)
        rows, bias = rows.sort_values(["turn", "id"]), len(z) - 1
        updates(
            ((y, np.append(p, bias), np.append(v, 1.0)) for y, p, v in zip(rows["y"], rows["places"], rows["values"], strict=True)),
            z, n,
        )
        return pd.DataFrame({"z": [(z - state.value[0]).tobytes()], "n": [(n - state.value[1]).tobytes()]})

    return examples.groupBy("shard").applyInPandas(shard, "z binary, n binary")


def train(docs: DataFrame, labels: DataFrame, eligible: Column, text: str = "text", doc_id: str = "doc_id",
          label: str = "quality", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Weights (bias last) learned from eligible labelled documents; `eligible` is a
    condition on the column `id`. Also the share of label 1 among them."""
    wanted = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).where(eligible).where(
        "id is not null and y is not null"
    ).groupBy("id").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit("quality"), F.col("id"))
    chosen = store(wanted.orderBy(order, "id").limit(train_rows), "labelled")  # bounded sample
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(chosen, "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            places, values = [], []
            for t in batch.column("text").to_pylist():
                at, value = features(t or "", words)
                own, where = np.unique(at, return_inverse=True)
                places.append(own.astype(np.int32).tolist())
                values.append(np.bincount(where, weights=value, minlength=len(own)).astype(np.float32).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("y"), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                names=["id", "y", "places", "values"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    examples = store(
        map_arrow(rows.select("id", "y", "text"), work, f"id {id_type}, y double, places array<int>, `values` array<float>")
        .withColumn("shard", F.pmod(order, F.lit(SHARDS)).cast("int")).withColumn("turn", order),
        "examples",
    )
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    seen = examples.agg(F.avg("y").alias("share"), F.countDistinct("y").alias("kinds")).first()
    if seen["kinds"] < 2:
        return np.zeros(size), 0.5 if seen["share"] is None else float(seen["share"])
    for _ in range(ROUNDS):
        for change in _round(examples, z, n).collect():  # SHARDS rows
            z, n = z + np.frombuffer(change["z"]), n + np.frombuffer(change["n"])
    return weights(z, n), float(seen["share"])


def score(docs: DataFrame, learned: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """Every row as the struct `row` with its score."""
    shared = docs.sparkSession.sparkContext.broadcast(learned)  # of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, share = shared.value
        words, flat = Words(), not w.any()
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                at, value = features(t or "", words)
                out.append(share if flat else float(1 / (1 + np.exp(-np.clip(w[at] @ value + w[-1], -35, 35)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["row", "score"])

    keep = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    return map_arrow(keep, work, StructType([keep.schema["row"], StructField("score", DoubleType())]))
