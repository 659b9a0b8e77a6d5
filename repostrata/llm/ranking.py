"""Ranked lexical search over classes of equal bags of words.

Documents are restricted to the words of the items: what an item can see of a document
are its counts of those words and m, a measure of its length. Documents in which both
agree form a class (found by hash, verified on the counts themselves), a class is scored
once, and its members follow in the order of their ids.

A word's weight is w = floor(1000 ln((2N + 2) / (2 df + 1))), a document's
m = 10 + (90 n N) div L, and its score the sum of w * ((10^9 tf) div (1000 tf + 8 m)) over
an item's words, once each; N counts the documents with a word, L all words, n a
document's words, df the documents that hold a word. All of it but the logarithm is
integer arithmetic.

Scale: items are taken in blocks of at most `BLOCK_BYTES` of text, each against all
documents, so that what is sent to the tasks is bounded. A document crosses one exchange
as its counts of the block's words; of a class only the `top` smallest ids of each task
cross it, so that any number of copies weighs no more than a few. Tasks keep the `top`
best classes of each item, and only those are expanded: the classes of an item's best
documents are among its `top` best by score and smallest id.

Defined cases: a null or empty text has no words and isn't counted by N; a document with
a null id counts in N, L and df but can't be returned; rows that share an id are documents
of their own; items that share an id are ranked each by itself; an item without words, or
without a document that scores above 0, has no rows; equal scores rank by doc_id; an empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, store
from .words import Numbers, item_blocks, texts_of, words_of

TOP = 10
BLOCK_BYTES = 4 << 20
#: Scores (classes x items) that a task holds at a time.
CELLS = 2_000_000


def bags(docs: DataFrame, words: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): words of a document, and which of `words` (their numbers, in
    order) it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # of one block

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, terms, tfs, ends = [], [], [], [0]
            for text in texts_of(batch.column(1)):
                n, known = 0, np.empty(0, dtype=np.int64)
                for part in words_of(text):
                    n += len(part)
                    codes = np.fromiter(map(number, part, repeat(-1)), dtype=np.int64, count=len(part))
                    known = np.concatenate([known, codes[codes >= 0]])
                kinds, counts = np.unique(known, return_counts=True)
                sizes.append(n)
                terms.append(kinds.astype(np.int32))
                tfs.append(counts)
                ends.append(ends[-1] + len(kinds))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*terms, np.empty(0, np.int32)]))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*tfs, np.empty(0, np.int64)]).astype(np.int64))),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return map_arrow(own, work, "doc_id long, n long, terms array<int>, tfs array<long>")


def classes(bagged: DataFrame, totals: tuple[int, int], top: int = TOP) -> DataFrame:
    """(m, terms, tfs, members): each distinct bag with m, and its `top` smallest ids."""
    n_docs, n_words = (F.lit(str(x)).cast("decimal(38,0)") for x in totals)
    m = F.lit(10) + F.call_function("div", F.col("n").cast("decimal(19,0)") * (F.lit(90).cast("decimal(2,0)") * n_docs), n_words)
    keyed = bagged.where("doc_id is not null and size(terms) > 0").withColumn("m", m.cast("long")).withColumn(
        "h", F.xxhash64("terms", "tfs", "m")
    )
    own = ["h", "m", "terms", "tfs"]  # the hash decides nearly always; the rest verifies it
    first = Window.partitionBy(*own).orderBy("doc_id")
    few = keyed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= top)
    return few.groupBy(*own).agg(F.sort_array(F.collect_list("doc_id")).alias("members")).drop("h")


def _best(scores: np.ndarray, first: np.ndarray, which: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each column's `top` rows by falling score, then first id."""
    by = np.lexsort((first, -scores), axis=0)[:top]
    return tuple(np.take_along_axis(x, by, 0) for x in (scores, first, which))


def score_classes(found: DataFrame, weight: np.ndarray, posting: tuple[np.ndarray, np.ndarray], items: int, top: int = TOP,
                  cells: int = CELLS) -> DataFrame:
    """(item, score, members): the `top` best classes of each item in each task. `posting`
    are the items of each word, as offsets and item numbers."""
    shared = found.sparkSession.sparkContext.broadcast((weight, *posting))  # of one block

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, offsets, holders = shared.value
        kept: dict[int, list[int]] = {}  # members of the classes that are among the best
        best = tuple(np.zeros((0, items), dtype=np.int64) for _ in range(3))
        seen = 0
        step = max(1, cells // max(1, items))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                m, terms, tfs = part.column(0).to_numpy(), part.column(1), part.column(2)
                sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), sizes)
                word, tf = terms.flatten().to_numpy(), tfs.flatten().to_numpy()
                gain = weight[word] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                lens = offsets[word + 1] - offsets[word]
                entry = np.repeat(np.arange(len(word)), lens)
                item = holders[np.arange(len(entry)) - np.repeat(np.cumsum(lens) - lens, lens) + offsets[word][entry]]
                scores = np.zeros(part.num_rows * items, dtype=np.int64)
                np.add.at(scores, row[entry] * items + item, gain[entry])
                scores = scores.reshape(part.num_rows, items)
                members = part.column(3)
                first = members.flatten().to_numpy()[members.offsets.to_numpy()[:-1] - members.offsets[0].as_py()]
                by = np.argsort(first, kind="stable")
                own = by[np.argsort(-scores[by], axis=0, kind="stable")[:top]]  # top x items
                best = _best(
                    np.concatenate([best[0], np.take_along_axis(scores, own, 0)]), np.concatenate([best[1], first[own]]),
                    np.concatenate([best[2], own + seen]), top,
                )
                used = set(best[2][best[0] > 0].tolist())
                kept = {c: kept[c] if c in kept else members[c - seen].as_py() for c in used}
                seen += part.num_rows
        at, item = np.nonzero(best[0] > 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item.astype(np.int64)), pa.array(best[0][at, item]),
                pa.array([kept[c] for c in best[2][at, item].tolist()], pa.list_(pa.int64())),
            ],
            names=["item", "score", "members"],
        )

    return map_arrow(found.select("m", "terms", "tfs", "members"), work, "item long, score long, members array<long>")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES, cells: int = CELLS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `top` highest-scoring documents."""
    spark, ranked = docs.sparkSession, None
    for rows in item_blocks(items, item_id, item_text, block_bytes):
        numbers = Numbers()
        held = [sorted({n - 1 for part in words_of(r["text"].encode()) for n in numbers.of(part).tolist()}) for r in rows]
        bagged = store(bags(docs, list(numbers), doc_id, text), "bags")
        totals = bagged.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(numbers), dtype=np.int64)
        for r in bagged.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toLocalIterator():
            df[r["t"]] = r["n"]
        weight = np.floor(1000 * np.log((2.0 * totals[0] + 2) / (2.0 * df + 1))).astype(np.int64)
        pairs = sorted((w, i) for i, own in enumerate(held) for w in own)
        offsets = np.searchsorted([w for w, _ in pairs], np.arange(len(numbers) + 1))
        holders = np.array([i for _, i in pairs], dtype=np.int64)
        scored = score_classes(classes(bagged, (totals[0], max(1, totals[1])), top), weight, (offsets, holders), len(rows), top, cells)
        first = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        few = scored.select("item", "score", F.explode("members").alias("doc_id")).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
        named = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[item_id].dataType)])
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], named)  # of one block
        block = few.join(ids, "item").select("item_id", "rank", "doc_id", "score")
        ranked = block if ranked is None else ranked.unionByName(store(block, "ranked"))
    return ranked
