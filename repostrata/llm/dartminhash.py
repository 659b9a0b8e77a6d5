"""MinHash near-dedup with darts.

A document is the weighted set of its five-word shingles, the weight being how often one
occurs; the k-th occurrence of a shingle is the unit region k-1..k of its weight. Hashed
darts fall into the plane of region and rank: for each cell of it a hash of element and
cell says how many (Poisson) and where. All documents see the same darts, and a document
throws only those up to the rank at which some 800 of them hit its regions, so a
signature costs about as much for a long text as for a short one. Of the darts that hit,
the earliest of each coordinate is kept: two documents agree in a coordinate with the
probability of their weighted Jaccard similarity.

Documents with equal shingles are one class from the start. Classes that share a band of
the signature are compared exactly, on all their shingles, and linked from 0.8 on: first
with the smallest id of the band's bucket, then, where a bucket still holds several
components, all outside its largest one with the others. That second step deals a bucket
to blocks of bounded size and compares inside them, so only links leave a task, never pairs.

Defined cases: a text of one to four words is one shingle, a text without words equals
only the same text, a null text links with nothing; rows that share an id are one
document, of which near_dedup keeps one row; a null id links with nothing and is kept; an
empty table gives an empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_of, bucket_links, components, map_arrow, running_totals, store

SHINGLE = 5
THRESHOLD = 0.8
#: 24 bands of 5 find a pair at 0.8 with probability 0.99993.
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
DARTS = COORDINATES * math.log(COORDINATES) + 2 * COORDINATES
#: Ranks below 1 are split at powers of two down to this one, above at whole numbers.
FINEST = 8
#: Elements of one side of a block.
BLOCK = 1_000_000
KEEP_WORDS = 1_000_000
WORD = re.compile(r"\w+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEEP_WORDS:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers of [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def elements(text: str, hashes: Hashes) -> np.ndarray:
    """Hashes of all (shingle, occurrence) pairs of a text, sorted."""
    words = WORD.findall(text.lower())
    if not words:
        return np.array([xxhash.xxh64_intdigest("\0" + text)], dtype=np.uint64)
    codes = np.array([hashes[w] for w in words], dtype=np.uint64)
    width = min(SHINGLE, len(codes))
    total = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = (total + codes[i : len(codes) - width + 1 + i]) * GOLDEN
        total ^= total >> np.uint64(32)
    shingles = np.sort(mixed(total))
    starts = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]]))
    occurrence = np.arange(len(shingles)) - np.repeat(starts, np.diff(starts, append=len(shingles)))
    return np.sort(mixed(shingles + occurrence.astype(np.uint64) * GOLDEN))


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... darts in a cell."""
    return np.cumsum([math.exp(-mean) * mean**i / math.factorial(i) for i in range(20)])


#: Lower bounds and widths of the cells below rank 1, and the distributions by width.
LOW = np.array([0.0, *[2.0 ** -j for j in range(FINEST, 0, -1)]])
WIDE = np.array([2.0**-FINEST, *[2.0 ** -j for j in range(FINEST, 0, -1)]])
COUNTS = {w: _poisson(w) for w in {*WIDE, 1.0}}


def _throw(own: np.ndarray, cells: np.ndarray, low: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and rank of every dart in the given cells of the given elements."""
    place = mixed(own[:, None] ^ mixed((cells + 1).astype(np.uint64) * GOLDEN)[None, :])
    chance = uniform(place)
    none = np.array([COUNTS[w][0] for w in wide])
    row, column = np.nonzero(chance >= none)
    found, chance = place[row, column], chance[row, column]
    n = np.ones(len(found), dtype=np.int64)
    for w in set(wide):
        at = wide[column] == w
        n[at] = np.searchsorted(COUNTS[w], chance[at], side="right")
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    dart = mixed(np.repeat(found, n) + (turn + 1).astype(np.uint64) * GOLDEN)
    column = np.repeat(column, n)
    return dart, low[column] + wide[column] * uniform(mixed(dart ^ GOLDEN))


def signature(own: np.ndarray) -> np.ndarray:
    """The earliest dart of each coordinate."""
    best = np.full(COORDINATES, np.inf)
    kept = np.zeros(COORDINATES, dtype=np.uint64)
    reach, at = DARTS / len(own), 0  # cells before `at` are done
    while np.isinf(best).any():
        if at < len(LOW):
            end = max(at + 1, int(np.searchsorted(LOW, reach)))
            cells = np.arange(at, end)
            low, wide = LOW[at:end], WIDE[at:end]
        else:
            first = at - len(LOW) + 1
            cells = np.arange(at, at + max(1, math.ceil(reach) - first))
            low, wide = cells - len(LOW) + 1.0, np.ones(len(cells))
        dart, rank = _throw(own, cells, low, wide)
        where = (dart % np.uint64(COORDINATES)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        first_rank, first_dart = np.full(COORDINATES, np.inf), np.zeros(COORDINATES, dtype=np.uint64)
        first_rank[where[order]], first_dart[where[order]] = rank[order], dart[order]
        better = first_rank < best
        best[better], kept[better] = first_rank[better], first_dart[better]
        at = int(cells[-1]) + 1
    return kept


def bands(kept: np.ndarray) -> np.ndarray:
    """One key per band."""
    rows = kept.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        key = mixed(key * GOLDEN ^ rows[:, i])
    return key


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, f1, f2, n, bands) of every row with a text: two hashes of all its elements and
    their number name the class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            f1, f2, n = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            keys = np.zeros((len(texts), BANDS), dtype=np.uint64)
            known: dict[bytes, int] = {}
            for i, t in enumerate(texts):
                own = elements(t, hashes)
                f1[i], f2[i] = (int(np.add.reduce(mixed(own ^ s)).astype(np.int64)) for s in (GOLDEN, ~GOLDEN))
                n[i] = len(own)
                same = known.setdefault((f1[i], f2[i], n[i]), i)
                keys[i] = keys[same] if same < i else bands(signature(own))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(f1), pa.array(f2), pa.array(n), lists], names=["id", "f1", "f2", "n", "bands"]
            )

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null and id is not null")
    return map_arrow(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, f1 long, f2 long, n long, bands array<long>")


def _elements_of(rows: DataFrame) -> DataFrame:
    """(id, f1, own = all elements) of (id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for key, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = elements(t, hashes)
                f1 = int(np.add.reduce(mixed(own ^ GOLDEN)).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()], key.type), pa.array([f1]), pa.array([np.sort(own.view(np.int64))], pa.list_(pa.int64()))],
                    names=["id", "f1", "own"],
                )

    return map_arrow(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, f1 long, own array<long>")


def _block_links(mixed: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """Links of members outside their bucket's largest component with members of others.

    `mixed` has (key, id, component, major), `facts` (id, n, bands, own). Either side of a
    bucket is dealt to blocks of about BLOCK elements, and each pair of blocks is a group
    that a task holds by itself. A pair of documents is compared only in the first band
    that they share, and for a document one link per component is enough.
    """
    rows = mixed.join(facts.select("id", "n"), "id").withColumn("loner", F.col("component") != F.col("major"))
    blocks = rows.groupBy("key").agg(
        (1 + F.floor(F.sum("n") / BLOCK)).cast("int").alias("blocks"),
        (1 + F.floor(F.sum(F.when(F.col("loner"), F.col("n"))) / BLOCK)).cast("int").alias("loner_blocks"),
    )
    dealt = rows.join(blocks, "key")
    h = F.xxhash64("id")
    left = dealt.where("loner").select(
        "key", "id", "component", F.lit(0).alias("side"), F.pmod(h, "loner_blocks").cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"),
    )
    right = dealt.select(
        "key", "id", "component", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("loner_blocks") - 1)).alias("x"),
        F.pmod(h, "blocks").cast("int").alias("y"),
    )
    placed = left.unionByName(right).join(facts.select("id", "bands", "own"), "id").select(
        "key", "x", "y", "side", "id", "component", "bands", "own"
    ).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "id")

    def compare(key: int, own: list[list], others: list[list]) -> Iterator[tuple]:
        if not own or not others:
            return
        bands = np.stack([o[2] for o in others])
        band = int(np.flatnonzero(bands[0] == key)[0])
        size = np.array([len(o[3]) for o in others])
        groups = np.array([o[1] for o in others])
        ids = np.array([o[0] for o in others])
        for name, component, keys, mine in own:
            first = (bands[:, : band + 1] == keys[: band + 1]).argmax(1) == band
            least = np.minimum(size, len(mine)) >= threshold * np.maximum(size, len(mine))
            at = np.flatnonzero(first & least & (groups != component))
            if not len(at):
                continue
            every = np.concatenate([others[i][3] for i in at])
            place = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
            shared = np.add.reduceat((mine[place] == every).astype(np.int64), np.concatenate([[0], np.cumsum(size[at])[:-1]]))
            linked = at[shared / (size[at] + len(mine) - shared) >= threshold]
            _, one = np.unique(groups[linked], return_index=True)
            yield from ((min(name, int(ids[i])), max(name, int(ids[i]))) for i in linked[one])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            found = list(compare(now[0], *sides)) if now else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

        for batch in batches:
            marks = zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y")), strict=True)
            facts = zip(*(batch.column(c).to_pylist() for c in ("side", "id", "component")), strict=True)
            for i, (mark, (side, name, component)) in enumerate(zip(marks, facts, strict=True)):
                if mark != now:
                    yield from done()
                    now, sides = mark, ([], [])
                bands, own = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("bands", "own"))
                sides[side].append([name, component, bands, own])
        yield from done()

    return map_arrow(placed, work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: its id, component (smallest id reachable over links of the
    threshold or more; its own where it has none) and kept (it is that smallest id)."""
    signs = store(signed(docs, doc_id, text), "signatures")
    own = ["f1", "f2", "n"]
    # classes are numbered by their smallest document, so that the smallest class of a
    # component holds its smallest document; one document may hold several classes
    grouped = signs.groupBy(*own).agg(F.min("id").alias("first"), F.any_value("bands").alias("bands"), F.lit(1).cast("long").alias("one"))
    classes = store(running_totals(grouped, ["first", *own], {"id": "one"}).drop("one"), "classes")
    members = classes.select(F.explode("bands").alias("key"), "id")

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, own) of some classes."""
        wanted = store(classes.join(ids, "id", "left_semi").select("id", "first", "f1"), "wanted")
        rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
        rows = rows.join(wanted.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
        found = _elements_of(rows).withColumnRenamed("id", "first").join(wanted, ["first", "f1"]).dropDuplicates(["id"])
        return store(found.select("id", "own"), "elements")

    sizes = classes.select("id", "n")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("m")), "a").join(
            sizes.select(F.col("id").alias("b"), "n"), "b"
        ).where(F.least("m", "n") / F.greatest("m", "n") >= threshold).select("a", "b")
        both = store(both, "alike")
        sets = sets_of(both.select(F.col("a").alias("id")).unionByName(both.select(F.col("b").alias("id"))).distinct())
        met = both.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b"
        )
        shared = F.size(F.array_intersect("x", "y"))
        return met.where(shared / (F.size("x") + F.size("y") - shared) >= threshold).select("a", "b").distinct()

    def across(mixed: DataFrame) -> DataFrame:
        facts = classes.select("id", "n", "bands").join(sets_of(mixed.select("id").distinct()), "id")
        return _block_links(mixed, facts, threshold)

    links = bucket_links(members, verify, across=across)
    # rows of one id are one document, which connects its classes
    held = signs.select(F.col("id").alias("doc"), *own).join(classes.select(*own, "id"), own).select("doc", "id").distinct()
    several = held.groupBy("doc").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b < most").select("doc", "b")
    tied = held.join(several, "doc").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    joined = components(links.select("a", "b").unionByName(tied))
    least = held.join(joined, "id", "left").select("doc", F.coalesce("component", "id").alias("id"))
    found = least.join(classes.select("id", F.col("first").alias("component")), "id").groupBy(F.col("doc").alias("id")).agg(
        F.min("component").alias("component")
    )
    ids = docs.select(F.col(doc_id).alias("id"))
    return ids.join(found, "id", "left").select(
        F.col("id").alias(doc_id), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept"),
    )


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input without all documents but one of each group; columns as they are."""
    thin = store(near_duplicates(docs, doc_id, text, threshold), "near")
    dropped = thin.where("not kept").select(doc_id).distinct()
    left = docs.join(dropped, doc_id, "left_anti").select(*all_of(docs))
    repeated = thin.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").select(doc_id)
    repeated = store(repeated, "repeated")
    if repeated.isEmpty():
        return left
    return left.join(repeated, doc_id, "left_anti").select(*all_of(docs)).unionByName(
        left.join(repeated, doc_id, "left_semi").select(*all_of(docs)).dropDuplicates([doc_id])
    )
