"""Phrase collocations by Toivonen's mining.

A sample of the text, sentence by sentence, proposes the phrases that may be frequent (at a lowered bound).
The full pass counts exactly those and their negative border: the phrases that aren't
proposed although both phrases one word shorter inside them are. Where one of the border
proves frequent, the proposal was too small; it is taken in, and a further pass counts the
border that arises from it. When no pass finds a new one, every frequent phrase has been
counted, whatever the sample missed: a phrase can only be frequent if all inside it are.

The border is never spelled out. A task asks of each place in a text whether the two
phrases inside are proposed, and counts what is there. Proposed phrases travel as a bit
filter of fixed size (`FILTER_BITS`), so that what tasks hold doesn't grow with the
corpus; a phrase that the filter takes in by mistake is counted as exactly as the rest. Within a task
words are numbered and phrases are exact tuples of numbers; what leaves it is one row per
distinct phrase of some `BATCH_WORDS` words, which Spark adds up.

Nearly all of the border is rare, so the full pass goes over the texts twice. First only hashes of
`SLOT_BITS` bits are counted, each for all phrases that share it: a phrase occurs at most as often as
its hash, so those whose hash is rarer than the bound are out. The rest is then counted phrase by phrase.

A candidate is a phrase of 2 to 5 words with at least `least` occurrences. Its score is
floor(1000 a n / (l r)) of the cut with the lowest one, in decimals of 38 digits.
Candidates inside a longer one that is as frequent are left out.

Defined cases: a null text is empty, a null language is `und`; a text without words counts
nothing; rows that share an id are texts of their own; a very long text is cut between
words without losing phrases across the cut; ties rank by count, then by the phrase's
bytes; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, store
from .words import SLICE, Numbers, cut_at, texts_of

LONGEST = 5
LEAST = 100
TOP = 2000
#: One in so many sentences is in the sample, and what a phrase needs there.
SAMPLED, SAMPLE_LEAST = 8, 6
#: Up to so many new phrases are looked for in a text before its words are numbered.
PROBES = 100_000
FILTER_BITS = 26
#: Bits of the hashes that are counted in place of phrases; no fewer than those of the filter.
SLOT_BITS = 40
BATCH_WORDS = 1_500_000
#: Rows that leave a task at a time.
ROWS = 1 << 16
NO_LANGUAGE = "und"

#: Marks between pieces become line feeds, tabs blanks, A-Z small.
_TABLE = bytes(
    10 if chr(c) in ".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
COUNTS = "lang string, k int, phrase string, f long"


@dataclass(frozen=True)
class Bounds:
    """What a task holds: words of a batch, bytes of a text taken at a time, bits of the filter."""

    batch_words: int = BATCH_WORDS
    slice_bytes: int = SLICE
    filter_bits: int = FILTER_BITS


class Tokens(Numbers):
    """Words to numbers; ends of pieces are 0, and what lies between two blanks -1."""

    def __init__(self):
        self[b""], self[b"\n"] = -1, 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n

    def words(self) -> list[bytes]:
        return [b"", *list(self)[2:]]


def tokens_of(part: bytes, numbers: Tokens) -> np.ndarray:
    """Word numbers of a part of a text, 0 where a piece ends."""
    codes = numbers.of(part.replace(b"\n", b" \n ").split(b" "))
    return codes[codes >= 0].astype(np.int32)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a phrase from that of all but its last word and that of the last."""
    with np.errstate(over="ignore"):
        return (a ^ b) * np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _start(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed=1))


class Filter:
    """Phrases as bits; phrases that are taken in only add bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(65 - (64 * len(bits)).bit_length())

    @staticmethod
    def none(filter_bits: int = FILTER_BITS) -> Filter:
        return Filter(np.zeros(1 << (filter_bits - 6), dtype=np.int64))

    def has(self, h: np.ndarray) -> np.ndarray:
        slot = h >> self.shift
        return (self.bits.view(np.uint64)[(slot >> np.uint64(6)).view(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).view(np.int64) > 0

    def plus(self, phrases: DataFrame) -> Filter:
        """With the phrases (lang, phrase) added. The bits are united by Spark; the driver
        gets at most as many numbers as the filter has."""
        shift = self.shift

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = batch.column(0).dictionary_encode()
                starts = np.array([_start(x) for x in langs.dictionary.to_pylist()], dtype=np.uint64)
                h = starts[langs.indices.to_numpy()]
                words = pc.split_pattern(batch.column(1).cast(pa.binary()), " ")
                sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                coded = words.flatten().dictionary_encode()
                own = _word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                first = np.cumsum(sizes) - sizes
                for j in range(LONGEST):
                    at = np.flatnonzero(sizes > j)
                    h[at] = _mixed(h[at], own[first[at] + j])
                slot = h >> shift
                bits = np.uint64(1) << (slot & np.uint64(63))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((slot >> np.uint64(6)).view(np.int64)), pa.array(bits.view(np.int64))], names=["slot", "bits"]
                )

        return self._united(map_arrow(phrases.select("lang", "phrase"), work, "slot long, bits long"))

    def plus_slots(self, slots: DataFrame) -> Filter:
        """With all phrases of some hashes (slot) added."""
        place = F.shiftright("slot", int(self.shift) - 64 + SLOT_BITS)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        return self._united(slots.select(F.shiftright(place, 6).alias("slot"), bit.alias("bits")))

    def _united(self, placed: DataFrame) -> Filter:
        # in one job, as two columns of numbers: an iterator would run a job for each partition
        united = placed.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        out = self.bits.copy()
        out[united["slot"].to_numpy()] |= united["bits"].to_numpy()
        return Filter(out)

    def joined(self, other: Filter) -> Filter:
        """With the phrases of another one of this size added."""
        return Filter(self.bits | other.bits)


class _Hashes:
    """Hashes of the phrases of so many words from each place on; only the last ones are kept."""

    def __init__(self, padded: np.ndarray, own: np.ndarray, start: np.uint64):
        self.padded, self.own, self.start = padded, own, start
        self.size, self.now = 0, np.full(len(padded) - LONGEST, start)

    def __call__(self, j: int) -> np.ndarray:
        if j < self.size:
            self.size, self.now = 0, np.full(len(self.now), self.start)
        while self.size < j:
            self.now = _mixed(self.now, self.own[self.padded[self.size : self.size + len(self.now)]])
            self.size += 1
        return self.now


def _places(tokens: np.ndarray, upto: int, lang: str, words: list[bytes], levels: tuple[int, ...],
            chosen: Callable[[_Hashes, int], np.ndarray]) -> Iterator[tuple[int, np.ndarray, _Hashes]]:
    """(k, places, hashes) of the phrases that begin before `upto`, as far as chosen.

    `chosen(hashes, k)` tells for each place whether its phrase of k words is to be counted;
    hashes(j) are those of the j words from each place on.
    """
    own = _word_hashes(words)
    padded = np.concatenate([tokens, np.zeros(LONGEST, dtype=np.int32)])
    n = len(tokens)
    inside = [np.ones(n, dtype=bool)]  # whether so many words from here on lie in one piece
    for j in range(LONGEST):
        inside.append(inside[-1] & (padded[j : j + n] > 0))
    hashes = _Hashes(padded, own, _start(lang))
    for k in levels:
        mask = inside[k].copy()
        mask[upto:] = False
        mask &= chosen(hashes, k)
        at = np.flatnonzero(mask)
        if len(at):
            yield k, at, hashes


def _count(tokens: np.ndarray, upto: int, lang: str, numbers: Tokens, levels: tuple[int, ...],
           chosen: Callable[[_Hashes, int], np.ndarray]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(k, phrases, counts) of the chosen phrases."""
    words = numbers.words()
    names, kinds = pa.array(words, pa.binary()), np.int64(len(words))
    padded = np.concatenate([tokens, np.zeros(LONGEST, dtype=np.int32)])
    for k, at, _ in _places(tokens, upto, lang, words, levels, chosen):
        code, packed, room = padded[at].astype(np.int64), 1, kinds
        for j in range(1, k):
            if int(room) * int(kinds) >= 1 << 62:
                _, code = np.unique(code, return_inverse=True)
                room, packed = np.int64(code.max() + 1), 0
            code, room = code * kinds + padded[at + j], room * kinds
            packed += packed > 0
        if packed == k:  # the number itself holds all words
            code, counts = np.unique(code, return_counts=True)
            parts = []
            for _ in range(k):
                parts.append(code % kinds)
                code = code // kinds
            parts.reverse()
        else:
            _, first, counts = np.unique(code, return_index=True, return_counts=True)
            parts = [padded[at[first] + j] for j in range(k)]
        taken = [names.take(pa.array(p)) for p in parts]
        yield k, pc.binary_join_element_wise(*taken, pa.scalar(b" ", pa.binary())) if k > 1 else taken[0], counts


def _count_batches(docs: DataFrame, rows: Callable[..., Iterator[pa.RecordBatch]], schema: str, chosen, shared, bounds: Bounds,
                   probes: dict[str, set[tuple[bytes, ...]]] | None = None) -> DataFrame:
    """What `rows(tokens, upto, lang, numbers, chosen)` makes of each batch of words of (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shared.value if shared is not None else None
        numbers: dict[str, Tokens] = defaultdict(Tokens)
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        words: dict[str, int] = defaultdict(int)
        end = np.zeros(1, dtype=np.int32)

        def flush(lang: str, open_: bool) -> Iterator[pa.RecordBatch]:
            """Counts and forgets a language, but for the last words of a text that goes on."""
            tokens, own = np.concatenate(held.pop(lang)), numbers.pop(lang, None) or Tokens()
            words.pop(lang, None)
            upto = max(0, len(tokens) - LONGEST + 1) if open_ else len(tokens)
            yield from rows(tokens, upto, lang, own, lambda h, k: chosen(value, h, k))
            if open_:
                names = own.words()
                held[lang].append(numbers[lang].of([names[t] if t else b"\n" for t in tokens[upto:].tolist()]).astype(np.int32))

        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for i, lang in enumerate(batch.column(0).to_pylist()):
                text = column[i].as_py().translate(_TABLE)
                if probes is not None and not _holds(text, probes.get(lang)):
                    continue
                for part in cut_at(text, b"\n ", bounds.slice_bytes):
                    tokens = tokens_of(part, numbers[lang])
                    held[lang].append(tokens)
                    words[lang] += len(tokens)
                    if sum(words.values()) >= bounds.batch_words:
                        most = max(words, key=words.get)
                        yield from flush(most, most == lang)
                held[lang].append(end)
        for lang in sorted(held):
            yield from flush(lang, False)

    own = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(own, work, schema)


def count_phrases(docs: DataFrame, levels: tuple[int, ...], chosen, shared, bounds: Bounds,
                  probes: dict[str, set[tuple[bytes, ...]]] | None = None) -> DataFrame:
    """Exact counts (lang, k, phrase, f) of the chosen phrases of (lang, text).

    `shared` is a broadcast that `chosen(value, hashes, k)` gets. A row with k = 0 holds
    the words of a language. Where `probes` are given, one- and two-word beginnings by language, texts that hold
    none of them have no chosen phrase.
    """

    def rows(tokens: np.ndarray, upto: int, lang: str, numbers: Tokens, wanted) -> Iterator[pa.RecordBatch]:
        begun = int((tokens[:upto] > 0).sum())
        yield from _rows(lang, 0, pa.array([b""], pa.binary()), np.array([begun]))
        for k, phrases, counts in _count(tokens, upto, lang, numbers, levels, wanted):
            yield from _rows(lang, k, phrases, counts)

    counted = _count_batches(docs, rows, COUNTS, chosen, shared, bounds, probes)
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def count_slots(docs: DataFrame, levels: tuple[int, ...], chosen, shared, bounds: Bounds) -> DataFrame:
    """Counts (slot, f) of the chosen phrases by the first `SLOT_BITS` bits of their hashes."""
    shift = np.uint64(64 - SLOT_BITS)

    def rows(tokens: np.ndarray, upto: int, lang: str, numbers: Tokens, wanted) -> Iterator[pa.RecordBatch]:
        for k, places, hashes in _places(tokens, upto, lang, numbers.words(), levels, wanted):
            slots, counts = np.unique(hashes(k)[places] >> shift, return_counts=True)
            for at in range(0, len(slots), ROWS):
                own = [pa.array(slots[at : at + ROWS].view(np.int64)), pa.array(counts[at : at + ROWS].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(own, names=["slot", "f"])

    return _count_batches(docs, rows, "slot long, f long", chosen, shared, bounds).groupBy("slot").agg(F.sum("f").alias("f"))


def _rows(lang: str, k: int, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(phrases), ROWS):
        part, f = phrases.slice(at, ROWS), counts[at : at + ROWS]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(f), pa.string()), pa.array(np.full(len(f), k, dtype=np.int32)),
                part.cast(pa.string()), pa.array(f.astype(np.int64)),
            ],
            names=["lang", "k", "phrase", "f"],
        )


def _every(_, hashes, k: int) -> np.ndarray:
    return np.ones(len(hashes(0)), dtype=bool)


def _both(filter_: Filter, hashes, k: int) -> np.ndarray:
    """Whether the phrases without the last and without the first word are proposed; one word is always taken.
    The second begins one place further on, where the same hashes serve."""
    if k == 1:
        return _every(None, hashes, k)
    proposed = filter_.has(hashes(k - 1))
    return proposed & np.append(proposed[1:], False)


def _likely(filters: tuple[Filter, Filter], hashes, k: int) -> np.ndarray:
    """Of those, the ones whose hashes are frequent."""
    now, likely = filters
    inner = hashes(k - 1)
    out = likely.has(hashes(k))
    if k > 1:
        at = np.flatnonzero(out[:-1])
        out = np.zeros(len(inner), dtype=bool)
        out[at] = now.has(inner[at]) & now.has(inner[at + 1])
    return out


def _fresh(filters: tuple[Filter, Filter], hashes, k: int) -> np.ndarray:
    """Of those, the ones in which one of the two is new."""
    now, new = filters
    h = hashes(k - 1)
    one = new.has(h)
    at = np.flatnonzero((one | np.append(one[1:], False))[:-1])
    out = np.zeros(len(h), dtype=bool)
    out[at] = now.has(h[at]) & now.has(h[at + 1])
    return out


def proposals(docs: DataFrame, sample_least: int, bounds: Bounds) -> DataFrame:
    """Phrases (lang, k, phrase) frequent in a sample of (lang, text), level by level."""
    spark = docs.sparkSession
    words = store(count_phrases(docs, (1,), _every, None, bounds).where((F.col("k") == 1) & (F.col("f") >= sample_least)).drop("f"), "words")
    now = Filter.none(bounds.filter_bits).plus(words)
    pairs = store(
        count_phrases(docs, (2,), _both, spark.sparkContext.broadcast(now), bounds).where((F.col("k") == 2) & (F.col("f") >= sample_least)).drop("f"), "pairs"
    )
    now = Filter.none(bounds.filter_bits).plus(pairs)

    def all_pairs(filter_: Filter, hashes, k: int) -> np.ndarray:
        frequent = filter_.has(hashes(2))
        out = frequent
        for j in range(1, k - 1):
            out = out & np.concatenate([frequent[j:], np.zeros(j, dtype=bool)])[: len(out)]
        return out

    longer = count_phrases(docs, tuple(range(3, LONGEST + 1)), all_pairs, spark.sparkContext.broadcast(now), bounds).where(
        (F.col("k") > 2) & (F.col("f") >= sample_least)
    ).drop("f")
    return store(words.unionByName(pairs).unionByName(longer), "proposed")


def _probes(phrases: DataFrame) -> dict[str, set[tuple[bytes, ...]]] | None:
    """The first two words of each of some phrases, by language; none if they are too many."""
    few = phrases.select("lang", "phrase").limit(PROBES + 1).collect()
    if len(few) > PROBES:
        return None
    found: dict[str, set[tuple[bytes, ...]]] = {}
    for row in few:
        found.setdefault(row["lang"], set()).add(tuple(row["phrase"].encode().split(b" ")[:2]))
    return found


def _holds(text: bytes, probes: set[tuple[bytes, ...]] | None) -> bool:
    """Whether words or pairs of a text are among the probes."""
    if not probes:
        return False
    words = text.split()
    return not (probes.isdisjoint(zip(words, words[1:])) and probes.isdisjoint(zip(words)))


def frequent_phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST,
                     sampled: int = SAMPLED, sample_least: int = SAMPLE_LEAST, bounds: Bounds = Bounds()) -> DataFrame:
    """(lang, k, phrase, f) of all phrases of 1 to 5 words with f >= least, and per language
    the number of all its words as the row with k = 0."""
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    # a text's sentences are drawn one by one, so that phrases that keep to few texts are met too
    drawn = F.filter(
        F.split(F.col(f"`{text}`"), r"[.\n]"),
        lambda _, i: F.pmod(F.xxhash64(F.lit("collocations"), F.col(f"`{doc_id}`"), i), F.lit(sampled)) == 0,
    )
    sample = store(docs.select(F.col(f"`{lang}`").alias("lang"), F.array_join(drawn, "\n").alias("text")).where("text <> ''"), "sample")
    proposed = proposals(sample, sample_least, bounds)
    now = Filter.none(bounds.filter_bits).plus(proposed)
    levels = tuple(range(1, LONGEST + 1))
    slots = store(count_slots(own, levels, _both, spark.sparkContext.broadcast(now), bounds).where(F.col("f") >= least), "slots")
    likely = Filter.none(bounds.filter_bits).plus_slots(slots)
    full = count_phrases(own, levels, _likely, spark.sparkContext.broadcast((now, likely)), bounds)
    found = store(full.where((F.col("k") == 0) | (F.col("f") >= least)), "frequent")
    # failures of the border that can lie in a longer phrase
    missed = store(found.where(F.col("k").between(1, LONGEST - 1)).join(proposed, ["lang", "k", "phrase"], "left_anti"), "missed")
    while not missed.isEmpty():
        new = Filter.none(bounds.filter_bits).plus(missed)
        now = now.joined(new)
        more = count_phrases(own, tuple(range(2, LONGEST + 1)), _fresh, spark.sparkContext.broadcast((now, new)), bounds, _probes(missed))
        more = more.where((F.col("k") > 0) & (F.col("f") >= least)).join(found.select("lang", "k", "phrase"), ["lang", "k", "phrase"], "left_anti")
        more = store(more.select("lang", "k", "phrase", "f"), "frequent")
        found = found.unionByName(more)
        missed = more.where(F.col("k") < LONGEST)
    return found


def collocations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP,
                 sampled: int = SAMPLED, sample_least: int = SAMPLE_LEAST, bounds: Bounds = Bounds()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` first collocations."""
    found = frequent_phrases(docs, doc_id, text, lang, least, sampled, sample_least, bounds)
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    counted = found.where("k > 0").select("lang", "k", "phrase", "f")
    words = F.split("phrase", " ")
    candidates = counted.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), words.alias("w"))
    inside = candidates.where("k > 2").select(
        "lang", "a", F.explode(F.expr("""flatten(transform(sequence(2, k - 1), size ->
            transform(sequence(1, k - size + 1), at -> array_join(slice(w, at, size), ' '))))""")).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a").drop("longer")
    cuts = kept.select(
        "lang", "phrase", "a", F.explode(F.expr("""transform(sequence(1, k - 1), i -> struct(i AS cut,
            array_join(slice(w, 1, i), ' ') AS first, array_join(slice(w, i + 1, k - i), ' ') AS rest))""")).alias("c"),
    ).select("lang", "phrase", "a", "c.*")
    part = counted.select("lang", "phrase", "f")
    both = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]
    ).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"])
    lowest = both.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
