"""Decontamination, ranked search and collocations against brute force, on small tables with odd rows."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from repostrata.llm import collocations, common, fmindex, ranking

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, item_id string, row string, hits int, h long, m long, terms string, k int, `a.b` int, `my col` int"
ITEMS = "item_id long, text string, doc_id string, n int"


def words_in(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def rows():
    """Texts with copies, repeated passages, odd bytes and clashing columns."""
    rng = np.random.default_rng(5)
    kinds = ["alpha", "Beta", "gamma", "straße", "Ä", "x1", "日本", "the", "THE", "a"]
    texts = [" ".join(rng.choice(kinds, rng.integers(1, 60))) + rng.choice([".", "\n", " ", ""]) for _ in range(120)]
    texts += [texts[0]] * 30 + [texts[1]] * 3
    texts += [None, "", " \t\r\n", "...", "a", "A a a_a-a", "a " * 300, "\x00one\x1ftwo\x7f" * 4, "the end. the end! the\tend;the end"]
    texts += ["start " + " ".join(rng.choice(kinds, 3000)) + " alpha beta gamma"]
    langs = [None, "en", "de"]
    return [(i, t, langs[i % 3], "x", "r", 1, 2, 3, "t", 4, 5, 6) for i, t in enumerate(texts)] + [
        (3, texts[4], "en", "x", "r", 1, 2, 3, "t", 4, 5, 6), (None, texts[5], "de", "x", "r", 1, 2, 3, "t", 4, 5, 6)
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return common.store(spark.createDataFrame(rows, SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def item_rows(rows):
    own = [words_in(r[1]) for r in rows if r[1]]
    long = [w for w in own if len(w) > 25][:6]
    return [(i, " ".join(w[5:22]), "d", 1) for i, w in enumerate(long)] + [
        (20, "THE a", "d", 1), (21, "beta", "d", 1), (22, None, "d", 1), (23, "", "d", 1), (24, "-- !", "d", 1), (25, "unseen words here", "d", 1),
        (26, " ".join(long[0][5:22]), "d", 1), (27, "a a a a a a a a a a a a", "d", 1), (7, "gamma", "d", 1), (7, "gamma gamma beta", "d", 1), (None, "alpha", "d", 1),
    ]


@pytest.fixture(scope="module")
def items(spark, item_rows):
    return spark.createDataFrame(item_rows, ITEMS)


# decontamination


def test_suffix_array():
    rng = np.random.default_rng(0)
    for kinds in (1, 2, 50):
        seq = np.append(rng.integers(0, kinds + 1, 400), 0)
        ends = np.cumsum(seq == 0)
        keys = [tuple((0, int(ends[j])) if seq[j] == 0 else (1, int(seq[j])) for j in range(i, len(seq))) for i in range(len(seq))]
        assert fmindex.suffix_array(seq).tolist() == sorted(range(len(seq)), key=keys.__getitem__)


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(1)
    seq = np.append(np.where(rng.random(3000) < 0.02, 0, rng.integers(1, 6, 3000)), 0)
    index = fmindex.FMIndex(seq, 5)
    for k in (1, 2, 5):
        phrases = rng.integers(0, 7, (60, k)) % 6
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            truth = [i for i in range(len(seq) - k + 1) if (seq[i : i + k] == p).all()] if (p > 0).all() else []
            assert sorted(index.locate(np.arange(a, b)).tolist()) == truth


def contaminated(rows, item_rows):
    windows = defaultdict(set)
    for item, text, *_ in item_rows:
        own = words_in(text)
        k = min(fmindex.WINDOW, len(own))
        for at in range(len(own) - k + 1 if k and item is not None else 0):
            windows[tuple(own[at : at + k])].add(str(item))
    out = []
    for doc_id, text, *_ in rows:
        own, hit, found = words_in(text), set(), set()
        for k in {len(w) for w in windows}:
            for at in range(len(own) - k + 1):
                if tuple(own[at : at + k]) in windows:
                    hit |= set(range(at, at + k))
                    found |= windows[tuple(own[at : at + k])]
        out.append((doc_id, len(own), len(hit), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("bounds", [{}, {"shard_words": 40, "slice_bytes": 64}, {"block_bytes": 60}])
def test_contamination(docs, items, rows, item_rows, bounds):
    found = fmindex.find(docs, items, ["doc_id"], **bounds).collect()
    assert Counter((r["row"]["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found) == contaminated(rows, item_rows)


def test_spans_are_cut_out(docs, items, rows):
    kept = fmindex.decontaminate(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    text = {r[0]: r[1] for r in rows}
    found = {r["row"]["doc_id"]: r for r in fmindex.find(docs.where("doc_id > 10"), items, ["doc_id"]).collect()}
    for r in kept.where("doc_id > 10").collect():
        whole, spans = text[r["doc_id"]], found[r["doc_id"]]["spans"]
        assert sum(len(words_in(whole[s["start"] : s["end"]])) for s in spans) == found[r["doc_id"]]["n_hit"]
        for s in reversed(spans):
            whole = whole[: s["start"]] + whole[s["end"] :]
        assert r["text"] == whole and r["my col"] == 6


def test_contamination_of_nothing(docs, items, none, rows):
    assert fmindex.find(none, items, ["doc_id"]).count() == 0 and fmindex.decontaminate(none, items).columns == none.columns
    clean = fmindex.find(docs, items.where("false"), ["doc_id"])
    assert clean.where("n_hit > 0 or size(items) > 0").count() == 0 and clean.count() == len(rows)


# ranked search


def ranked(rows, item_rows):
    bags = [(r[0], Counter(words_in(r[1]))) for r in rows]
    big_n = sum(1 for _, b in bags if b)
    big_l = sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = Counter()
    for item, text, *_ in item_rows:
        scored = []
        for doc_id, bag in bags:
            m = 10 + 90 * sum(bag.values()) * big_n // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 8 * m))
                for w in set(words_in(text)) if bag[w]
            )
            if score > 0 and doc_id is not None:
                scored.append((-score, doc_id))
        out.update((item, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scored)[:10], 1))
    return out


@pytest.mark.parametrize("bounds", [{}, {"block_bytes": 60, "cells": 100}])
def test_search(docs, items, rows, item_rows, bounds):
    got = ranking.search(docs, items, **bounds).select("item_id", "rank", "doc_id", "score").collect()
    assert Counter(tuple(r) for r in got) == ranked(rows, item_rows)


def test_classes_hold_each_bag_once(docs):
    bagged = ranking.bags(docs, [b"alpha", b"beta", b"the"])
    found = ranking.classes(bagged, (100, 5000)).collect()
    assert len({(r["m"], tuple(r["terms"]), tuple(r["tfs"])) for r in found}) == len(found)
    assert max(len(r["members"]) for r in found) == ranking.TOP and all(r["members"] == sorted(r["members"]) for r in found)


def test_search_of_nothing(docs, items, none):
    assert ranking.search(none, items).count() == 0 and ranking.search(docs, items.where("false")).count() == 0


# collocations


def mined(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            f.update((lang, tuple(own[i : i + k])) for k in range(1, 6) for i in range(len(own) - k + 1))
    chosen = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    dropped = {(lang, p[i : i + s]) for (lang, p), a in chosen.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if a >= f[lang, p[i : i + s]]}
    out = defaultdict(list)
    for (lang, p), a in chosen.items():
        if (lang, p) not in dropped:
            cuts = []
            for k in range(1, len(p)):
                left, right = f[lang, p[:k]], f[lang, p[k:]]
                cuts.append((math.floor(Fraction(1000 * a * n[lang], left * right)), k, left, right))
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


@pytest.mark.parametrize("bounds", [
    {"sampled": 2, "sample_least": 2}, {"sampled": 10**9},
    {"sampled": 1, "sample_least": 1, "bounds": collocations.Bounds(batch_words=50, slice_bytes=40)},
    {"sampled": 2, "sample_least": 1, "bounds": collocations.Bounds(filter_bits=8)},
])
def test_phrases(docs, rows, bounds):
    """Also where the sample proposes nothing, so that all comes from failures of the border,
    where texts are cut in the middle, and where the filter is full."""
    got = collocations.collocations(docs, least=6, top=400, **bounds).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert {tuple(r) for r in got} == mined(rows, 6, 400) and len(got) == len(set(got))


def test_phrases_of_nothing(none, spark, docs):
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(docs.withColumn("text", F.lit(None).cast("string")), least=1).count() == 0


def test_rare_phrases_leave_no_task_as_text(spark, monkeypatch):
    """Nearly all of the border is rare; only phrases whose hash is frequent are counted as text."""
    words = [f"w{i}" for i in range(40)]
    texts = [f"{a} {b} end of line" for a in words for b in words]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counted, own = [], collocations.count_phrases

    def noted(docs, levels, *rest):
        found = own(docs, levels, *rest)
        if levels[0] == 1 and levels[-1] == collocations.LONGEST:
            counted.append(found.where("k > 0").count())
        return found

    monkeypatch.setattr(collocations, "count_phrases", noted)
    got = collocations.collocations(docs, least=30, sampled=1, sample_least=30).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {tuple(r) for r in got.collect()} == mined(rows, 30, collocations.TOP)
    assert counted and counted[0] < 200  # there are 1,600 different pairs of the first two words alone


def test_a_filter_is_fetched_in_one_job(spark):
    """Not in one for each partition, one after the other; and filters of one size unite."""
    context, n = spark.sparkContext, 40
    texts = [f"w{i} w{i + 1}" for i in range(300)]
    halves = [spark.createDataFrame([("en", t) for t in own], "lang string, phrase string") for own in (texts[:150], texts[100:])]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, (str(n), "false")):
            spark.conf.set(k, v)
        context.setJobGroup("filter", "bits of a filter")
        whole = collocations.Filter.none(12).plus(halves[0].unionByName(halves[1]))
        jobs = context.statusTracker().getJobIdsForGroup("filter")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < len(jobs) < n / 4
    one, other = (collocations.Filter.none(12).plus(own) for own in halves)
    assert (one.joined(other).bits == whole.bits).all() and (one.plus(halves[1]).bits == whole.bits).all() and whole.bits.any()
