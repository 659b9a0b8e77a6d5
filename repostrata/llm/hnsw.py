"""Near-duplicate vectors by hierarchical navigable small-world graphs per shard.

Bit-equal vectors are one class, counted by its size. Classes are dealt to shards by
hash; a task builds the graph of its shard and then gets all classes, batch by batch, as
queries. A beam search descends the levels and collects what is near on the lowest; a
query whose beam holds nothing below the threshold goes on with a wider one. Before
that, the shard audits itself: the links that the beams find for a sample of its points, and
then of each batch of queries, most of which are of other shards, are held
against brute force over the shard, and beams are doubled until the recall is reached, as a mean
over the points that have links, and for points of few links apart;
a beam as wide as the shard is brute force itself. Where a beam would meet so many points that
holding the query against all of the shard takes no longer (`scanned`: small shards, and beams that the audit had
to widen), that is done instead, without loss. What is found is verified by cosine in
double precision. A task returns, for each query, how many vectors it links with and
edges to the shard's components only, so a group of n copies costs about n edges.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are their own component; vectors of other dimensions don't link; a
null id links with nothing; an empty table gives an empty result; other columns of the
input are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, store
from .vectors import against_shards, cosine, usable

THRESHOLD = 0.9
#: Links of a node on upper levels; twice as many on the lowest.
LINKS = 12
BUILD_BEAM, SEARCH_BEAM = 40, 32
BATCH = 256
LEAST_SHARDS, SHARD_ROWS = 8, 100_000
#: Points of a shard, at least and at most, and queries of a batch that are held against brute force.
AUDIT, AUDIT_MOST, AUDIT_ASKED = 256, 2048, 64
AUDIT_RECALL, AUDIT_KEPT, FEW, BLOCK = 0.99, 2048, 16, 64
#: Cosines of one query with all points of a shard that take the time of one with a link met on the way.
GATHERED = 24
#: How many visited marks a block of queries may take.
MARKS = 8_000_000
FOUND = "id long, links long, other long"


class Scan:
    """The vectors of one shard without a graph: each query is held against all of them, which is exact."""

    def __init__(self, unit: np.ndarray):
        self.unit, self.node_of = np.ascontiguousarray(unit), np.arange(len(unit))

    def within(self, q: np.ndarray, least: float, width: int = 0) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for at in range(0, len(q), BLOCK):
            near = q[at : at + BLOCK] @ self.unit.T >= least
            row, node = np.nonzero(near)
            out += np.split(node, np.searchsorted(row, np.arange(1, len(near))))
        return out


def scanned(points: int, width: int, gathered: float = GATHERED) -> bool:
    """Whether holding a query against all points takes no longer than a beam of that width."""
    return points <= width * 2 * LINKS * gathered


class Graph:
    """The graph of one shard over unit vectors; node 0 is on the highest level."""

    def __init__(self, unit: np.ndarray, seed: int):
        self.unit = unit
        rng = np.random.default_rng(seed)
        levels = np.floor(-np.log(1 - rng.random(len(unit))) / math.log(LINKS)).astype(int)
        order = np.lexsort((rng.random(len(unit)), -levels))
        self.node_of, self.unit, self.levels = order, np.ascontiguousarray(unit[order]), levels[order]
        self.links = [
            np.full((int((self.levels >= level).sum()), LINKS * (2 if level == 0 else 1)), -1, dtype=np.int32)
            for level in range(int(self.levels[0]) + 1)
        ]
        at = 1
        while at < len(unit):
            end = min(len(unit), at + min(BATCH, max(1, at)))
            self._insert(at, end)
            at = end

    def beam(self, q: np.ndarray, start: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best nodes found for each query from its start nodes, and their cosines."""
        links, n = self.links[level], len(q)
        visited = np.zeros((n, len(links)), dtype=bool)
        nodes = np.full((n, width), -1, dtype=np.int32)
        near = np.full((n, width), -np.inf, dtype=np.float32)
        fresh = np.zeros((n, width), dtype=bool)
        first = start[:, :width]
        valid = first >= 0
        row, column = np.nonzero(valid)
        visited[row, first[row, column]] = True
        nodes[:, : first.shape[1]] = first
        near[:, : first.shape[1]] = np.where(valid, np.einsum("qmd,qd->qm", self.unit[first], q), -np.inf)
        fresh[:, : first.shape[1]] = valid
        active = np.arange(n)
        while len(active):
            open_near = np.where(fresh[active], near[active], -np.inf)
            pick = open_near.argmax(1)
            going = open_near[np.arange(len(active)), pick] > -np.inf
            active, pick = active[going], pick[going]
            if not len(active):
                break
            fresh[active, pick] = False
            met = links[nodes[active, pick]]
            new = (met >= 0) & ~visited[active[:, None], met]
            row, column = np.nonzero(new)
            visited[active[row], met[row, column]] = True
            cos = np.where(new, np.einsum("qmd,qd->qm", self.unit[met], q[active]), -np.inf)
            better = cos > near[active].min(1, keepdims=True)
            some = better.any(1)
            if some.any():
                own = active[some]
                all_near = np.concatenate([near[own], np.where(better, cos, -np.inf)[some]], axis=1)
                best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
                rows = np.arange(len(own))[:, None]
                near[own] = all_near[rows, best]
                nodes[own] = np.concatenate([nodes[own], met[some]], axis=1)[rows, best]
                fresh[own] = np.concatenate([fresh[own], better[some]], axis=1)[rows, best]
        nodes[np.isneginf(near)] = -1
        return nodes, near

    def descend(self, q: np.ndarray, level: int) -> np.ndarray:
        """Start nodes for a level: the best of the levels above."""
        at = np.zeros((len(q), 1), dtype=np.int32)
        for upper in range(len(self.links) - 1, level, -1):
            nodes, near = self.beam(q, at, upper, 4)
            at = nodes[np.arange(len(q)), near.argmax(1)][:, None]
        return at

    def _choose(self, q: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of each row's candidates: first those nearer to it than to any
        chosen before them, then the nearest others."""
        order = np.argsort(-near, axis=1, kind="stable")
        nodes, near = np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)
        valid = (nodes >= 0) & np.isfinite(near)
        own = self.unit[nodes]
        between = np.matmul(own, own.transpose(0, 2, 1))
        chosen = np.zeros(nodes.shape, dtype=bool)
        for j in range(nodes.shape[1]):
            blocked = (np.where(chosen, between[:, j, :], -np.inf) >= near[:, j : j + 1]).any(1)
            chosen[:, j] = valid[:, j] & ~blocked
        rank = np.where(valid, np.where(chosen, 0, 1), 2)
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(valid, nodes, -1), order, 1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _insert(self, at: int, end: int) -> None:
        """Link nodes at..end to those before them and to each other."""
        batch = np.arange(at, end)
        q = self.unit[batch]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        for level in range(len(self.links)):
            own = np.flatnonzero(self.levels[batch] >= level)
            if not len(own):
                break
            nodes, near = self.beam(q[own], self.descend(q[own], level), level, BUILD_BEAM)
            mates = np.argsort(-among[np.ix_(own, own)], axis=1)[:, :LINKS]
            both = np.concatenate([nodes, batch[own][mates]], axis=1)
            cos = np.concatenate([near, np.take_along_axis(among[np.ix_(own, own)], mates, 1)], axis=1)
            picked = self._choose(q[own], both, cos.astype(np.float32), LINKS)
            links = self.links[level]
            links[batch[own], :LINKS] = picked
            # the way back: the linked nodes choose anew among their links and the new ones
            target, source = picked[picked >= 0], np.repeat(batch[own], (picked >= 0).sum(1))
            order = np.lexsort((-np.einsum("ij,ij->i", self.unit[target], self.unit[source]), target))
            target, source = target[order], source[order]
            kinds, first, count = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, count)
            few = place < links.shape[1]
            incoming = np.full((len(kinds), links.shape[1]), -1, dtype=np.int32)
            incoming[np.repeat(np.arange(len(kinds)), count)[few], place[few]] = source[few]
            old = links[kinds]
            incoming[(incoming[:, :, None] == old[:, None, :]).any(2)] = -1
            every = np.concatenate([old, incoming], axis=1)
            cos = np.where(every >= 0, np.einsum("nmd,nd->nm", self.unit[every], self.unit[kinds]), -np.inf)
            links[kinds] = self._choose(self.unit[kinds], every, cos, links.shape[1])

    def within(self, q: np.ndarray, least: float, width: int) -> list[np.ndarray]:
        """Nodes with a cosine of about `least` or more for each query; a beam that is full
        of them is doubled, or all nodes are scanned where that is less work."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(q)
        block = max(1, MARKS // len(self.unit))
        for at in range(0, len(q), block):
            left = np.arange(at, min(at + block, len(q)))
            start, wide = self.descend(q[left], 0), min(width, len(self.unit))
            while len(left):
                nodes, near = self.beam(q[left], start, 0, wide)
                full = (near >= least).all(1) & (wide < len(self.unit))
                for i in np.flatnonzero(~full):
                    out[left[i]] = nodes[i][near[i] >= least].astype(np.int64)
                left, start, wide = left[full], nodes[full], min(2 * wide, len(self.unit))
                if len(left) and scanned(len(self.unit), wide):
                    for i, found in zip(left, Scan(self.unit).within(q[left], least), strict=True):
                        out[i] = found
                    break
        return out


class Audit:
    """Beam width for which the links of sampled queries, held against brute force, are found.

    The recall is a mean over queries that have a link besides themselves, so no large
    group outweighs the others, and it has to be reached by those of FEW links by themselves.
    """

    def __init__(self, graph: Graph, least: float, width: int = SEARCH_BEAM):
        self.graph, self.least, self.width = graph, least, width
        self.asked: list[np.ndarray] = []
        self.truth: list[np.ndarray] = []
        self.shares: list[float] = []

    def sample(self, q: np.ndarray, own: np.ndarray, enough: int, most: int) -> int:
        """Add `enough` of the queries and, until as many with few links are known, up to
        `most`; `own` is each one's node, -1 for none. Returns the width."""
        order = np.random.default_rng(len(q)).permutation(len(q))[:most]
        for at in range(0, len(order), BLOCK):
            if at >= enough and sum(len(t) <= FEW for t in self.truth) >= enough:
                break
            some = order[at : at + BLOCK]
            # a hair above, as sums are rounded in another order
            for i, near in zip(some, q[some] @ self.graph.unit.T >= self.least + 1e-6, strict=True):
                links = np.flatnonzero(near).astype(np.int32)
                links = links[links != own[i]]
                if len(links) and (at < enough or len(links) <= FEW):
                    self.asked.append(q[i])
                    self.truth.append(links)
        # the newest stay
        drop = max(0, len(self.asked) - AUDIT_KEPT)
        del self.asked[:drop], self.truth[:drop], self.shares[:drop]
        self._settle()
        return self.width

    def _settle(self) -> None:
        while True:
            at = len(self.shares)
            if at < len(self.asked):
                found = self.graph.within(np.stack(self.asked[at:]), self.least, self.width)
                self.shares += [float(np.isin(t, f).mean()) for t, f in zip(self.truth[at:], found, strict=True)]
            shares, few = np.array(self.shares), np.array([len(t) <= FEW for t in self.truth], dtype=bool)
            low = any(len(own) and own.mean() < AUDIT_RECALL for own in (shares[few], shares[~few]))
            if not low or self.width >= len(self.graph.unit):
                return
            self.width *= 2
            self.shares = []


def audited_width(graph: Graph, least: float) -> int:
    """The beam's width for which the links of a sample of the graph's own points are found."""
    return Audit(graph, least).sample(graph.unit, np.arange(len(graph.unit)), AUDIT, AUDIT_MOST)


def near_vectors(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: its id, n_links, component_id and kept."""
    rows = store(usable(embeddings, vec_id, vector).withColumn("f", F.xxhash64("v")), "vectors")
    classes = store(
        rows.groupBy("f", "v").agg(F.min("id").alias("id"), F.count("*").alias("w")).withColumn("d", F.size("v")), "classes"
    )
    shards = max(LEAST_SHARDS, -(-classes.count() // SHARD_ROWS))
    gathered = GATHERED  # the workers get it from here

    def work(shard: int, held: dict[str, np.ndarray], asked: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        def unit(v: np.ndarray) -> np.ndarray:
            v = v.astype(np.float64)
            return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)

        points, least = unit(held["v"]), np.float32(threshold - 1e-5)
        index: Graph | Scan = Scan(points) if scanned(len(points), SEARCH_BEAM, gathered) else Graph(points, shard)
        ids, sizes, vectors = (held[c][index.node_of] for c in ("id", "w", "v"))
        audit = Audit(index, least) if isinstance(index, Graph) else None
        width = audit.sample(index.unit, np.arange(len(ids)), AUDIT, AUDIT_MOST) if audit else 0
        by_id = np.argsort(ids)
        parent = np.arange(len(ids))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in asked:
            out, asking = [], unit(batch["v"])
            if audit and not scanned(len(ids), width, gathered):
                place = by_id[np.minimum(np.searchsorted(ids, batch["id"], sorter=by_id), len(ids) - 1)]
                width = audit.sample(asking, np.where(ids[place] == batch["id"], place, -1), AUDIT_ASKED, AUDIT_ASKED)
            if audit and scanned(len(ids), width, gathered):
                # so wide a beam costs more than all points; these lie in the graph's order
                index, audit = Scan(index.unit), None
            for key, q, own in zip(batch["id"], batch["v"], index.within(asking, least, width), strict=True):
                own = own[ids[own] != key]
                if len(own):
                    own = own[cosine(vectors[own], np.broadcast_to(q, (len(own), len(q)))) >= threshold]
                if len(own):
                    tops = sorted({root(int(x)) for x in np.unique(parent[own])})
                    for x in tops[1:]:
                        parent[x] = tops[0]
                    out += [(int(key), int(sizes[own].sum()) if i == 0 else 0, int(ids[x])) for i, x in enumerate(tops)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["id", "links", "other"])

    found = store(against_shards(classes, classes, shards, work, FOUND), "links")
    joined = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    per_class = classes.select("f", "v", "id", "w").join(
        found.groupBy("id").agg(F.sum("links").alias("links")), "id", "left"
    ).join(joined, "id", "left").select(
        "f", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
    per_row = rows.join(per_class, ["f", "v"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    all_ids = embeddings.select(F.col(vec_id).cast("long").alias("id"))
    component = F.coalesce("component", "id")
    return all_ids.join(per_row, "id", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
