"""Exact n-gram Jaccard join by a partition of the token universe.

Sets of a size band share one partition of the universe of shingles into segments. Two sets of similarity p/100
differ in at most (100 - p)(a + b) / (100 + p) shingles; by the pigeonhole some segment differs in none (or in
one, where the band's allocation gives that segment its one-deletion neighbourhood). Signatures of segments
find candidates; candidates are verified on the whole sets.

Buckets are never expanded into all pairs at once: members are first verified against one pivot each. Where a
bucket's members then lie in different components, and only there, the pairs that remain are verified too, so
no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rasterflow.llm.pair_search import bucket_rows, search, smallest, without_frequent
from rasterflow.llm.pair_search import scramble as mixed

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def raw(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode()


def shingles(text: str | bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of `width` words; of the whole text if it has fewer."""
    words = raw(text).translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    total = np.full(len(words) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        total += h[i : len(words) - k + 1 + i] * MULTIPLIERS[i]
    return np.unique(mixed(total))


def fingerprint(s: np.ndarray) -> int | None:
    """A signed 64-bit name of a set: equal sets have equal names; none for the empty set."""
    if not len(s):
        return None
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int
    #: Leading segments with a one-deletion neighbourhood.
    deletions: int
    #: Exact segments of under `small` shingles are left out of sets that have at most `spare` of them; what then
    #: remains of `spare` goes to the segments that most sets share.
    spare: int
    small: int


def _poisson(mean: float, below: int) -> float:
    term, total = math.exp(-mean), 0.0
    for k in range(below):
        total += term
        term *= mean / (k + 1)
    return total


class Allocation:
    """Size bands, and for each the cheapest allocation of the pigeonhole's units to segments."""

    RATIO = 1.3
    #: Sets of a band that have some text in common with a set, by how much they do (as a share of shingles);
    #: each chance meeting with one of them costs as much as a signature.
    CHANCE, COMMON = 20_000.0, 0.15

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]

    def limit(self, a, b):
        """The most shingles in which linked sets of these sizes can differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    @staticmethod
    def spare(most: int) -> int:
        """Segments besides those that the pigeonhole needs: as many of a set's most frequent ones can be left out."""
        return (most + 2) // 3

    def band_low(self, k: int) -> int:
        while len(self.lows) <= k:
            self.lows.append(max(self.lows[-1] + 1, math.ceil(self.lows[-1] * self.RATIO)))
        return self.lows[k]

    @lru_cache(maxsize=None)  # noqa: B019
    def band(self, k: int) -> Band | None:
        """None: sets of this band link with equal sets only."""
        low, high = self.band_low(k), self.band_low(k + 1) - 1
        most = self.limit(high, high)
        if most == 0:
            return None
        mid, best = (low + high) / 2, None
        for small in (1, 2):
            for deletions in sorted({0, 1, 2, (most + 1) // 2} if most < 8 else {0}):
                for spare in {self.spare(most)}:
                    segments = most + 1 + spare - deletions
                    if segments < max(1, deletions):
                        continue
                    mean = mid / segments
                    exact = segments - deletions
                    tiny = exact * _poisson(mean, small)
                    over = 1 - _poisson(tiny, spare + 1) if tiny < 50 else 1.0
                    # two unrelated sets meet in a segment if neither has a shingle of its own there
                    own, shared = 2 * mean * (1 - self.COMMON), mean * self.COMMON
                    chance = exact * math.exp(-own) * (1 - _poisson(shared, small) * (1 - over))
                    chance += deletions * math.exp(-own) * (1 + own)
                    cost = exact * (1 - _poisson(mean, small) * (1 - over)) + deletions * (mean + 1)
                    total = cost + self.CHANCE * chance
                    if best is None or total < best[0]:
                        best = (total, Band(low, high, segments, deletions, spare, small))
        return best[1]

    def bands(self, n: int) -> list[tuple[int, Band]]:
        """The bands in which a set of n shingles can meet a set at least as large as the band's smallest."""
        k = 0
        while self.band_low(k + 1) <= n:
            k += 1
        out = []
        while k == 0 or 100 * n >= self.percent * self.band_low(k) or self.band_low(k) <= n:
            if b := self.band(k):
                out.append((k, b))
            k += 1
        return out

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signed 64-bit signatures of a sorted set, and their codes: band * 2^20 + how many of the band may still be left out."""
        n = len(s)
        value = mixed(s ^ np.uint64(0x5851F42D4C957F2D))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        out, codes = [], []
        for k, b in self.bands(n):
            m = b.segments
            # hashes are uniform, so equal ranges of them are the segments
            edge = np.searchsorted(s >> np.uint64(32), (np.arange(m + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(m))
            edge[-1] = n
            size = np.diff(edge)
            tag = (np.arange(m, dtype=np.uint64) + np.uint64(k << 32)) * MULTIPLIERS[1]
            total = sums[edge[1:]] - sums[edge[:-1]]
            sig = mixed(total + tag + size.astype(np.uint64) * MULTIPLIERS[0])
            use = np.ones(m, bool)
            tiny = size[b.deletions :] < b.small
            if tiny.sum() <= b.spare:
                use[b.deletions :] = ~tiny
            code = np.full(m, (k << 20) + max(0, b.spare - int(tiny.sum())), np.int64)
            code[: b.deletions] = -1
            out.append(sig[use])
            codes.append(code[use])
            if b.deletions:
                # one row per shingle of the leading segments: its segment without it
                j = np.repeat(np.arange(b.deletions), size[: b.deletions])
                rest = total[j] - value[: edge[b.deletions]] + tag[j]
                out.append(mixed(rest + (size[j] - 1).astype(np.uint64) * MULTIPLIERS[0]))
                codes.append(np.full(len(j), -1, np.int64))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sig, at = np.unique(np.concatenate(out), return_index=True)
        return sig.view(np.int64), np.concatenate(codes)[at]


def _placed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, node, size and component_id (null without words) of every row of docs."""
    allocation = Allocation(percent)
    content = lambda text: shingles(text, width)

    def check(x: np.ndarray, y: np.ndarray) -> tuple[bool, None, None]:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both), None, None

    def sketch(s: np.ndarray) -> np.ndarray:
        """How many shingles fall into each of 512 equal ranges of hashes."""
        return np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512)

    def coded(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = [allocation.signatures(s) for s in sets]
        return np.repeat(np.arange(len(got)), [len(g[0]) for g in got]), np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    members, documents, _ = bucket_rows(docs, content, fingerprint, coded, "jaccard")
    members = without_frequent(members, "jaccard")
    # linked sets have at least that share of the larger one in common
    rare = lambda s, _: [(s, len(s) - -(-len(s) * percent // 100) + 1)]
    _, part = search(docs, documents, members, content, fingerprint, check, rare, "jaccard", sketch, allocation.limit, f"{100 - percent} * (nx + ny) div {100 + percent}")
    named = smallest(documents, part).select("node", "component_id")
    return documents.join(named, "node", "left").select("doc_id", "node", "size", "component_id")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of docs.

    docs: doc_id, text; others are ignored. A-Z are lowered, words are runs without space, tab, line or page breaks.
    Texts without words (null, empty) have an empty set and are their own component. Rows of one doc_id are documents
    of their own; equal sets are one node, whatever their number. A null doc_id is never the smallest unless all are null.
    """
    return _placed(docs, width, percent).select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the one of the smallest doc_id, and of its rows in the component the least text.

    Documents without words are no copies of each other and stay; so do rows with a null doc_id.
    """
    placed = _placed(docs, width, percent)
    copies = placed.where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    repeated = placed.where("doc_id is not null").groupBy(F.col("doc_id").alias("_copy")).count().where("count > 1").select("_copy")
    if not repeated.limit(1).count():
        return docs.join(copies, docs["doc_id"] == copies["_copy"], "left_anti").select(*docs.columns)
    alone = docs.join(copies.union(repeated), F.col("doc_id") == F.col("_copy"), "left_anti").select(*docs.columns)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [fingerprint(shingles(t, width)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.int64())], names=[*b.schema.names, "_node"])

    # rows of a repeated doc_id are told apart by their texts
    several = docs.join(repeated, docs["doc_id"] == repeated["_copy"], "left_semi").select(*docs.columns)
    several = several.mapInArrow(named, StructType([*docs.schema.fields, StructField("_node", LongType())]))
    of = placed.where("node is not null").select(F.col("node").alias("_of"), F.col("component_id").alias("_component")).distinct()
    several = several.join(of, F.col("_node") == F.col("_of"), "left").where("_component is null or doc_id = _component")
    first = Window.partitionBy("_component", F.when(F.col("_component").isNull(), F.monotonically_increasing_id())).orderBy("text")
    several = several.withColumn("_rank", F.row_number().over(first)).where("_rank = 1")
    return alone.unionByName(several.select(*docs.columns))
