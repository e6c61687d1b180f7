"""Approximate nearest neighbours with a hash-prefix forest.

Vectors are dealt by a hash of their id into blocks of bounded size, and each block holds a forest: for each tree a
sorted array of long hash strings (one bit a random hyperplane, cut at the median of a sample). A query descends every
tree of a block to the longest prefix that it shares with some string there, and then ascends all trees together, one
bit at a time, until the subtrees reached hold enough different candidates. A level is always taken whole, so equal
strings are never cut off. Candidates are ranked by exact distance, and the blocks' best are merged.

Every query meets every block, as a stated query set in blocks against all rows; a block's task holds its own vectors
and streams the queries by. A share of a block is fixed, not a number, so recall does not fall with the table: where
distances are nearly all alike, hash strings tell little, and a forest has to look at many vectors to find the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import Scratch

#: Vectors a block, on average.
BLOCK = 8192
#: Trees, bits of a hash string, and candidates (a share of the block) at which the ascent ends.
TREES, BITS, CANDIDATES = 64, 24, 0.35
#: Vectors of a block that the hyperplanes' medians are fitted on.
SAMPLE = 2048


class Forest:
    """The forest of one block. ids: int64; vectors: float64, one row each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.ids, self.vectors, self.bits = ids, vectors, bits
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(vectors.shape[1], trees * bits))
        sample = vectors[:: max(1, len(vectors) // SAMPLE)][:SAMPLE]
        self.cuts = np.median(sample @ self.planes, axis=0)
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, 0)
        self.squares = (vectors**2).sum(1)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """One hash string a tree, the first hyperplane's bit on top."""
        out = np.empty((len(vectors), self.planes.shape[1] // self.bits), np.uint64)
        weight = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        for at in range(0, len(vectors), 4096):
            bits = vectors[at : at + 4096] @ self.planes > self.cuts
            out[at : at + 4096] = (bits.reshape(len(bits), -1, self.bits) * weight).sum(2, dtype=np.uint64)
        return out

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, enough: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and distances of each query's k nearest candidates other than its own id; ties go to the smaller id."""
        strings = self.strings(queries)
        trees, n = strings.shape[1], len(self.ids)
        # Range of each query's subtree in each tree at each depth.
        low = np.zeros((self.bits + 1, len(queries), trees), np.int64)
        high = np.full_like(low, n)
        for depth in range(1, self.bits + 1):
            drop = np.uint64(self.bits - depth)
            first = (strings >> drop) << drop
            last = first | ((np.uint64(1) << drop) - np.uint64(1))
            for t in range(trees):
                low[depth, :, t] = np.searchsorted(self.sorted[:, t], first[:, t], "left")
                high[depth, :, t] = np.searchsorted(self.sorted[:, t], last[:, t], "right")
        out = []
        for q, vector in enumerate(queries):
            found = np.zeros(n, bool)
            below_low = below_high = None
            for depth in range(self.bits, -1, -1):
                a, b = low[depth, q], high[depth, q]
                if below_low is None:
                    for t in np.flatnonzero(b > a):
                        found[self.order[a[t] : b[t], t]] = True
                else:
                    for t in np.flatnonzero((a < below_low) | (b > below_high)):
                        found[self.order[a[t] : below_low[t], t]] = True
                        found[self.order[below_high[t] : b[t], t]] = True
                below_low, below_high = a, b  # equal for an empty subtree: its place
                if found.sum() >= enough:
                    break
            at = np.flatnonzero(found)
            at = at[self.ids[at] != own[q]]
            if len(at) > 4 * k:
                # A cheap bound first; the exact distances decide among all that could be in.
                near = self.squares[at] - 2 * (self.vectors[at] @ vector)
                reach = np.partition(near, k - 1)[k - 1]
                at = at[near <= reach + 1e-9 * (abs(reach) + self.squares[at].max() + 1)]
            distance = np.sqrt(((self.vectors[at] - vector) ** 2).sum(1))
            best = np.lexsort((self.ids[at], distance))[:k]
            out.append((self.ids[at[best]], distance[best]))
        return out


def _serve(batches: Iterator[pa.RecordBatch], k: int, share: float) -> Iterator[pa.RecordBatch]:
    """Rows (block, role, id, vector) sorted by block and role: role 0 are a block's vectors, 1 the queries."""
    block, ids, vectors, forest = None, [], [], None
    for batch in batches:
        blocks, roles, own = (batch.column(i).to_numpy() for i in range(3))
        at = 0
        while at < batch.num_rows:
            same = (blocks[at:] == blocks[at]) & (roles[at:] == roles[at])
            to = at + (len(same) if same.all() else int(same.argmin()))
            if blocks[at] != block:
                block, ids, vectors, forest = blocks[at], [], [], None
            rows = batch.column(3).slice(at, to - at).flatten().to_numpy().reshape(to - at, -1)
            if roles[at] == 0:
                ids.append(own[at:to])
                vectors.append(rows)
            elif ids:
                if forest is None:
                    forest = Forest(np.concatenate(ids), np.concatenate(vectors))
                for some in range(at, to, 256):
                    part = slice(some, min(to, some + 256))
                    found = forest.search(rows[some - at : part.stop - at], own[part], k, max(20 * k, int(share * len(forest.ids))))
                    n = [len(i) for i, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(own[part], n)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([d for _, d in found]))],
                        names=["query_id", "vec_id", "score"],
                    )
            at = to


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, vector (array<double>) of the rows whose vectors are neither null, empty nor zero and have finite components only."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    return out.where(finite & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, share: float = CANDIDATES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query (id divisible by `every`): query_id, rank, vec_id, score (Euclidean distance).

    Candidates are all rows but the query's own id; with fewer than k all of them are returned. Vectors that are null,
    empty, zero or not finite take no part, nor do null ids. Rows with equal ids count once for each different vector
    as candidates; a repeated query row gives its neighbours once. Vectors of another length than most take part among
    their own length only. An empty table gives no rows.
    """
    held = Scratch(vectors.sparkSession, "forest")
    rows = held.table(usable(vectors, id_col, vector_col).dropDuplicates(["id", "vector"]), "vectors")
    n = rows.count()
    blocks = max(1, -(-n // BLOCK))
    length = F.size("vector").cast("long")
    data = rows.select((length * 2**32 + F.pmod(F.xxhash64("id"), F.lit(blocks))).alias("block"), F.lit(0).alias("role"), "id", "vector")
    asked = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("role"), "id", "vector")
    asked = asked.withColumn("block", length * 2**32 + F.col("block"))
    parted = data.unionByName(asked).repartition(F.col("block")).sortWithinPartitions("block", "role", "id")
    found = parted.mapInArrow(lambda b: _serve(b, k, share), "query_id long, vec_id long, score double")
    first = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
