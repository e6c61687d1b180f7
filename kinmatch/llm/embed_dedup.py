"""Embedding near-dedup by NN-descent.

Equal vectors of a label form a class with one representative, a node. Nodes start from neighbours in the order of
several hash strings; then, round by round, the neighbours of each node are compared with one another, and every node
keeps the K nearest it has met - more where all K are links already (a saturated list). Lists only steer the search:
whatever is measured above the threshold goes to a table of links that is never shortened, and makes the components.

An audit samples nodes of each size of group, finds all their links, and asks for more hash strings and rounds while a
sampled node has a link across components. Where the last audit still finds one, all nodes of a label are compared by
blocks, so the components are then exact. Links of nodes in one component are counted in full, block by block, so a
count is not limited by list lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import Scratch
from kinmatch.llm.components import components

#: Length of a list, and of a saturated one; reverse neighbours that join a local comparison.
K, SATURATED, REVERSE = 8, 32, 8
#: Hash strings for the start, those added each time the largest label doubles beyond FEW vectors, their bits, and how
#: many following vectors each meets there.
TABLES, MORE, FEW, BITS, AHEAD = 8, 3, 1024, 24, 3
#: Rounds before each audit, audits before all is compared, and nodes audited of a size of group: so many, or SHARE
#: times the root of their number if that is more, but MOST at most, as the driver holds them.
ROUNDS, AUDITS, AUDITED, SHARE, MOST = 1, 4, 256, 8, 4096
#: Side of a block in which links are counted or completed, and of one where a group has more than FEWER such blocks.
BLOCK, WIDE, FEWER = 512, 4096, 8


def _blocks(n: Column) -> Column:
    """Blocks of a group of n: small ones spread the work, wide ones bound what is sent."""
    return F.when(n <= BLOCK * FEWER, F.ceil(n / BLOCK)).otherwise(F.greatest(F.lit(FEWER), F.ceil(n / WIDE))).cast("int")


def _columns(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """All columns but the last as arrays; of the last, vectors, the unit vectors one after another, and their ends."""
    vectors = batch.columns[-1]
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(lengths)]
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat):
        flat /= np.repeat(np.sqrt(np.add.reduceat(flat * flat, ends[:-1])), lengths)
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]], flat, ends


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Rows in the order of their first column -> the other columns and the unit vectors of each group of equal ones.

    The last column holds the vectors, which have one length in a group. None after each batch: a place to send results.
    """
    key, open_ = None, []

    def closed() -> tuple[list[np.ndarray], np.ndarray]:
        return [np.concatenate([g[0][k] for g in open_]) for k in range(len(open_[0][0]))], np.concatenate([g[1] for g in open_])

    for batch in batches:
        if batch.num_rows:
            (first, *rest), flat, ends = _columns(batch)
            cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
            for a, b in zip(cuts, cuts[1:]):
                if open_ and first[a] != key:
                    yield closed()
                    open_ = []
                key = first[a]
                open_.append(([c[a:b] for c in rest], flat[ends[a] : ends[b]].reshape(b - a, -1)))
        yield None
    if open_:
        yield closed()
    yield None


def _sent(found: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = {"sim": np.float64}
    columns = [np.concatenate([np.empty(0, kinds.get(name, np.int64)), *(f[k] for f in found)]) for k, name in enumerate(names)]
    return pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in columns], names=list(names))


def _mapped(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], compare) -> Iterator[pa.RecordBatch]:
    """compare(columns, vectors) of each group; the results of a batch are sent on together."""
    found = []
    for group in _groups(batches):
        if group is not None:
            found.append(compare(*group))
        elif found:
            yield _sent(found, names)
            found = []


def _keys(batches: Iterator[pa.RecordBatch], tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    """node, grp, vector -> the same in each table, with its hash string there."""
    planes: dict[int, np.ndarray] = {}
    weight = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
        for length in np.unique(lengths).tolist():
            part = batch.take(pa.array(np.flatnonzero(lengths == length)))
            if length not in planes:
                planes[length] = np.random.default_rng(seed).normal(size=(length, tables * BITS))
            bits = (_columns(part)[1].reshape(part.num_rows, length) @ planes[length] > 0).reshape(part.num_rows, tables, BITS)
            keys = (bits * weight).sum(2)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.full(part.num_rows, t, np.int32)), pa.array(keys[:, t]), part.column(2)], names=["node", "grp", "tab", "key", "vector"])


def _adjacent(batches: Iterator[pa.RecordBatch], ahead: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, grp, tab, vector) in the order of (grp, tab, key): each with the next ones of its group and table."""
    last, ids, vectors = None, np.empty(0, np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        (node, grp, tab), flat, ends = _columns(batch)
        found = []
        cuts = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (tab[1:] != tab[:-1])) + 1).tolist(), len(node)]
        for a, b in zip(cuts, cuts[1:]):
            some = flat[ends[a] : ends[b]].reshape(b - a, -1)
            old = 0
            if last == (grp[a], tab[a]):
                old, ids, vectors = len(ids), np.concatenate([ids, node[a:b]]), np.concatenate([vectors, some])
            else:
                last, ids, vectors = (grp[a], tab[a]), node[a:b], some
            for s in range(1, min(ahead, len(ids) - 1) + 1):
                at = np.arange(max(0, old - s), len(ids) - s)
                found.append((ids[at], ids[at + s], np.einsum("ij,ij->i", vectors[at], vectors[at + s])))
            ids, vectors = ids[-ahead:], vectors[-ahead:]
        yield _sent(found, ("a", "b", "sim"))


def _reached(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A symmetric matrix of links -> each node with links beside the first node that they reach, but for that one itself."""
    first = np.full(len(linked), -1)
    for i in np.flatnonzero(linked.any(1)):
        front = np.array([i] if first[i] < 0 else [], int)
        while len(front):
            first[front] = i
            front = np.flatnonzero(linked[front].any(0) & (first < 0))
    at = np.flatnonzero((first >= 0) & (first != np.arange(len(first))))
    return first[at], at


def _local(threshold: float):
    """The neighbours (id, worst) of a node, compared with one another.

    A pair is sent on if it would enter either list. All that links join here is sent on too, with a null sim, one row
    a vector: whatever its list holds, no link that was measured is lost to the components.
    """

    def compare(columns: list[np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, worst = columns
        sim = v @ v.T
        i, j = np.nonzero(np.triu((sim > worst[:, None]) | (sim > worst[None, :]), 1))
        linked = sim >= threshold
        np.fill_diagonal(linked, False)
        c, d = _reached(linked) if linked.any() else (np.empty(0, int), np.empty(0, int))
        return np.concatenate([ids[i], ids[c]]), np.concatenate([ids[j], ids[d]]), np.concatenate([sim[i, j], np.full(len(c), np.nan)])

    return compare


def _shortened(pairs: DataFrame, threshold: float, k: int) -> DataFrame:
    """a, b, sim in both directions -> each vector's list: its k nearest, and more links if all k are links."""
    best = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= max(SATURATED, 2 * k))
    return ranked.where((F.col("rank") <= k) | (F.col("sim") >= threshold))


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "sim").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def _round(lists: DataFrame, nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs that would enter a list, and with a null sim what links join."""
    worst = lists.groupBy("a").agg(F.when(F.max("rank") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    few = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), F.xxhash64("b")))
    back = back.withColumn("rank", few).where(F.col("rank") <= REVERSE)
    # Long lists of links are thinned by a hash, so that other ones take part in every round.
    near = lists.select("a", "b").where(F.col("rank") <= 2 * k).unionByName(back.select("a", "b")).unionByName(lists.select("a", F.col("a").alias("b")).distinct()).distinct()
    rows = near.select(F.col("a").alias("at"), F.col("b").alias("node")).join(worst.withColumnRenamed("a", "node").hint("merge"), "node").join(nodes.select("node", "vector").hint("merge"), "node")
    rows = rows.select("at", "node", "worst", "vector").repartition("at").sortWithinPartitions("at", "node")
    return rows.mapInArrow(lambda b: _mapped(b, ("a", "b", "sim"), _local(threshold)), "a long, b long, sim double")


def _seeds(nodes: DataFrame, tables: int, ahead: int, seed: int) -> DataFrame:
    """Pairs of vectors that follow one another in the order of a hash string."""
    kind = nodes.schema["vector"].dataType.simpleString()
    keyed = nodes.select("node", "grp", "vector").mapInArrow(lambda b: _keys(b, tables, seed), f"node long, grp long, tab int, key long, vector {kind}")
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionByRange(parts, "grp", "tab", "key", "node").sortWithinPartitions("grp", "tab", "key", "node")
    return ordered.select("node", "grp", "tab", "vector").mapInArrow(lambda b: _adjacent(b, ahead), "a long, b long, sim double")


def _complete(nodes: DataFrame, found: DataFrame, sizes: DataFrame, threshold: float) -> bool:
    """Whether no node of a sample of each size of group has a link to another component, or out of none; sizes:
    component, size."""
    sized = found.join(sizes.hint("merge"), "component").select("node", "component", F.least(F.floor(F.log2("size")), F.lit(12)).cast("int").alias("stratum"))
    placed = nodes.select("node", "grp", "vector").join(sized.hint("merge"), "node", "left").withColumn("stratum", F.coalesce("stratum", F.lit(0))).withColumn("component", F.coalesce("component", "node"))
    # At most MOST nodes of each of 13 strata.
    most = {s: min(MOST, max(AUDITED, SHARE * math.isqrt(n))) / n for s, n in placed.groupBy("stratum").count().collect()}
    if not most:
        return True
    chance = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) / (1 << 30)
    rate = F.element_at(F.create_map(*(F.lit(x) for pair in most.items() for x in pair)), F.col("stratum"))
    sides: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in placed.where(chance < rate).select("grp", "component", "vector").orderBy("grp").toArrow().combine_chunks().to_batches():
        (grp, component), flat, ends = _columns(batch)
        cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
        for a, b in zip(cuts, cuts[1:]):
            c, v = sides.get(int(grp[a]), (np.empty(0, np.int64), np.empty((0, (ends[b] - ends[a]) // (b - a)))))
            sides[int(grp[a])] = np.concatenate([c, component[a:b]]), np.concatenate([v, flat[ends[a] : ends[b]].reshape(b - a, -1)])
    sent = nodes.sparkSession.sparkContext.broadcast(sides)

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            (grp, component), flat, ends = _columns(batch)
            order = np.argsort(grp, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(grp[order])) + 1).tolist(), len(grp)] if len(grp) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if (g := int(grp[order[a]])) in sent.value:
                    c, v = sent.value[g]
                    for some in range(a, b, 1024):
                        at = order[some : min(b, some + 1024)]
                        own = flat[(ends[at][:, None] + np.arange(v.shape[1]))]
                        n += int(((own @ v.T >= threshold) & (component[at][:, None] != c[None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    n = placed.select("grp", "component", "vector").mapInArrow(missed, "n long").agg(F.sum("n")).first()[0]
    sent.destroy()
    return not n


def _joined(threshold: float):
    """What links of all vectors of a group join, one row a vector; compared in strips of bounded size."""

    def compare(columns: list[np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (ids,) = columns
        linked = np.zeros((len(v), len(v)), bool)
        for at in range(0, len(v), BLOCK):
            linked[at : at + BLOCK] = v[at : at + BLOCK] @ v.T >= threshold
        np.fill_diagonal(linked, False)
        first, at = _reached(linked)
        return ids[first], ids[at]

    return compare


def _all_links(nodes: DataFrame, threshold: float) -> DataFrame:
    """What the links of all pairs of vectors of a label and length join: every block meets every other one."""
    blocks = nodes.groupBy("grp").agg(_blocks(F.count("*")).alias("blocks"))
    rows = nodes.join(blocks.hint("merge"), "grp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A block alone is met in its tasks with others, if there are any.
    rows = rows.where("blocks = 1 OR own <> other").select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "node", "vector")
    return rows.repartition("task").sortWithinPartitions("task", "node").mapInArrow(lambda b: _mapped(b, ("a", "b"), _joined(threshold)), "a long, b long")


def _count_links(threshold: float):
    """Columns own (a block), node, weight of one or two blocks: links of each vector to those of the other block, or of
    its own where there is but one. A link to a vector counts as often as that has copies."""

    def compare(columns: list[np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, ids, weight = columns
        n = np.zeros(len(v), np.int64)
        if own.min() == own.max():
            for at in range(0, len(v), BLOCK):
                linked = v[at : at + BLOCK] @ v.T >= threshold
                linked[np.arange(len(linked)), np.arange(at, at + len(linked))] = False
                n[at : at + BLOCK] = linked @ weight
        else:
            left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
            for at in range(0, len(left), BLOCK):
                some = left[at : at + BLOCK]
                linked = v[some] @ v[right].T >= threshold
                n[some] += linked @ weight[right]
                n[right] += weight[some] @ linked
        return ids, n

    return compare


def _counts(nodes: DataFrame, found: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """node, n: links of each node to others, all of which are in its component; nodes: with weight.

    A component of m nodes is cut into blocks, and each pair of blocks is one task: a node is sent once a block.
    """
    placed = nodes.join(found.hint("merge"), "node").join(sizes.select("component", _blocks(F.col("size")).alias("blocks")).hint("merge"), "component")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = placed.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "own", "node", "weight", "vector")
    tasks = tasks.repartition("task").sortWithinPartitions("task", "node")
    return tasks.mapInArrow(lambda b: _mapped(b, ("node", "n"), _count_links(threshold)), "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: id_col, n_links, component_id (smallest id reachable by links, itself included), kept.

    Only vectors of one label and length are compared; null labels, and vectors that are null, empty, zero or hold null
    or non-finite components, link with nothing. Repeated rows (equal in id, label and vector) are one vector and each
    give a row. Rows with equal ids and different labels or vectors are vectors of their own that happen to share an id:
    they are linked and counted like any others, and each keeps its own component. Equal vectors of a label are links
    of one another. A null id takes no part: no links, a null component, kept. An empty table gives no rows.
    """
    held = Scratch(vectors.sparkSession, "embeddings")
    kind = vectors.schema[id_col].dataType
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    able = F.coalesce(F.expr("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0") & finite, F.lit(False))
    rows = rows.withColumn("able", able).withColumn("one", F.xxhash64("vector")).withColumn("two", F.hash("vector", F.lit(7)))
    live, same = rows.where("able"), ["label", "one", "two"]
    nodes = held.table(live.dropDuplicates(same).select(F.monotonically_increasing_id().alias("node"), F.xxhash64("label", F.size("vector")).alias("grp"), *same, "vector"), "nodes")
    shared = live.select("id", *same).distinct().groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = held.table(shared.join(nodes.select("node", *same).hint("merge"), same), "classes")

    largest = nodes.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    tables = TABLES + MORE * max(0, math.ceil(math.log2(max(largest, 1) / FEW)))
    lists, links, k = None, [], K
    for audit in range(AUDITS):
        met = held.table(_seeds(nodes, tables, AHEAD << audit, 5 + audit), "met")
        links.append(held.table(met.where(F.col("sim") >= threshold).select("a", "b").distinct(), "links"))
        for step in range(1 + ROUNDS):
            if step:
                met = held.table(_round(lists, nodes, threshold, k), "met")
                links.append(held.table(met.where("sim IS NULL").select("a", "b").distinct(), "links"))
            near = _both(met.where("sim IS NOT NULL"))
            after = held.table(_shortened(_both(lists).unionByName(near) if lists else near, threshold, k), "lists")
            held.drop(met, *([lists] if lists else []))
            lists = after
        found = held.table(components(reduce(DataFrame.unionByName, links), held), "components")
        sizes = held.table(found.groupBy("component").agg(F.count("*").alias("size")), "sizes")
        if _complete(nodes, found, sizes, threshold):
            break
        k *= 2
    else:
        links.append(held.table(_all_links(nodes, threshold), "links"))
        found = held.table(components(reduce(DataFrame.unionByName, links), held), "components")
        sizes = held.table(found.groupBy("component").agg(F.count("*").alias("size")), "sizes")

    weighed = nodes.select("node", "vector").join(classes.select("node", "weight").hint("merge"), "node")
    told = classes.join(_counts(weighed, found, sizes, threshold).hint("merge"), "node", "left").join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    told = held.table(told.select(*same, "rep", "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links")), "told")
    firsts = held.table(told.groupBy("component").agg(F.min("rep").alias("first")), "firsts")
    told = held.table(told.join(firsts.hint("merge"), "component").select(*same, "links", "first"), "told")

    linked = live.select("id", *same).join(told.hint("merge"), same).select("id", "links", "first")
    alone = rows.where("NOT able").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("first"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("links").alias("n_links"), F.col("first").alias("component_id"), F.coalesce(F.col("first") == F.col("id"), F.lit(True)).alias("kept"))
