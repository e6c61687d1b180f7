"""MinHash near-dedup with sequential Bayesian verification.

Documents with equal shingle sets form a class with one representative. Representatives get BANDS * ROWS minhashes; those
that agree on a whole band are candidates. Their signatures (one byte a minhash) are compared batch by batch, and a
candidate is dropped as soon as the posterior probability that its similarity reaches the threshold falls below MISS.
Survivors are confirmed on the full shingle sets.

No bucket is expanded into its pairs. First every member meets the bucket's smallest id; confirmed links make
components. Then, where a bucket holds several components, the signatures of its members are compared across components,
in blocks of bounded size, and what is sent on is that a document may be linked with a component - one row, however many
of its members are alike. Such a document meets all members of that component, again in blocks, with the texts at hand,
until one link is confirmed. So every link between components is found, if not each of several.

Joins with one row a class, bucket or component have a written table on that side, so adaptive execution can split the
partition of a hot one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.llm import wordhash
from kinmatch.llm.common import Scratch, portions
from kinmatch.llm.components import components

#: A pair of the threshold similarity 0.8 shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS = 5e-6.
BANDS, ROWS = 40, 6
SIZE = BANDS * ROWS
#: Minhashes that a step of the verification adds, and the posterior probability below which a pair is dropped.
BATCH, MISS = 40, 1e-4
#: Side of a block of bucket members that are compared at once, and of one where there are more than FEWER such blocks;
#: bytes of texts in a block that holds them, and of the shingle sets that a worker keeps.
BLOCK, WIDE, FEWER, BLOCK_BYTES, KEPT_BYTES = 256, 2048, 16, 8 << 20, 64 << 20

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, SIZE, dtype=np.uint32)


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; with fewer words, of the whole sequence; empty without words."""
    words = wordhash.words(text, lower=True)[0]
    if not len(words):
        return words
    at = np.arange(max(1, len(words) - n + 1))
    return np.unique(wordhash.runs(words, at, np.minimum(at + n, len(words))))


def minhashes(keys: np.ndarray) -> np.ndarray:
    """SIZE minima of multiply-add hashes of the (already mixed) keys."""
    x = (keys >> np.uint64(32)).astype(np.uint32)
    low = np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        h = x[at : at + 512, None] * _A
        h += _B
        np.minimum(low, h.min(0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = wordhash.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest matching bytes with which a pair is kept.

    With a uniform prior the posterior of the similarity after m matches of n is a beta distribution; it is integrated
    on a grid. Bytes of different minhashes match by chance once in 256.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, SIZE + 1, BATCH):
        least = 0
        for m in range(n + 1):
            logs = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(logs - logs.max())
            if weight[s >= threshold].sum() / weight.sum() >= miss:
                least = m
                break
        out.append(least)
    return tuple(out)


def plausible(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures (rows of x and y): which survive all batches, and their matches so far."""
    alive, matches = np.arange(len(x)), np.zeros(len(x), int)
    for k, least in enumerate(least_matches(threshold, MISS)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (x[alive, part] == y[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    return alive, matches


def _describe(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1):
        sizes, ones, twos, keys, marks = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            found = shingles(text or "", n)
            sizes.append(len(found))
            ones.append(int(found.sum(dtype=np.uint64)))
            twos.append(int(np.bitwise_xor.reduce(wordhash.mix(found))) if len(found) else 0)
            # Different linked sets have at least percent / (100 - percent) elements in common.
            low = minhashes(found) if len(found) * (100 - percent) >= percent else None
            keys.append(None if low is None else bands(low).view(np.int64))
            marks.append(None if low is None else (low & np.uint32(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(np.array(ones, np.uint64).view(np.int64)), pa.array(np.array(twos, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
            names=["doc_id", "hash", "n_shingles", "sum", "xor", "bands", "marks"],
        )


def _prune(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs with signatures and sizes -> those that may reach the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, x, y, m, n = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "x", "y", "m", "n"))
        small, large = np.minimum(m.to_numpy(), n.to_numpy()), np.maximum(m.to_numpy(), n.to_numpy())
        sized = np.flatnonzero(small >= threshold * large - 1e-9)
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SIZE) for c in (x, y))
        alive, _ = plausible(x[sized], y[sized], threshold)
        keep = pa.array(sized[alive])
        yield pa.RecordBatch.from_arrays([a.take(keep), b.take(keep)], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts -> the pairs whose sets overlap by percent or more."""
    held: dict[int, np.ndarray] = {}
    bytes_ = 0
    for batch in batches:
        a, b, x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "x", "y"))
        keep = []
        for i in range(len(a)):
            sets = []
            for key, text in ((a[i], x[i]), (b[i], y[i])):
                if (found := held.get(key)) is None:
                    found = shingles(text, n)
                    if bytes_ + found.nbytes > KEPT_BYTES:
                        held.clear()
                        bytes_ = 0
                    held[key] = found
                    bytes_ += found.nbytes
                sets.append(found)
            both = len(np.intersect1d(*sets, assume_unique=True))
            if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("a")).take(at), batch.column(batch.schema.get_field_index("b")).take(at)], names=["a", "b"])


def _tasks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """The rows of side 0 and side 1 of each task, from rows sorted by task; the first two columns are task and side."""
    task, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)):
            if row[0] != task:
                if rows:
                    yield [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]
                task, rows = row[0], []
            rows.append(row)
    if rows:
        yield [r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]


def _marks(rows: list[tuple], at: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in rows), np.uint8).reshape(-1, SIZE)


def _alike(sizes: np.ndarray, size: int, threshold: float) -> np.ndarray:
    return np.minimum(sizes, size) >= threshold * np.maximum(sizes, size) - 1e-9


def _pairs(found: list[tuple[int, int]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=names)


def _near_components(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Blocks of a bucket: which documents of side 0 may be linked with which other components of side 1."""
    for left, right in _tasks(batches, ("task", "side", "id", "component", "n", "marks")):
        if not left or not right:
            continue
        comps, sizes = np.array([r[3] for r in right]), np.array([r[4] for r in right])
        ys, found = _marks(right, 5), []
        for r, x in zip(left, _marks(left, 5)):
            able = np.flatnonzero((comps != r[3]) & _alike(sizes, r[4], threshold))
            alive, _ = plausible(np.broadcast_to(x, (len(able), SIZE)), ys[able], threshold)
            found += [(r[2], c) for c in np.unique(comps[able[alive]]).tolist()]
        yield _pairs(found, ["id", "component"])


def _first_links(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one component (side 1) and documents that may be linked with it: a confirmed link of each, if there is one."""
    for left, right in _tasks(batches, ("task", "side", "id", "n", "marks", "text")):
        if not left or not right:
            continue
        sizes, ys, found = np.array([r[3] for r in right]), _marks(right, 4), []
        sets: dict[int, np.ndarray] = {}
        for r, x in zip(left, _marks(left, 4)):
            able = np.flatnonzero(_alike(sizes, r[3], percent / 100))
            alive, matches = plausible(np.broadcast_to(x, (len(able), SIZE)), ys[able], percent / 100)
            own = shingles(r[5], n) if len(alive) else None
            for k in alive[np.argsort(-matches[alive], kind="stable")].tolist():
                at = int(able[k])
                if at not in sets:
                    sets[at] = shingles(right[at][5], n)
                both = len(np.intersect1d(own, sets[at], assume_unique=True))
                if 100 * both >= percent * (len(own) + len(sets[at]) - both):
                    found.append((r[2], right[at][2]))
                    break
        yield _pairs(found, ["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(lambda b: _confirm(b, n, percent), "a long, b long")


def _blocks(n: Column) -> Column:
    """Blocks of n members: small ones spread the work, wide ones bound what is sent."""
    return F.when(n <= BLOCK * FEWER, F.ceil(n / BLOCK)).otherwise(F.greatest(F.lit(FEWER), F.ceil(n / WIDE))).cast("int")


def _text_blocks(n: Column, size: Column) -> Column:
    """Blocks of n members with texts of `size` bytes together."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of two sides of each key, dealt to tasks of bounded size: `near` blocks of the left by `far` of the right."""
    own = F.xxhash64("doc_id")
    other = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    task = lambda a, b: F.xxhash64(key, a.cast("long"), b.cast("long")).alias("task")
    kept = [c for c in left.columns if c not in (key, "near", "far")]
    first = left.withColumn("other", other("far")).select(task(F.pmod(own, F.col("near")), F.col("other")), F.lit(0).alias("side"), *kept)
    second = right.withColumn("other", other("near")).select(task(F.col("other"), F.pmod(own, F.col("far"))), F.lit(1).alias("side"), *kept)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_shingles, component_id (smallest id reachable by links, itself included), kept.

    Two documents are linked if their sets of n-word shingles, of words with A-Z in lower case, have a Jaccard
    similarity of percent / 100 or more; a text of fewer than n words counts as one shingle, one without words (or
    null) has none and is linked with nothing. kept: the id is its component's. Ids are whole numbers. Rows with equal
    ids are one document and share a component; if their texts differ, the one with the smallest hash is linked. A row
    with a null id takes no part: its component is null and it is kept. An empty table gives no rows.
    """
    held = Scratch(docs.sparkSession, "minhash")
    threshold = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    described = held.table(rows.mapInArrow(lambda b: _describe(b, n, percent), "doc_id long, hash long, n_shingles long, sum long, xor long, bands array<long>, marks binary"), "described")
    # One row an id: that of the smallest hash of the text.
    live = described.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.min(F.struct("hash", "n_shingles", "sum", "xor")).alias("x")).select("doc_id", "x.*")
    classes = held.table(live.groupBy("n_shingles", "sum", "xor").agg(F.min("doc_id").alias("rep")), "classes")
    members = held.table(live.join(classes.hint("merge"), ["n_shingles", "sum", "xor"]).select("doc_id", "hash", "rep"), "members")
    chosen = members.where("doc_id = rep").select("doc_id", "hash")
    sized = described.where("bands IS NOT NULL").join(chosen.hint("merge"), ["doc_id", "hash"], "left_semi")
    reps = held.table(sized.dropDuplicates(["doc_id"]).select("doc_id", "hash", "n_shingles", "bands", "marks"), "reps")

    banded = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("top")).where("hub < top")
    buckets = held.table(buckets.select("bucket", "hub"), "buckets")
    shared = held.table(banded.join(buckets.hint("merge"), "bucket"), "shared")
    some = shared.select("doc_id").distinct().join(reps.select("doc_id", "hash").hint("merge"), "doc_id")
    texts = held.table(rows.join(some.hint("merge"), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text"), "texts")
    marks = reps.select("doc_id", "n_shingles", "marks")

    # First round: each member with the smallest id of each of its buckets.
    pairs = shared.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = pairs.join(marks.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("m"), F.col("marks").alias("x")).hint("merge"), "a")
    pairs = pairs.join(marks.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n"), F.col("marks").alias("y")).hint("merge"), "b")
    survivors = held.table(pairs.mapInArrow(lambda b: _prune(b, threshold), "a long, b long"), "survivors")
    links = held.table(_confirmed(survivors, texts, n, percent), "links")
    found = held.table(components(links, held), "components")

    # Second round: across the components that meet in a bucket.
    placed = shared.join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    open_ = counts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    open_ = held.table(open_.select("bucket", "main", _blocks(F.col("others")).alias("near"), _blocks(F.col("size")).alias("far")), "open")
    work = placed.join(open_.hint("merge"), "bucket")
    # Those outside of the bucket's main component meet all.
    sides = _sides(work.where("component <> main").select("bucket", "near", "far", "doc_id", "component"), work.select("bucket", "near", "far", "doc_id", "component"), "bucket")
    sides = sides.join(marks.hint("merge"), "doc_id").select("task", "side", F.col("doc_id").alias("id"), "component", F.col("n_shingles").alias("n"), "marks")
    sides = sides.repartition("task").sortWithinPartitions("task", "side", "id")
    near = held.table(sides.mapInArrow(lambda b: _near_components(b, threshold), "id long, component long").distinct(), "near")

    # Documents that may be linked with a component meet its members, with the texts at hand.
    weights = texts.select("doc_id", F.octet_length("text").alias("bytes"))
    sizes = weights.join(found.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"), "bytes")
    asking = near.withColumnRenamed("id", "doc_id")
    asked = asking.join(weights.hint("merge"), "doc_id").groupBy("component").agg(_text_blocks(F.count("*"), F.sum("bytes")).alias("near"))
    inside = sizes.groupBy("component").agg(_text_blocks(F.count("*"), F.sum("bytes")).alias("far"))
    blocks = held.table(inside.join(asked.hint("merge"), "component"), "blocks")
    wide = lambda rows: rows.join(blocks.hint("merge"), "component").select("component", "near", "far", "doc_id")
    sides = _sides(wide(asking), wide(sizes), "component")
    sides = sides.join(marks.hint("merge"), "doc_id").join(texts.hint("merge"), "doc_id").select("task", "side", F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "marks", "text")
    sides = sides.repartition("task").sortWithinPartitions("task", "side", "id")
    more = sides.mapInArrow(lambda b: _first_links(b, n, percent), "a long, b long")
    links = found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more)
    found = held.table(components(links, held), "components")

    reached = members.join(found.hint("merge"), F.col("rep") == F.col("node"), "left")
    reached = reached.select(F.col("doc_id").alias("_doc"), F.coalesce("component", "rep").alias("_component"))
    kind = docs.schema[id_col].dataType
    told = described.where("doc_id IS NOT NULL").select("doc_id", "n_shingles").join(reached.hint("merge"), F.col("doc_id") == F.col("_doc"), "left")
    told = told.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component"))
    out = told.unionByName(described.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("doc_id").cast(kind).alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))
