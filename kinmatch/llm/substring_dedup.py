"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the ANCHOR-word runs in every WINDOW-word window the one with the smallest hash. Equal
windows choose equal anchors, so no repeat of WINDOW words is missed. Documents are joined on anchors that occur more
than once, and every shared anchor is extended both ways: first over its whole reach - all windows that chose it, which
is one comparison - and, where reaches of the same anchor differ, window by window. What windows match in a document
with a smaller id is joined to maximal repeats, and their words are removed.

A group of matches is never expanded into pairs: each side meets only the group's smallest id, found by a pre-aggregated
minimum, in joins that have one row a group on the other side. That side is a written table, so a partition with a hot
group can be split by adaptive execution (it can't behind an aggregate). All decisions are made on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm import wordhash
from kinmatch.llm.common import Scratch, fields, portions, spread_nulls, without

WINDOW = 13
ANCHOR = 4


def anchors(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, reach hash, first and last window start of each maximal run of windows that chose the same anchor.

    Empty for fewer words than a window.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, int), np.empty(0, int)
    at = np.arange(len(hashes) - anchor + 1)
    chosen = wordhash.sliding_min(wordhash.runs(hashes, at, at + anchor), window - anchor + 1)
    first = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
    last = np.r_[first[1:], n] - 1
    return chosen[first], wordhash.runs(hashes, first, last + window, 1), first, last


def _different(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and reach of each different reach of a text; a reach holds its anchor."""
    seed, reach, *_ = anchors(hashes, window)
    reach, at = np.unique(reach, return_index=True)
    return seed[at], reach


def _windows(hashes: np.ndarray, window: int) -> np.ndarray:
    at = np.arange(max(0, len(hashes) - window + 1))
    return wordhash.runs(hashes, at, at + window, 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _list(column: pa.Array, row: int) -> np.ndarray:
    """A row of a list<long> column as unsigned numbers; empty for null."""
    value = column[row].values
    return np.empty(0, np.uint64) if value is None else value.to_numpy(zero_copy_only=False).view(np.uint64)


def _count_anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1):
        found = [np.empty(0, np.uint64)]
        for text in batch.column(1).to_pylist():
            found.append(_different(wordhash.words(text)[0], window)[0])  # one count for each reach in a document
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        if len(keys):
            yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(n.astype(np.int64))], names=["seed", "n"])


def _list_anchors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1):
        seeds, reaches, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], []
        for text in batch.column(1).to_pylist():
            seed, reach = _different(wordhash.words(text)[0], window)
            seeds.append(seed)
            reaches.append(reach)
            sizes.append(len(seed))
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([_signed(np.concatenate(seeds)), _signed(np.concatenate(reaches)), ids], names=["seed", "reach", "doc_id"])


def _list_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Windows of the anchors whose reach is the first of its kind but shares the anchor with other reaches."""
    for batch in portions(batches, 1):
        out, sizes = [np.empty(0, np.uint64)], []
        open_at = batch.schema.get_field_index("open")
        for row, text in enumerate(batch.column(1).to_pylist()):
            hashes = wordhash.words(text)[0]
            _, reach, first, last = anchors(hashes, window)
            all_windows = _windows(hashes, window)
            wanted = np.isin(reach, _list(batch.column(open_at), row))
            marks = np.zeros(len(all_windows) + 1, int)
            np.add.at(marks, first[wanted], 1)
            np.add.at(marks, last[wanted] + 1, -1)
            keys = np.unique(all_windows[np.cumsum(marks)[:-1] > 0]) if len(all_windows) else all_windows
            out.append(keys)
            sizes.append(len(keys))
        ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([_signed(np.concatenate(out)), ids], names=["window", "doc_id"])


def _remove(text: str, reaches: np.ndarray, windows: np.ndarray, window: int, spans: bool) -> tuple[int, int, bytes]:
    """Words, removed words, and what is left: the kept words joined by one space or, with spans, the text without the
    removed words and the white space behind them."""
    data = text.encode("utf-8", "surrogatepass")
    if not len(reaches) and not len(windows):
        parts = data.split()  # of bytes: at ASCII white space
        return len(parts), 0, data if spans else b" ".join(parts)
    hashes, starts, ends = wordhash.words(text)
    _, reach, first, last = anchors(hashes, window)
    marks = np.zeros(len(hashes) + 1, int)
    known = np.isin(reach, reaches)
    np.add.at(marks, first[known], 1)
    np.add.at(marks, last[known] + window, -1)
    if len(windows):
        single = np.flatnonzero(np.isin(_windows(hashes, window), windows))
        np.add.at(marks, single, 1)
        np.add.at(marks, single + window, -1)
    keep = np.cumsum(marks)[:-1] <= 0
    removed = int(len(hashes) - keep.sum())
    if not spans:
        return len(hashes), removed, b" ".join([data[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])
    # Each word goes up to the next one; what stands before the first word stays.
    upto = np.r_[starts[1:], len(data)]
    edge = np.flatnonzero(np.diff(np.r_[False, keep, False].astype(np.int8)))
    pieces = [data[: starts[0]]] if len(starts) else []
    return len(hashes), removed, b"".join([*pieces, *(data[starts[a] : upto[b - 1]] for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()))])


def _remove_all(batches: Iterator[pa.RecordBatch], window: int, names: list[str], text_at: int, form: str, added: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, text_at):
        done_at, hit_at = len(names), len(names) + 1
        rows = [_remove(text or "", _list(batch.column(done_at), i), _list(batch.column(hit_at), i), window, form == "spans") for i, text in enumerate(batch.column(text_at).to_pylist())]
        left = [hashlib.sha256(r[2]).hexdigest() if form == "sha256" else r[2].decode("utf-8", "replace") for r in rows]
        # A digest stands for the text, which is then not sent back.
        kept = [at for at in range(len(names)) if form != "sha256" or at != text_at]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(at) for at in kept), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(left, pa.string())],
            names=[*(names[at] for at in kept), *added],
        )


def found_repeats(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """_doc, _done, _hit: the reaches and the single windows of a document that a document with a smaller id has too."""
    held = Scratch(docs.sparkSession, "substring")
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    counts = texts.mapInArrow(lambda b: _count_anchors(b, window), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1")
    counts = held.table(counts, "counts")
    listed = texts.mapInArrow(lambda b: _list_anchors(b, window), f"seed long, reach long, doc_id {kind}")
    shared = held.table(listed.join(counts.hint("merge"), "seed"), "shared")
    firsts = held.table(shared.groupBy("seed", "reach").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("alike")), "firsts")
    judged = shared.join(firsts.hint("merge"), ["seed", "reach"])
    known = F.col("smallest") < F.col("doc_id")
    # The first of several different reaches of an anchor is compared window by window; other reaches are covered by
    # the first of their kind, which has the smaller id.
    open_ = ~known & (F.col("alike") < F.col("n"))
    lists = judged.where(known | open_).groupBy("doc_id").agg(F.collect_set(F.when(known, F.col("reach"))).alias("done"), F.collect_set(F.when(open_, F.col("reach"))).alias("open"))
    lists = held.table(lists, "lists")
    held.drop(counts, shared, firsts)

    opened = texts.join(lists.where(F.size("open") > 0).select("doc_id", "open").hint("merge"), "doc_id")
    windows = held.table(opened.mapInArrow(lambda b: _list_windows(b, window), f"window long, doc_id {kind}"), "windows")
    smallest = held.table(windows.groupBy("window").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest")).where("smallest < largest").drop("largest"), "smallest")
    hits = windows.join(smallest.hint("merge"), "window").where("smallest < doc_id").groupBy("doc_id").agg(F.collect_set("window").alias("hit"))
    found = lists.where(F.size("done") > 0).select("doc_id", "done").join(hits, "doc_id", "full_outer")
    found = held.table(found.select(F.col("doc_id").alias("_doc"), F.col("done").alias("_done"), F.col("hit").alias("_hit")), "found")
    held.drop(windows, smallest, lists)
    return found


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", form: str = "words", prefix: str = "") -> DataFrame:
    """All columns of docs, and n_words, n_removed and what is left of the text.

    form: "words" adds kept_text, the words left, joined by one space; "spans" adds kept_text, the text less the removed
    words and the white space behind each, all else as it was; "sha256" adds kept_sha256, the digest of the words form,
    and leaves the text out. prefix is put before the names of the added columns; columns of docs with such a name, in
    upper or lower case, give way to them.

    A word goes if a window that covers it also starts in a document with a smaller id. A null text has no words; texts
    shorter than a window lose none. A document with a null id is smaller than none and larger than none: it loses
    nothing and takes nothing from others. Rows with equal ids do not take from each other. An empty table gives no
    rows.
    """
    added = [prefix + n for n in ("n_words", "n_removed", "kept_sha256" if form == "sha256" else "kept_text")]
    docs = without(docs, added)
    found = found_repeats(docs, window, id_col, text_col).withColumn("_deal", F.lit(0).cast("long"))
    names, text_at = docs.columns, docs.columns.index(text_col)
    left = docs.select(F.struct("*").alias("_row")).select("_row", F.col("_row")[id_col].alias("_id"), F.col("_row")[text_col].alias("_text"))
    left = left.withColumn("_deal", spread_nulls("_id", "_text")).drop("_text")
    joined = left.join(found.withColumnRenamed("_doc", "_id").hint("merge"), ["_id", "_deal"], "left").select("_row.*", "_done", "_hit")
    joined = joined.toDF(*(f"_{i}" for i in range(len(names) + 2)))  # docs may have columns of such names too
    kept = docs if form != "sha256" else docs.drop(text_col)
    return joined.mapInArrow(lambda b: _remove_all(b, window, names, text_at, form, added), f"{fields(kept)}, `{added[0]}` long, `{added[1]}` long, `{added[2]}` string")


def digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed and kept_sha256 of dedup(); other columns of docs are not read."""
    return dedup(docs.select(id_col, text_col), window, id_col, text_col, form="sha256")
