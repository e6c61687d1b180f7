"""Sharding by sampled splitters.

Records are ordered by key: the crc32 of the text, so that equal texts lie together, then the id. A sample in which a
record's chance grows with its size gives boundaries that cut the key space into ranges of about equal bytes. Ranges
that turn out overfull - a hot text - are subdivided by a hash of the record, and parts that still are - equal records -
by their numbers. Cumulative bytes over the ranges, then inside
a range, put every record into its shard; groups of equal texts stay together except in subdivided ranges.

The law is `bytes`: shards of near equal size. DataFrame operations only.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import Scratch

SHARDS = 24
#: Ranges a shard, at least; records a range, about; ranges at most; sampled keys a range. The driver holds at most
#: MOST_RANGES * SAMPLES keys of 8 bytes; at 5e10 records a range has 3 million of 24 bytes each.
RANGES, ROWS, MOST_RANGES, SAMPLES = 32, 1_000_000, 16_384, 12
#: A range is overfull beyond so many times its fair share of the bytes.
OVERFULL = 2
#: Bytes that each record counts besides its text.
OVERHEAD = 8


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most key: found in two steps of about the square root of their number each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.array(*(F.lit(c[0]).cast("long") for c in chunks))
    lists = F.array(*(F.array(*(F.lit(b).cast("long") for b in c)) for c in chunks))
    chunk = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(lists, F.greatest(chunk, F.lit(1))), lambda b: b <= key))
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * step + inside)


def _subdivided(rows: DataFrame, keys: list[str], name: str, salt: Column, fair: int) -> DataFrame:
    """Adds column `name`: 0, or 1 + salt in a range beyond OVERFULL times the fair bytes; salt may use `pieces`.

    No more ranges can be overfull than there are fair shares in the total, at most 2 * MOST_RANGES / OVERFULL, which
    bounds the table that is broadcast.
    """
    sums = rows.groupBy(*keys).agg(F.sum("size").alias("whole")).where(F.col("whole") > OVERFULL * fair)
    sums = sums.select(*keys, F.ceil(F.col("whole") / fair).cast("long").alias("pieces"))
    out = rows.join(F.broadcast(sums), keys, "left")
    return out.withColumn(name, F.coalesce(salt + 1, F.lit(0).cast("long"))).drop("pieces")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a record: id_col, size, text_crc32, law, shard (0 to shards - 1), slot (from 0, gapless), grown_shard (null).

    Size is the text's UTF-8 bytes plus 8; a null text counts as empty (crc32 0). Null ids sort first among equal texts.
    Repeated rows are records of their own. An empty table gives no rows. With fewer records than shards some shards
    stay empty.
    """
    held = Scratch(docs.sparkSession, "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = held.table(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")  # texts are read once
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    total = total or 0

    ranges = max(shards * RANGES, min(MOST_RANGES, n // ROWS))
    # A record is drawn with a chance of size * drawn / total, by a hash, so reruns agree.
    chance = F.pmod(F.xxhash64("text_crc32", "doc_id", F.lit("splitters")), F.lit(1 << 53)) / float(1 << 53)
    drawn = rows.where(chance < F.col("size") * (ranges * SAMPLES / max(total, 1)))
    # Equal records are drawn together, so they are counted before they leave their tasks.
    counted = sorted(map(tuple, drawn.groupBy("text_crc32").agg(F.count("*")).collect()))
    upto = list(accumulate(c for _, c in counted))
    bounds = sorted({counted[bisect_right(upto, upto[-1] * k // ranges)][0] for k in range(1, ranges)}) if counted else []

    fair = max(1, total // ranges)
    ranged = rows.withColumn("range", _range_of(F.col("text_crc32"), bounds).cast("int"))
    salted = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("part")), F.col("pieces")).cast("long")
    ranged = _subdivided(ranged, ["range"], "part", salted, fair)
    # Records that one hash keeps together are equal, so it makes no difference which of them goes where.
    ranged = _subdivided(ranged, ["range", "part"], "piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("long"), fair)
    ranged = ranged.withColumn("part", F.col("part") * (1 << 32) + F.col("piece")).drop("piece", "row")
    celled = held.table(ranged.repartition("range", "part"), "cells")

    cells = celled.groupBy("range", "part").agg(F.sum("size").alias("cell_size"))
    # One row a cell: a few thousand at most, at any scale.
    before = F.sum("cell_size").over(Window.orderBy("range", "part")) - F.col("cell_size")
    cells = cells.withColumn("before", before).drop("cell_size")
    in_cell = Window.partitionBy("range", "part").orderBy("text_crc32", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "part", "text_crc32")
    out = celled.withColumn("done", F.sum("size").over(in_cell))
    whole = out.withColumn("first", F.min(F.col("done") - F.col("size")).over(group)).withColumn("last", F.max("done").over(group))
    whole = whole.join(cells, ["range", "part"])
    alone = F.col("part") > 0
    middle = F.col("before") + F.when(alone, F.col("done") - F.col("size") / 2).otherwise((F.col("first") + F.col("last")) / 2)
    at = F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int")
    placed = held.table(whole.select("doc_id", "size", "text_crc32", "range", "part", "done", at.alias("shard")), "placed")

    counts = placed.groupBy("shard", "range", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "range", "part").orderBy("text_crc32", "doc_id", "size")) - 1
    slotted = placed.withColumn("number", number).join(counts, ["shard", "range", "part"])
    return slotted.select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
