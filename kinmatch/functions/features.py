"""The 22 similarity features of a (reference, target) pair.

Pairs carry prepared sides: texts are normalized and tokenized once a record, before pairs are formed. Two features need
Ratcliff-Obershelp matching, for which Spark has no expression; they come from a JVM function. All others are built-in
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmatch.functions import sequence
from kinmatch.functions.text import digit_tokens, is_blank, tokens
from kinmatch.sources.records import targets

#: Names and order of the features.
FEATURES = (
    "name_jaccard address_jaccard name_exact address_exact name_missing address_missing name_char address_char "
    "name_containment address_containment number_overlap number_disjoint address_numbers_both address_numbers_one "
    "address_numbers_none address_numbers_equal address_numbers_partial address_numbers_unshared_ref "
    "address_numbers_unshared_target name_jaccard_x_address_missing name_char_x_address_missing name_containment_x_address_missing"
).split()
#: Prefixes of FEATURES that models of each generation use.
GENERATIONS = {"v1": 6, "v2": 12, "v3_numeric": 19, "v3": 22}


#: Columns of a record that its side is made of.
TEXTS = ("name_raw", "address_raw", "name_norm", "address_norm")


def prepared_side() -> Column:
    """One struct a record: normalized texts, token sets, number sets, missing flags."""
    return F.struct(
        F.col("name_norm").alias("name"),
        F.col("address_norm").alias("address"),
        tokens(F.col("name_raw")).alias("name_tokens"),
        tokens(F.col("address_raw")).alias("address_tokens"),
        digit_tokens(F.concat_ws(" ", F.coalesce("name_raw", F.lit("")), F.coalesce("address_raw", F.lit("")))).alias("numbers"),
        digit_tokens(F.col("address_raw")).alias("address_numbers"),
        is_blank(F.col("name_raw")).alias("name_missing"),
        is_blank(F.col("address_raw")).alias("address_missing"),
    )


#: Sets of a side; their arrays have each member once.
SETS = ("name_tokens", "address_tokens", "numbers", "address_numbers")
#: Targets in a block at most; a task holds the prepared sides of one block in memory.
BLOCK = 50_000
#: Least number of blocks of targets, and number of groups of references; their product is the least number of tasks.
LEAST, GROUPS = 8, 4


def with_sides(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs (reference_id, target_id) with columns r, t and shared_*, the number of members that both sides of each of SETS
    have; an id without a record raises an error.

    Pairs are many times more than records and sides are long, so no shuffle has a side for each pair. A place is a group of
    references and a block of targets. A reference goes to the blocks, and a target to the groups, in which it has pairs,
    once each, as texts; there the pairs are formed again and meet the block's targets in a hash table.
    """
    n = max(LEAST, -(-targets(records).count() // BLOCK))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    more = [c for c in pairs.columns if c not in ("reference_id", "target_id")]
    placed = pairs.withColumn("place", part("reference_id", GROUPS) * n + part("target_id", n))
    lists = placed.groupBy("reference_id", "place").agg(F.collect_list(F.struct("target_id", *more)).alias("made"))
    texts = records.select("entity_id", *TEXTS, F.lit(True).alias("known"))
    left = lists.join(texts.withColumnRenamed("entity_id", "reference_id"), "reference_id", "left").repartitionById(GROUPS * n, "place")
    right = placed.select("place", "target_id").distinct().join(texts.withColumnRenamed("entity_id", "target_id"), "target_id").repartitionById(GROUPS * n, "place")
    # Sorted, a reference's side is made before its pairs are, once and not for each of them.
    made = left.select("place", "reference_id", "made", "known", prepared_side().alias("r")).sortWithinPartitions("reference_id")
    made = made.select("place", "reference_id", "known", "r", F.inline("made"))
    held = right.select("place", "target_id", F.col("known").alias("known_target"), prepared_side().alias("t")).hint("shuffle_hash")
    out = made.join(held, ["place", "target_id"], "left")
    absent = F.when(F.col("known").isNull() | F.col("known_target").isNull(), F.raise_error(F.concat(F.lit("no record for pair "), "reference_id", F.lit(" "), "target_id")).cast("boolean")).otherwise(True)
    shared = (F.size(F.array_intersect(F.col("r")[f], F.col("t")[f])).alias(f"shared_{f}") for f in SETS)
    return out.where(absent).select("reference_id", "target_id", *more, "r", "t", *shared)


def _one(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def set_features() -> dict[str, Column]:
    """Features that need no text matching, from the columns of with_sides(). Sets are compared by the sizes of both and of
    what they share: for each pair each set is met once."""
    r, t = F.col("r"), F.col("t")
    out: dict[str, Column] = {}
    for f in ("name", "address"):
        missing = r[f"{f}_missing"] | t[f"{f}_missing"]
        a, b, shared = F.size(r[f"{f}_tokens"]), F.size(t[f"{f}_tokens"]), F.col(f"shared_{f}_tokens")
        union = a + b - shared
        out[f"{f}_missing"] = _one(missing)
        out[f"{f}_jaccard"] = F.when(missing | (union == 0), 0.0).otherwise(shared / union)
        out[f"{f}_exact"] = _one(~missing & (r[f] == t[f]) & (r[f] != ""))
        out[f"{f}_containment"] = _one(~missing & (shared > 0) & (shared == F.least(a, b)))
    overlap = F.col("shared_numbers") > 0
    out["number_overlap"] = _one(overlap)
    out["number_disjoint"] = _one((F.size(r["numbers"]) > 0) & (F.size(t["numbers"]) > 0) & ~overlap)
    n, m, shared = F.size(r["address_numbers"]), F.size(t["address_numbers"]), F.col("shared_address_numbers")
    both = (n > 0) & (m > 0)
    equal = (shared == n) & (shared == m)
    out["address_numbers_both"] = _one(both)
    out["address_numbers_one"] = _one((n > 0) != (m > 0))
    out["address_numbers_none"] = _one((n == 0) & (m == 0))
    out["address_numbers_equal"] = _one(both & equal)
    out["address_numbers_partial"] = _one((shared > 0) & ~equal)
    out["address_numbers_unshared_ref"] = _one(both & (shared < n))
    out["address_numbers_unshared_target"] = _one(both & (shared < m))
    out["name_jaccard_x_address_missing"] = out["name_jaccard"] * out["address_missing"]
    out["name_containment_x_address_missing"] = out["name_containment"] * out["address_missing"]
    return out


def char_features(pairs: DataFrame) -> DataFrame:
    """Adds name_char and address_char to pairs with columns r and t.

    Pairs are compared where they are: a shuffle by their texts would have both sides for each pair.
    """
    for f in ("name", "address"):
        missing = F.col("r")[f"{f}_missing"] | F.col("t")[f"{f}_missing"]
        a, b = (F.when(~missing & (F.col("r")[f] != F.col("t")[f]), F.col(c)[f]) for c in "rt")
        ratio = sequence.ratio(pairs.sparkSession, a, b)
        pairs = pairs.withColumn(f"{f}_char", F.when(missing, 0.0).otherwise(F.coalesce(ratio, F.lit(1.0))))
    return pairs


def features(pairs: DataFrame, records: DataFrame, count: int = 22, keep: tuple[str, ...] = ()) -> DataFrame:
    """reference_id, target_id, the columns of pairs in `keep` and the first `count` features; texts are matched only if one
    of the features asks for it. pairs is read twice."""
    sided = with_sides(pairs.select("reference_id", "target_id", *keep), records)
    names = FEATURES[:count]
    columns = set_features()
    if "name_char" in names:
        sided = char_features(sided)
        columns |= {"name_char": F.col("name_char"), "address_char": F.col("address_char"), "name_char_x_address_missing": F.col("name_char") * columns["address_missing"]}
    return sided.select("reference_id", "target_id", *keep, *(columns[n].alias(n) for n in names))
