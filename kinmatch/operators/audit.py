"""Audits of source and truth tables, and split creation and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.text import is_blank, match_bucket, source_of
from kinmatch.sources.records import references, targets

#: Split names and shares.
PROPORTIONS = {"train": 0.70, "dev": 0.15, "holdout": 0.15}


def file_audit(sources: DataFrame) -> DataFrame:
    """source, country: rows and blank fields."""
    blank = lambda c: F.count_if(is_blank(F.col(c))).alias(f"blank_{c}")
    return sources.groupBy(source_of(F.col("entity_id")).alias("source"), "country").agg(F.count("*").alias("n_rows"), *map(blank, ("entity_id", "business_name", "business_address", "country")))


def match_histogram(truth_lists: DataFrame) -> DataFrame:
    """n_matches and how many references have so many; lists: reference_id, ids (duplicates count once)."""
    return truth_lists.groupBy(F.size(F.array_distinct("ids")).alias("n_matches")).agg(F.count("*").alias("n_references"))


def truth_audit(truth_lists: DataFrame) -> DataFrame:
    """One row: references, links, singletons, lists with duplicates, ids with a wrong prefix, links by source, score of empty predictions."""
    ids = F.col("ids")
    of = lambda s: F.sum(F.size(F.filter(ids, lambda x: x.startswith(s))))
    single = F.count_if(F.size(ids) == 0)
    return truth_lists.agg(
        F.count("*").alias("n_references"), F.sum(F.size(ids)).alias("links"), single.alias("singletons"), F.count_if(F.size(ids) != F.size(F.array_distinct(ids))).alias("lists_with_duplicates"),
        F.sum(F.size(F.filter(ids, lambda x: ~x.rlike("^S[23]-")))).alias("wrong_prefix"), of("S2-").alias("links_s2"), of("S3-").alias("links_s3"), F.round(single / F.count("*"), 9).alias("empty_baseline"),
    )


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def multi_owner_targets(truth: DataFrame) -> DataFrame:
    """Targets that several references claim."""
    return truth.distinct().groupBy("target_id").agg(F.count("*").alias("owners")).where("owners > 1")


def distractors(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Targets that no reference claims."""
    return targets(records).select(F.col("entity_id").alias("target_id"), "country").join(truth, "target_id", "left_anti")


def relationship_audit(records: DataFrame, truth_lists: DataFrame) -> DataFrame:
    """check, n, examples: one row a rule. truth_lists: reference_id, ids. Rules with n > 0 fail, `multi_owner_targets` aside.

    records need entity_id and source only; ids may be repeated, which is one of the rules.
    """
    links = truth_lists.select("reference_id", F.explode("ids").alias("target_id"))
    refs = references(records).select(F.col("entity_id").alias("reference_id"))
    held = targets(records).select(F.col("entity_id").alias("target_id"))
    offenders = {
        "duplicate_truth_references": duplicate_ids(truth_lists, "reference_id").select(F.col("reference_id").alias("id")),
        "duplicate_source_ids": duplicate_ids(records, "entity_id").select(F.col("entity_id").alias("id")),
        "multi_owner_targets": multi_owner_targets(links).select(F.col("target_id").alias("id")),
        "truth_references_missing": truth_lists.join(refs, "reference_id", "left_anti").select(F.col("reference_id").alias("id")).distinct(),
        "references_without_truth": refs.join(truth_lists, "reference_id", "left_anti").select(F.col("reference_id").alias("id")).distinct(),
        "truth_targets_missing": links.join(held, "target_id", "left_anti").select(F.col("target_id").alias("id")).distinct(),
        "lists_with_duplicates": truth_lists.where(F.size("ids") != F.size(F.array_distinct("ids"))).select(F.col("reference_id").alias("id")),
    }
    return checks(offenders)


def checks(offenders: dict[str, DataFrame], examples: int = 5) -> DataFrame:
    """check, n, examples for each table of offending ids (column id); rules without offenders have n = 0.

    The examples are the smallest ids; at most `examples` of each rule leave a task.
    """
    spark = next(iter(offenders.values())).sparkSession
    names = spark.createDataFrame([(n,) for n in offenders], "check string")
    union = None
    for name, rows in offenders.items():
        one = rows.select(F.lit(name).alias("check"), "id")
        union = one if union is None else union.unionByName(one)
    counts = union.groupBy("check").agg(F.count("*").alias("n"))
    few = union.distinct().withColumn("k", F.row_number().over(Window.partitionBy("check").orderBy("id"))).where(F.col("k") <= examples)
    few = few.groupBy("check").agg(F.concat_ws(",", F.sort_array(F.collect_list("id"))).alias("examples"))
    return names.join(counts, "check", "left").join(few, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("examples", F.lit("")).alias("examples"))


def passed(audit: DataFrame) -> bool:
    return audit.where("n > 0 AND check <> 'multi_owner_targets'").isEmpty()


def audit_totals(records: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: distinct true targets, targets, distractors, multi-owner targets."""
    owned = truth.groupBy("target_id").agg(F.countDistinct("reference_id").alias("owners"))
    joined = targets(records).select(F.col("entity_id").alias("target_id")).join(owned, "target_id", "left")
    return joined.agg(F.count("owners").alias("matched_targets"), F.count("*").alias("n_targets"), F.count_if(F.col("owners").isNull()).alias("distractors"), F.count_if(F.col("owners") > 1).alias("multi_owner_targets"))


def reference_split(records: DataFrame, truth: DataFrame, seed: int = 42, proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """reference_id, country, match_count, bucket, split: each stratum (country, bucket) in hash order, cut at floor shares.

    The shuffle is a keyed hash, so a split is a function of ids and seed. Ranks inside a stratum are found in two
    steps, over hash ranges, so a stratum is never sorted in one task.
    """
    if set(proportions) != set(PROPORTIONS) or abs(sum(proportions.values()) - 1) > 1e-12 or min(proportions.values()) < 0:
        raise ValueError("proportions of train, dev and holdout must not be negative and must sum to one")
    counts = truth.groupBy("reference_id").agg(F.count("*").alias("match_count"))
    refs = references(records).select(F.col("entity_id").alias("reference_id"), "country").join(counts, "reference_id", "left")
    refs = refs.withColumn("match_count", F.coalesce("match_count", F.lit(0))).withColumn("bucket", match_bucket(F.col("match_count")))
    refs = refs.withColumn("key", F.sha2(F.concat(F.lit(f"{seed}:"), "reference_id"), 256)).withColumn("part", F.substring("key", 1, 2))
    parts = refs.groupBy("country", "bucket", "part").agg(F.count("*").alias("n_part"))
    whole = Window.partitionBy("country", "bucket")
    parts = parts.withColumn("before", F.sum("n_part").over(whole.orderBy("part")) - F.col("n_part")).withColumn("n", F.sum("n_part").over(whole)).drop("n_part")
    rank = F.row_number().over(Window.partitionBy("country", "bucket", "part").orderBy("key", "reference_id"))
    ranked = refs.withColumn("rank", rank).join(parts, ["country", "bucket", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    a = F.floor(F.col("n") * F.lit(proportions["train"]))
    b = a + F.floor(F.col("n") * F.lit(proportions["dev"]))
    return ranked.select("reference_id", "country", "match_count", "bucket", F.when(F.col("rank") <= a, "train").when(F.col("rank") <= b, "dev").otherwise("holdout").alias("split"))


def target_split(records: DataFrame, truth: DataFrame, split: DataFrame, seed: int = 42, proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """target_id, split, reference_id (null for a distractor), source: targets follow their owner, distractors are drawn by id hash."""
    owner = truth.join(split.select("reference_id", "split"), "reference_id").groupBy("target_id").agg(F.min("reference_id").alias("reference_id"), F.min_by("split", "reference_id").alias("owned"))
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "target_id"), 256), 1, 8), 16, 10).cast("double") / float(16**8)
    drawn = F.when(u < proportions["train"], "train").when(u < proportions["train"] + proportions["dev"], "dev").otherwise("holdout")
    rows = targets(records).select(F.col("entity_id").alias("target_id"), "source").join(owner, "target_id", "left")
    return rows.select("target_id", F.coalesce("owned", drawn).alias("split"), "reference_id", "source")


def verify_split(records: DataFrame, truth: DataFrame, split: DataFrame, assigned: DataFrame, proportions: dict[str, float] = PROPORTIONS) -> DataFrame:
    """check, n, examples: coverage, repeated rows, ownership both ways, metadata, split names and stratification of a manifest."""
    refs, held = references(records), targets(records)
    counts = truth.groupBy("reference_id").agg(F.count("*").alias("true_count"))
    owned = assigned.join(split.select("reference_id", F.col("split").alias("of")), "reference_id", "left")
    meta = split.join(counts, "reference_id", "left").join(refs.select(F.col("entity_id").alias("reference_id"), F.col("country").alias("said")), "reference_id")
    strata = split.groupBy("country", "bucket").agg(F.count("*").alias("n"), *(F.count_if(F.col("split") == s).alias(s) for s in proportions))
    uneven = None
    for s, p in proportions.items():
        far = F.abs(F.col(s) - F.col("n") * p) > F.greatest(F.lit(2.0), 0.02 * F.col("n"))
        uneven = far if uneven is None else uneven | far
    return checks(
        {
            "reference_coverage": refs.select(F.col("entity_id").alias("reference_id")).join(split, "reference_id", "left_anti").select(F.col("reference_id").alias("id")),
            "extra_references": split.join(refs.select(F.col("entity_id").alias("reference_id")), "reference_id", "left_anti").select(F.col("reference_id").alias("id")),
            "target_coverage": held.select(F.col("entity_id").alias("target_id")).join(assigned, "target_id", "left_anti").select(F.col("target_id").alias("id")),
            "extra_targets": assigned.join(held.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti").select(F.col("target_id").alias("id")),
            "repeated_assignments": duplicate_ids(assigned, "target_id").select(F.col("target_id").alias("id")),
            "repeated_references": duplicate_ids(split, "reference_id").select(F.col("reference_id").alias("id")),
            "owner_without_truth": assigned.where("reference_id IS NOT NULL").join(truth, ["target_id", "reference_id"], "left_anti").select(F.col("target_id").alias("id")),
            "target_ownership": owned.where("reference_id IS NOT NULL AND (of IS NULL OR of <> split)").select(F.col("target_id").alias("id")),
            "truth_owner": truth.join(assigned.select("target_id", F.col("reference_id").alias("of")), "target_id").where("of IS NULL OR of <> reference_id").select(F.col("target_id").alias("id")),
            "reference_metadata": meta.where("match_count <> coalesce(true_count, 0) OR country <> said").select(F.col("reference_id").alias("id")),
            "unknown_split": split.select(F.col("reference_id").alias("id"), "split").unionByName(assigned.select(F.col("target_id").alias("id"), "split")).where(~F.col("split").isin(*proportions)).select("id"),
            "stratification": strata.where(uneven).select(F.concat_ws("/", "country", "bucket").alias("id")),
        }
    )


def batches(records: DataFrame, size: int) -> DataFrame:
    """entity_id, country, batch: references of a country numbered in id order, `size` a batch.

    Ranks are found in two steps, over ranges of ids that differ in the last three characters at most, so a country is
    never sorted in one task.
    """
    rows = references(records).select("entity_id", "country").withColumn("range", F.expr("substring(entity_id, 1, greatest(length(entity_id) - 3, 1))"))
    counts = rows.groupBy("country", "range").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("country").orderBy("range")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("country", "range").orderBy("entity_id"))
    ranked = rows.withColumn("rank", rank).join(counts, ["country", "range"])
    return ranked.select("entity_id", "country", F.floor((F.col("before") + F.col("rank") - 1) / size).alias("batch"))


def import_split(records: DataFrame, truth: DataFrame, references_: DataFrame, distractors_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference and target split of earlier assignments (reference_id, split and target_id, split), kept as they are.

    Matched targets follow their owner. The result goes through verify_split(); any finding but uneven strata raises a
    ValueError, so an assignment that is missing, repeated or under an unknown name is never filled in.
    """
    counts = truth.groupBy("reference_id").agg(F.count("*").alias("match_count"))
    refs = references(records).select(F.col("entity_id").alias("reference_id"), "country").join(counts, "reference_id", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    split = references_.select("reference_id", "split").join(refs, "reference_id", "left").withColumn("bucket", match_bucket(F.col("match_count")))
    split = split.select("reference_id", "country", "match_count", "bucket", "split")
    owner = truth.join(split.select("reference_id", "split"), "reference_id").groupBy("target_id").agg(F.min("reference_id").alias("reference_id"), F.min_by("split", "reference_id").alias("owned"))
    held = targets(records).select(F.col("entity_id").alias("target_id"), "source").join(owner, "target_id", "left").join(distractors_.select("target_id", F.col("split").alias("drawn")), "target_id", "left")
    assigned = held.select("target_id", F.coalesce("owned", "drawn").alias("split"), "reference_id", "source").where("split IS NOT NULL")
    found = verify_split(records, truth, split, assigned).where("n > 0 AND check NOT IN ('stratification', 'truth_owner')").collect()
    if found:
        raise ValueError("; ".join(f"{r.check}: {r.examples}" for r in found))
    return split, assigned


def seeded_sample(rows: DataFrame, key: str, size: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """`size` rows without replacement, the first in the order of a keyed hash; ids of `exclude` are left out."""
    if exclude is not None:
        rows = rows.join(exclude.select(key), key, "left_anti")
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256), key).limit(size)
