"""Exact-match predictions. They take no truth: predictions exist before any label is seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.sources.records import references, targets

#: Rule names and the record columns that must agree.
RULES = {"raw_exact": ("country", "name_raw", "address_raw"), "normalized_exact": ("country_norm", "name_norm", "address_norm")}


def exact_matches(records: DataFrame, rule: str) -> DataFrame:
    """rule, reference_id, target_id of eligible references and targets that agree on all columns of the rule."""
    keys = list(RULES[rule])
    eligible = records.where("eligible = 1")
    left = references(eligible).select(*keys, F.col("entity_id").alias("reference_id"))
    right = targets(eligible).select(*keys, F.col("entity_id").alias("target_id"))
    return left.join(right, keys).select(F.lit(rule).alias("rule"), "reference_id", "target_id")
