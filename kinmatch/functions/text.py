"""Scalar text functions: normalization, tokens, id lists, scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A run of letters and digits of any script; combining marks end a run, as they do in Python's [^\W_].
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
DIGIT_PATTERN = r"\p{Nd}+"
#: The id grammar.
REFERENCE_ID = r"(?U)^S1-[^,\s]+$"
TARGET_ID = r"(?U)^S[23]-[^,\s]+$"


def normalize(text: Column) -> Column:
    """Lower case with sharp s written out, white space runs to one space, ends trimmed; null stays null.

    JVM expressions only. Equal to normalize_exact for texts in NFC whose case folding is lower-casing plus sharp s.
    """
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"(?U)[\s\x{1c}-\x{1f}]+", " "))


def normalize_text(text: str) -> str:
    if not isinstance(text, str):
        raise TypeError("text must be a string")
    return " ".join(unicodedata.normalize("NFC", text).casefold().split())


@F.pandas_udf(StringType())
def normalize_exact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC, full case folding, Unicode white space: for corpora outside the reach of normalize()."""
    for batch in batches:
        yield batch.map(normalize_text, na_action="ignore")


def tokens(text: Column) -> Column:
    """Distinct lower-cased tokens; empty for null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))), F.array().cast("array<string>"))


def digit_tokens(text: Column) -> Column:
    return F.coalesce(F.array_distinct(F.regexp_extract_all(text, F.lit(DIGIT_PATTERN), F.lit(0))), F.array().cast("array<string>"))


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)[^\s\x{1c}-\x{1f}]"), F.lit(True))


def split_ids(text: Column, strip: bool = True) -> Column:
    """A comma list as an array; blank gives an empty one. Duplicates stay; empty members stay, to be reported."""
    parts = F.split(text, ",")
    if strip:
        parts = F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(parts)


def parse_ids(text: Column, pattern: str = TARGET_ID) -> Column:
    """A comma list as an array of distinct valid ids; anything else raises an error when the row is evaluated."""
    ids = split_ids(text)
    bad = F.exists(ids, lambda x: ~x.rlike(pattern))
    twice = F.size(ids) != F.size(F.array_distinct(ids))
    return F.when(text.isNull(), F.raise_error(F.lit("id list is null")).cast("array<string>")).when(bad, F.raise_error(F.concat(F.lit("invalid id in: "), text)).cast("array<string>")).when(
        twice, F.raise_error(F.concat(F.lit("duplicate id in: "), text)).cast("array<string>")
    ).otherwise(ids)


def join_ids(ids: Column) -> Column:
    return F.concat_ws(",", F.sort_array(ids))


def source_of(entity_id: Column) -> Column:
    return F.substring(entity_id, 2, 1).cast("int")


def score(tp: Column, predicted: Column, true: Column) -> Column:
    """F0.5 of one reference's set: 1.25 tp / (predicted + true / 4); 1 if both sets are empty."""
    return F.when((predicted == 0) & (true == 0), 1.0).otherwise(1.25 * tp / (predicted + 0.25 * true))


def score_from_counts(tp: Column, fp: Column, fn: Column) -> Column:
    """The same from error counts."""
    return F.when(tp + fp + fn == 0, 1.0).otherwise(1.25 * tp / (1.25 * tp + fp + 0.25 * fn))


def oracle_score(hits: Column, true: Column) -> Column:
    """What a perfect classifier would reach on the candidates."""
    return F.when(true == 0, 1.0).otherwise(1.25 * hits / (hits + 0.25 * true))


def match_bucket(count: Column) -> Column:
    return F.when(count <= 2, count.cast("string")).when(count <= 4, "3-4").when(count <= 7, "5-7").otherwise("8+")
