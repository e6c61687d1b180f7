"""Candidate retrieval: token routes weighted by IDF, exact routes, and their unions.

Everything is keyed by country, so one plan serves all countries. Frequent tokens are dropped before postings are
joined, which bounds the fan-out of a query token. What grows fastest is the number of scored pairs, so no shuffle has
them: references are dealt into blocks, each block is sent the posting list of every token that it asks for once, and
pairs are formed, summed and ranked inside of a block.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.text import tokens
from kinmatch.sources.records import references, targets

FIELDS = ("name", "address")


@dataclass(frozen=True)
class RetrievalConfig:
    max_df: int = 5000
    max_df_ratio: float = 0.05
    top_tokens: int = 5
    top_candidates: int = 50
    joint: bool = False
    exact_name: bool = False
    exact_address: bool = False
    exact_cap: int = 50
    union_baseline: bool = False


#: The named configurations.
CONFIGS = {
    "legacy": RetrievalConfig(),
    "exact_buckets": RetrievalConfig(exact_name=True, exact_address=True),
    "joint_scoring": RetrievalConfig(joint=True, exact_name=True, exact_address=True),
    "df20k": RetrievalConfig(max_df=20_000, joint=True, exact_name=True, exact_address=True),
    "k100": RetrievalConfig(top_candidates=100, joint=True, exact_name=True, exact_address=True),
    "df20k_k100": RetrievalConfig(max_df=20_000, top_candidates=100, joint=True, exact_name=True, exact_address=True),
    "union_baseline": RetrievalConfig(max_df=20_000, top_candidates=100, joint=True, exact_name=True, exact_address=True, union_baseline=True),
}


def record_tokens(records: DataFrame) -> DataFrame:
    """entity_id, source, country, field, token: distinct tokens of the raw texts."""
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f"{f}_raw")).alias("tokens")) for f in FIELDS)))
    return records.select("entity_id", "source", "country", fields.alias("f")).select("entity_id", "source", "country", "f.field", F.explode("f.tokens").alias("token"))


def document_frequency(records: DataFrame) -> DataFrame:
    """country, field, token, df, n: in how many of the country's n targets a field has the token."""
    n = targets(records).groupBy("country").agg(F.count("*").alias("n"))
    df = record_tokens(targets(records)).groupBy("country", "field", "token").agg(F.count("*").alias("df"))
    return df.join(n, "country")


def weights_of(frequencies: DataFrame, config: RetrievalConfig) -> DataFrame:
    cap = F.least(F.lit(config.max_df).cast("double"), F.col("n") * F.lit(config.max_df_ratio))
    return frequencies.where(F.col("df") <= cap).select("country", "field", "token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def idf(records: DataFrame, config: RetrievalConfig) -> DataFrame:
    """country, field, token, df, idf = ln(n / df) of the tokens within the frequency cap."""
    return weights_of(document_frequency(records), config)


def query_tokens(records: DataFrame, weights: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Each reference's rarest tokens a field, ties by token. Inside a country a smaller df is a larger idf, exactly."""
    rank = F.row_number().over(Window.partitionBy("reference_id", "field").orderBy("df", "token"))
    asked = record_tokens(references(records)).withColumnRenamed("entity_id", "reference_id").drop("source")
    return asked.join(weights, ["country", "field", "token"]).withColumn("rank", rank).where(F.col("rank") <= config.top_tokens)


def index(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What retrieval needs of the target side, for runs that ask it more than once: frequencies and postings."""
    return document_frequency(records), record_tokens(targets(records)).select("country", "field", "token", F.col("entity_id").alias("target_id"))


def _digested(records: DataFrame, who: str) -> DataFrame:
    """The id as `who`, country, and a digest of each normalized field, null where that is empty: it stands for the text in
    shuffles and joins."""
    return records.select(F.col("entity_id").alias(who), "country", *(F.when(F.col(f"{f}_norm") != "", F.sha2(f"{f}_norm", 256)).alias(f) for f in FIELDS))


#: References of one name that share a block, at most about so many.
ALIKE = 50
#: Between the ids of a posting list; no id has it.
MARK = "\x01"


def dealt(records: DataFrame) -> tuple[DataFrame, int]:
    """block, reference_id, country, name, address (digests) of the references, and the number of blocks.

    References of one name ask for the same tokens, so they share blocks, but for many of them there are several.
    """
    n = max(64, 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    alike = F.count("*").over(Window.partitionBy("country", "name"))
    part = F.pmod(F.xxhash64("reference_id"), F.floor(alike / ALIKE) + 1)
    refs = _digested(references(records), "reference_id").withColumn("part", part)
    return refs.select(F.pmod(F.xxhash64("country", "name", "part"), F.lit(n)).cast("int").alias("block"), "reference_id", "country", *FIELDS), n


def met(records: DataFrame, config: RetrievalConfig, held: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """block, reference_id, field, target_id, idf: a row for each token that a reference asks for and a target has.

    Rows lie in partition `block`, all of a reference in one. held: the target side's index(), if it is there already.
    """
    frequencies, postings = held or index(records)
    token, (refs, n) = ["country", "field", "token"], dealt(records)
    weights = weights_of(frequencies, config)
    asked = query_tokens(records, weights, config).select("reference_id", *token, "idf").join(refs.select("reference_id", "block"), "reference_id")
    # Only tokens below the cap: no list is longer than it. Sorted ids in one text take a sixth of an array's bytes.
    lists = postings.join(weights.select(*token), token).groupBy(*token).agg(F.array_join(F.sort_array(F.collect_list("target_id")), MARK).alias("ids"))
    wanted = asked.select("block", *token).distinct().join(lists, token)
    # Both sides lie in partition `block`, so the join, the sums and the ranks need no further exchange.
    pairs = asked.repartitionById(n, "block").join(wanted.repartitionById(n, "block").hint("shuffle_hash"), ["block", *token])
    return pairs.select("block", "reference_id", "field", "idf", F.explode(F.split("ids", MARK)).alias("target_id"))


def token_scores(records: DataFrame, config: RetrievalConfig, held: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """block, reference_id, field, target_id, score: the idf that both sides share, rounded so that ties are ties everywhere."""
    return met(records, config, held).groupBy("block", "reference_id", "field", "target_id").agg(F.round(F.sum("idf"), 9).alias("score"))


def top_candidates(scores: DataFrame, k: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("reference_id", *keys).orderBy(F.desc("score"), "target_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def exact_both(records: DataFrame) -> DataFrame:
    """Pairs of one country with equal normalized name and address, neither empty."""
    return _digested(references(records), "reference_id").join(_digested(targets(records), "target_id"), ["country", *FIELDS]).select("reference_id", "target_id")


def exact_first(records: DataFrame, field: str, cap: int) -> DataFrame:
    """reference_id, target_id: of the targets with an equal normalized field the first `cap` by id."""
    keys = ["country", field]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("target_id"))
    first = _digested(targets(records), "target_id").select(*keys, "target_id").where(F.col(field).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= cap)
    return _digested(references(records), "reference_id").select(*keys, "reference_id").join(first, keys).select("reference_id", "target_id")


def routes(records: DataFrame, config: RetrievalConfig, held: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """route, reference_id, target_id, score: the best of each route that takes scores, ranked in one pass over the pairs.

    Routes: joint, or name and address; exact_name and exact_address have the targets with an equal normalized field that
    share a token in the other one.
    """
    exact = [f for f, on in zip(FIELDS, (config.exact_name, config.exact_address)) if on]
    sums = [F.round(F.sum(F.when(F.col("field") == f, F.col("idf"))), 9).alias(f"{f}_score") for f in FIELDS]
    scores = met(records, config, held).groupBy("block", "reference_id", "target_id").agg(*sums)
    if exact:
        refs, n = dealt(records)
        scores = scores.join(refs.select("block", "reference_id", "country", *exact).repartitionById(n, "block").hint("shuffle_hash"), ["block", "reference_id"])
    for f in exact:
        # Each block is sent the members of its references' buckets, once.
        keys = ["country", f]
        members = refs.select("block", *keys).distinct().join(_digested(targets(records), "target_id").select(*keys, "target_id"), keys).withColumn(f"in_{f}", F.lit(True))
        scores = scores.join(members.repartitionById(n, "block").hint("shuffle_hash"), ["block", *keys, "target_id"], "left")
    none = F.lit(0.0)
    found = {"joint": F.round(F.coalesce("name_score", none) + F.coalesce("address_score", none), 9)} if config.joint else {f: F.col(f"{f}_score") for f in FIELDS}
    found |= {f"exact_{f}": F.when(F.col(f"in_{f}"), F.col(f"{FIELDS[1 - FIELDS.index(f)]}_score")) for f in exact}
    each = F.inline(F.array(*(F.struct(F.lit(r).alias("route"), c.alias("score")) for r, c in found.items())))
    rank = F.row_number().over(Window.partitionBy("block", "reference_id", "route").orderBy(F.desc("score"), "target_id"))
    ranked = scores.select("block", "reference_id", "target_id", each).where("score IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= max(config.top_candidates, config.exact_cap if exact else 0))
    limit = F.when(F.col("route").startswith("exact_"), config.exact_cap).otherwise(config.top_candidates)
    return ranked.where(F.col("rank") <= limit).select("route", "reference_id", "target_id", "score")


def capped(records: DataFrame, found: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Completes the exact routes of routes(): targets with an equal normalized field; of more than the cap, those with the
    best score in the other field. Rows of other routes stay.

    Scores are above 0, so a target without one is among the best only if it is among the bucket's first by id: whole
    buckets need not be expanded into pairs.
    """
    for field, on in zip(FIELDS, (config.exact_name, config.exact_address)):
        if on:
            found = found.unionByName(exact_first(records, field, config.exact_cap).select(F.lit(f"exact_{field}").alias("route"), "reference_id", "target_id", F.lit(0.0).alias("score")))
    rank = F.row_number().over(Window.partitionBy("reference_id", "route").orderBy(F.desc("score"), "target_id"))
    # All rows of a reference together: sums and ranks need no further exchange.
    best = found.repartition("reference_id").groupBy("reference_id", "route", "target_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).where(~F.col("route").startswith("exact_") | (F.col("rank") <= config.exact_cap)).select("route", "reference_id", "target_id")


def exact_capped(records: DataFrame, config: RetrievalConfig, field: str, cap: int) -> DataFrame:
    """One exact route by itself, with a cap of its own; see capped()."""
    config = replace(config, exact_name=field == "name", exact_address=field == "address", exact_cap=cap)
    found = routes(records, config).where(F.col("route").startswith("exact_"))
    return capped(records, found, config).select("reference_id", "target_id")


def candidates(records: DataFrame, config: RetrievalConfig, held: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """reference_id, target_id of all routes of the configuration, each pair once; held: see met()."""
    rows = routes(records, config, held)
    others = [exact_both(records)]
    if config.union_baseline:
        others.append(routes(records, CONFIGS["legacy"], held).select("reference_id", "target_id"))
    for r in others:
        rows = rows.unionByName(r.select(F.lit("other").alias("route"), "reference_id", "target_id", F.lit(0.0).alias("score")))
    rows = capped(records, rows, config) if config.exact_name or config.exact_address else rows.repartition("reference_id")
    return rows.select("reference_id", "target_id").distinct()
