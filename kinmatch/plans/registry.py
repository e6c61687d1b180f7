"""Every registered query of the entity-resolution engine, and the DuckDB SQL that says the same.

The corpus is the entity view of the test documents (sources.records). Queries that depend on a trained model, the text
matcher or another random generator have no SQL and are tested on fixtures instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions import features as feat
from kinmatch.functions.text import digit_tokens, join_ids, tokens
from kinmatch.operators import audit, evaluation, exact, model, pairs, policy, retrieval, validation
from kinmatch.operators.retrieval import CONFIGS
from kinmatch.plans import oracle
from kinmatch.sources import records as rec
from kinmatch.sources import files, sinks
from kinmatch.streaming import matcher

PAIR = ["reference_id", "target_id"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Fixed weights that stand in for trained models where a query needs an oracle.
MODEL_A = ({"name_jaccard": 3.0, "address_jaccard": 2.0, "name_exact": 1.5, "address_exact": 1.0}, -2.5)
MODEL_B = ({"name_jaccard": 2.5, "address_jaccard": 2.5, "name_containment": 1.0, "number_overlap": 0.5}, -2.25)
GRID = [round(0.05 * i, 6) for i in range(21)]


def query(sql: str | None = None, *ctes: str):
    """Registers a builder under its name, with its SQL body over the named common table expressions."""

    def register(build):
        _QUERIES[build.__name__] = build
        if sql is not None:
            _SQL[build.__name__] = oracle.statement(sql, *ctes)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.document_records(spark, sf_dir)


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rec.document_truth(spark, sf_dir)


def _truth_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.lists_of(_records(spark, sf_dir), _truth(spark, sf_dir)).select("reference_id", "ids")


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_matches(_records(spark, sf_dir), "normalized_exact").select(*PAIR)


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.candidates(_records(spark, sf_dir), CONFIGS["legacy"])


def _scored(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Legacy candidates with country and two fixed models' probabilities, rounded so thresholds fall alike everywhere, and
    `more` features."""
    r = _records(spark, sf_dir)
    f = feat.with_sides(_legacy(spark, sf_dir), r).select(*PAIR, *(c.alias(n) for n, c in feat.set_features().items()))
    refs = rec.references(r).select(F.col("entity_id").alias("reference_id"), "country")
    pa, pb = (F.round(policy.linear(*m), 9) for m in (MODEL_A, MODEL_B))
    return f.select(*PAIR, pa.alias("pa"), pb.alias("pb"), *(F.round(n, 9).alias(n) for n in more)).join(refs, "reference_id")


#: Spark's setting for shuffle files to be removed at the end of a job.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _kept(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Rows written once, for what reads them more than once. The shuffles that made them go when they are written; else
    they would stay on disk until the driver collects garbage."""
    at, was = sinks.scratch(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.parquet(at)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.parquet(at)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F0.5 of normalized exact matching, by country."""
    return eval_by_country(spark, sf_dir)


# Records and tokens


@query("SELECT entity_id, source, country, name_raw, address_raw, country_norm, name_norm, address_norm, eligible FROM records", "records")
def records_normalized(spark, sf_dir):
    return _records(spark, sf_dir)


@query("SELECT entity_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(name_raw), '[\\p{L}\\p{N}]+'))), ' ') AS tokens FROM records", "records")
def tokens_name(spark, sf_dir):
    return _records(spark, sf_dir).select("entity_id", F.concat_ws(" ", F.sort_array(tokens(F.col("name_raw")))).alias("tokens"))


@query("SELECT entity_id, array_to_string(list_sort(list_distinct(regexp_extract_all(name_raw || ' ' || address_raw, '\\p{Nd}+'))), ' ') AS digits FROM records", "records")
def digit_tokens_all(spark, sf_dir):
    return _records(spark, sf_dir).select("entity_id", F.concat_ws(" ", F.sort_array(digit_tokens(F.concat_ws(" ", "name_raw", "address_raw")))).alias("digits"))


@query("SELECT entity_id, name_norm FROM records ORDER BY entity_id LIMIT 5", "records")
def preview_records(spark, sf_dir):
    return _records(spark, sf_dir).select("entity_id", "name_norm").orderBy("entity_id").limit(5)


@query("SELECT entity_id, name_raw FROM records WHERE source = 1 UNION ALL SELECT entity_id, name_raw FROM records WHERE source = 2 AND entity_id NOT IN (SELECT entity_id FROM records WHERE source = 1)", "records")
def first_table_wins(spark, sf_dir):
    r = _records(spark, sf_dir).select("entity_id", "source", "name_raw")
    return rec.first_wins(r.where("source = 1"), r.where("source IN (1, 2)")).select("entity_id", "name_raw")


# Audits


@query(
    "SELECT source, country, count(*) AS n_rows, count_if(trim(entity_id) = '') AS blank_entity_id, count_if(regexp_matches(name_raw, '^\\s*$')) AS blank_business_name, "
    "count_if(regexp_matches(address_raw, '^\\s*$')) AS blank_business_address, count_if(trim(country) = '') AS blank_country FROM records GROUP BY source, country",
    "records",
)
def file_audit(spark, sf_dir):
    return audit.file_audit(rec.document_sources(spark, sf_dir))


@query("SELECT n_matches, count(*) AS n_references FROM (SELECT r.entity_id, count(t.target_id) AS n_matches FROM records r LEFT JOIN truth t ON t.reference_id = r.entity_id WHERE source = 1 GROUP BY 1) GROUP BY 1", "truth")
def match_histogram(spark, sf_dir):
    return audit.match_histogram(_truth_lists(spark, sf_dir))


def _ends(spark, sf_dir) -> DataFrame:
    """One row: smallest and largest reference, and the smallest target of source 2; faults are made at them."""
    of = lambda f, n: f(F.when(F.col("source") == n, F.col("entity_id")))
    return _records(spark, sf_dir).agg(of(F.min, 1).alias("low"), of(F.max, 1).alias("high"), of(F.min, 2).alias("target"))


def _less(rows: DataFrame, ends: DataFrame, end: str, column: str = "reference_id") -> DataFrame:
    return rows.join(F.broadcast(ends.select(F.col(end).alias(column))), column, "left_anti")


def _faulty_lists(spark, sf_dir) -> DataFrame:
    """Truth lists with faults: see the SQL."""
    ends = _ends(spark, sf_dir)
    made = ends.select(F.col("low").alias("reference_id"), F.array("target", "target").alias("ids")).unionByName(ends.select(F.lit("S1-none").alias("reference_id"), F.array(F.lit("S3-none"), F.lit("X-1"), F.col("target")).alias("ids")))
    return _less(_truth_lists(spark, sf_dir), ends, "high").select("reference_id", "ids").unionByName(made)


def _faulty_records(spark, sf_dir) -> DataFrame:
    return _records(spark, sf_dir).select("entity_id", "source").unionByName(_ends(spark, sf_dir).select(F.col("target").alias("entity_id"), F.lit(2).alias("source")))


@query(
    "SELECT count(*) AS n_references, sum(len(ids))::BIGINT AS links, count_if(len(ids) = 0) AS singletons, count_if(len(ids) <> len(list_distinct(ids))) AS lists_with_duplicates, sum(len(list_filter(ids, lambda x: NOT (starts_with(x, 'S2-') OR starts_with(x, 'S3-')))))::BIGINT AS wrong_prefix, "
    "sum(len(list_filter(ids, lambda x: starts_with(x, 'S2-'))))::BIGINT AS links_s2, sum(len(list_filter(ids, lambda x: starts_with(x, 'S3-'))))::BIGINT AS links_s3, round(count_if(len(ids) = 0) / count(*), 9) AS empty_baseline FROM faulty_lists",
    "faulty_lists",
)
def truth_audit(spark, sf_dir):
    return audit.truth_audit(_faulty_lists(spark, sf_dir))


@query(oracle.RELATIONSHIPS, "faulty_lists", "faulty_links", "faulty_records")
def relationship_audit(spark, sf_dir):
    """Every rule has something to find: the lists and records have faults."""
    return audit.relationship_audit(_faulty_records(spark, sf_dir), _faulty_lists(spark, sf_dir))


@query(
    "SELECT count(o.owners) AS matched_targets, count(*) AS n_targets, count_if(o.owners IS NULL) AS distractors, count_if(o.owners > 1) AS multi_owner_targets FROM records r LEFT JOIN (SELECT target_id, count(DISTINCT reference_id) AS owners FROM truth GROUP BY 1) o ON o.target_id = r.entity_id WHERE source IN (2, 3)",
    "truth",
)
def audit_totals(spark, sf_dir):
    return audit.audit_totals(_records(spark, sf_dir), _truth(spark, sf_dir))


@query("SELECT name_norm, count(*) AS n FROM records GROUP BY 1 HAVING count(*) > 1", "records")
def duplicate_ids(spark, sf_dir):
    """The duplicate rule on a column that has duplicates."""
    return audit.duplicate_ids(_records(spark, sf_dir), "name_norm")


@query("SELECT target_id, count(*) AS owners FROM truth GROUP BY 1 HAVING count(*) > 1", "truth")
def multi_owner_targets(spark, sf_dir):
    return audit.multi_owner_targets(_truth(spark, sf_dir))


@query("SELECT entity_id AS target_id, country FROM records WHERE source IN (2, 3) AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.target_id = entity_id)", "truth")
def distractors(spark, sf_dir):
    return audit.distractors(_records(spark, sf_dir), _truth(spark, sf_dir))


@query("SELECT entity_id AS reference_id FROM records WHERE source = 1 AND NOT EXISTS (SELECT 1 FROM truth t WHERE t.reference_id = entity_id)", "truth")
def missing_truth_refs(spark, sf_dir):
    refs = rec.references(_records(spark, sf_dir)).select(F.col("entity_id").alias("reference_id"))
    return refs.join(_truth(spark, sf_dir), "reference_id", "left_anti")


# Splits, samples and batches


@query("SELECT reference_id, country, match_count, bucket, split FROM split", "split")
def stratified_split(spark, sf_dir):
    return audit.reference_split(_records(spark, sf_dir), _truth(spark, sf_dir))


@query("SELECT country, bucket, split, count(*) AS n FROM split GROUP BY ALL", "split")
def split_strata(spark, sf_dir):
    return stratified_split(spark, sf_dir).groupBy("country", "bucket", "split").agg(F.count("*").alias("n"))


@query("SELECT country, bucket, count_if(split = 'train') AS train, count_if(split = 'dev') AS dev, count_if(split = 'holdout') AS holdout FROM split GROUP BY ALL", "split")
def split_pivot(spark, sf_dir):
    wide = stratified_split(spark, sf_dir).groupBy("country", "bucket").pivot("split", ["train", "dev", "holdout"]).count()
    return wide.na.fill(0)


@query("SELECT target_id, split, reference_id, source FROM target_split", "target_split")
def target_split(spark, sf_dir):
    r, t = _records(spark, sf_dir), _truth(spark, sf_dir)
    return audit.target_split(r, t, audit.reference_split(r, t))


@query(oracle.SPLIT, "faulty_split", "faulty_targets", "records", "truth")
def verify_split(spark, sf_dir):
    """A split with faults: a reference missing, one too many with a target of its own, a wrong count, a repeated target."""
    r, t, ends = _records(spark, sf_dir), _truth(spark, sf_dir), _ends(spark, sf_dir)
    split = audit.reference_split(r, t)
    assigned = audit.target_split(r, t, split)
    wrong = F.broadcast(ends.select(F.col("low").alias("reference_id"), F.lit(1).alias("more")))
    counts = split.join(wrong, "reference_id", "left").withColumn("match_count", F.col("match_count") + F.coalesce("more", F.lit(0))).drop("more")
    faulty = _less(counts, ends, "high").unionByName(ends.select(F.lit("S1-none").alias("reference_id"), F.lit("es").alias("country"), F.lit(0).cast("long").alias("match_count"), F.lit("0").alias("bucket"), F.lit("train").alias("split")))
    twice = assigned.join(F.broadcast(ends.select(F.col("target").alias("target_id"))), "target_id", "left_semi")
    owned = ends.select(F.lit("S3-none").alias("target_id"), F.lit("unknown").alias("split"), F.lit("S1-none").alias("reference_id"), F.lit(3).alias("source"))
    return audit.verify_split(r, t, faulty, assigned.unionByName(twice).unionByName(owned))


@query("SELECT entity_id, country FROM records WHERE source = 1 ORDER BY sha256('2027:' || entity_id), entity_id LIMIT 100", "records")
def seeded_sample(spark, sf_dir):
    return audit.seeded_sample(rec.references(_records(spark, sf_dir)).select("entity_id", "country"), "entity_id", 100, 2027)


@query("SELECT entity_id, country FROM records WHERE source = 1 AND entity_id NOT IN (SELECT entity_id FROM records WHERE source = 1 ORDER BY sha256('2027:' || entity_id), entity_id LIMIT 100) ORDER BY sha256('2029:' || entity_id), entity_id LIMIT 50", "records")
def seeded_sample_apart(spark, sf_dir):
    """A second sample that shares no reference with the first."""
    refs = rec.references(_records(spark, sf_dir)).select("entity_id", "country")
    return audit.seeded_sample(refs, "entity_id", 50, 2029, exclude=seeded_sample(spark, sf_dir))


@query("SELECT entity_id, country, ((row_number() OVER (PARTITION BY country ORDER BY entity_id) - 1) // 50)::BIGINT AS batch FROM records WHERE source = 1", "records")
def reference_batches(spark, sf_dir):
    return audit.batches(_records(spark, sf_dir), 50)


# Exact matching and evaluation


@query("SELECT rule, reference_id, target_id FROM raw_exact", "raw_exact")
def raw_exact(spark, sf_dir):
    return exact.exact_matches(_records(spark, sf_dir), "raw_exact")


@query("SELECT rule, reference_id, target_id FROM normalized_exact", "normalized_exact")
def normalized_exact(spark, sf_dir):
    return exact.exact_matches(_records(spark, sf_dir), "normalized_exact")


@query("SELECT reference_id, target_id FROM normalized_exact ANTI JOIN truth USING (reference_id, target_id)", "normalized_exact", "truth")
def false_positives(spark, sf_dir):
    return evaluation.false_positives(_truth(spark, sf_dir), _exact(spark, sf_dir))


@query("SELECT reference_id, target_id FROM truth ANTI JOIN normalized_exact USING (reference_id, target_id)", "normalized_exact", "truth")
def false_negatives(spark, sf_dir):
    return evaluation.false_negatives(_truth(spark, sf_dir), _exact(spark, sf_dir))


@query(
    "SELECT p.reference_id, r.country, r.name_raw AS reference_name, r.address_raw AS reference_address, p.target_id, t.name_raw AS target_name, t.address_raw AS target_address FROM normalized_exact p "
    "ANTI JOIN truth USING (reference_id, target_id) JOIN records r ON r.entity_id = p.reference_id JOIN records t ON t.entity_id = p.target_id ORDER BY p.reference_id, p.target_id LIMIT 10",
    "normalized_exact",
    "truth",
)
def error_examples(spark, sf_dir):
    return evaluation.error_examples(_records(spark, sf_dir), false_positives(spark, sf_dir))


def _evaluation(spark, sf_dir):
    return evaluation.by_reference(_records(spark, sf_dir), _truth(spark, sf_dir), _exact(spark, sf_dir))


@query("SELECT reference_id, country, true_count, predicted_count, tp, fp, fn, score FROM evaluation", "evaluation")
def eval_by_reference(spark, sf_dir):
    return _evaluation(spark, sf_dir)


@query(f"SELECT {oracle.SUMMARY} FROM evaluation", "evaluation")
def eval_summary(spark, sf_dir):
    return evaluation.summary(_evaluation(spark, sf_dir))


@query(f"SELECT country, {oracle.SUMMARY} FROM evaluation GROUP BY country", "evaluation")
def eval_by_country(spark, sf_dir):
    return evaluation.summary(_evaluation(spark, sf_dir), "country")


@query(
    "SELECT substr(target_id, 1, 2) AS source, count_if(p AND t) AS tp, count_if(t IS NULL) AS fp, count_if(p IS NULL) AS fn FROM (SELECT reference_id, target_id, true AS p FROM normalized_exact) FULL JOIN (SELECT *, true AS t FROM truth) USING (reference_id, target_id) GROUP BY 1",
    "normalized_exact",
    "truth",
)
def eval_by_source(spark, sf_dir):
    return evaluation.by_source(_truth(spark, sf_dir), _exact(spark, sf_dir))


@query(
    "SELECT r.country, count(*) AS true_links, count_if(c.target_id IS NULL) AS retrieval_fn, count_if(c.target_id IS NOT NULL AND p.target_id IS NULL) AS classifier_fn FROM truth t JOIN records r ON r.entity_id = t.reference_id "
    "LEFT JOIN candidates_legacy c USING (reference_id, target_id) LEFT JOIN normalized_exact p USING (reference_id, target_id) GROUP BY 1",
    "candidates_legacy",
    "normalized_exact",
    "truth",
)
def error_attribution(spark, sf_dir):
    return evaluation.error_attribution(_records(spark, sf_dir), _truth(spark, sf_dir), _legacy(spark, sf_dir), _exact(spark, sf_dir), "country")


@query("SELECT round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 1.25 * tp / (1.25 * tp + fp + 0.25 * fn) END, 9) AS pooled_f05 FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM evaluation)", "evaluation")
def pooled_f05(spark, sf_dir):
    return _evaluation(spark, sf_dir).agg(F.round(evaluation.pooled_f05(F.sum("tp"), F.sum("fp"), F.sum("fn")), 9).alias("pooled_f05"))


# Retrieval


@query("SELECT country, field, token, df, n FROM frequency", "frequency")
def document_frequency(spark, sf_dir):
    return retrieval.document_frequency(_records(spark, sf_dir))


@query("SELECT country, field, token, df, round(idf, 9) AS idf FROM idf5000", "idf5000")
def idf(spark, sf_dir):
    return retrieval.idf(_records(spark, sf_dir), CONFIGS["legacy"]).withColumn("idf", F.round("idf", 9))


@query("SELECT reference_id, field, token, rank FROM asked5000", "asked5000")
def query_tokens_top5(spark, sf_dir):
    r = _records(spark, sf_dir)
    return retrieval.query_tokens(r, retrieval.idf(r, CONFIGS["legacy"]), CONFIGS["legacy"]).select("reference_id", "field", "token", "rank")


def _route(spark, sf_dir, field):
    return retrieval.top_candidates(retrieval.token_scores(_records(spark, sf_dir), CONFIGS["legacy"]).where(F.col("field") == field), 50, "block").select(*PAIR, "score", "rank")


@query("SELECT reference_id, target_id, score, rank FROM ranked5000 WHERE field = 'name' AND rank <= 50", "ranked5000")
def candidates_name(spark, sf_dir):
    return _route(spark, sf_dir, "name")


@query("SELECT reference_id, target_id, score, rank FROM ranked5000 WHERE field = 'address' AND rank <= 50", "ranked5000")
def candidates_address(spark, sf_dir):
    return _route(spark, sf_dir, "address")


@query("SELECT reference_id, target_id FROM exact_both", "exact_both")
def candidates_exact_both(spark, sf_dir):
    return retrieval.exact_both(_records(spark, sf_dir))


@query("SELECT reference_id, target_id FROM candidates_legacy", "candidates_legacy")
def candidates_legacy(spark, sf_dir):
    return _legacy(spark, sf_dir)


@query("SELECT reference_id, target_id FROM joint5000 WHERE rank <= 50 UNION SELECT reference_id, target_id FROM exact_both", "joint5000", "exact_both")
def candidates_joint(spark, sf_dir):
    return retrieval.candidates(_records(spark, sf_dir), replace(CONFIGS["legacy"], joint=True))


#: A cap of exact routes that buckets of test tables exceed; the named configurations have 50.
CAP = 10


@query("SELECT reference_id, target_id FROM capped_name_5000_10", "capped_name_5000_10")
def candidates_exact_name_capped(spark, sf_dir):
    return retrieval.exact_capped(_records(spark, sf_dir), CONFIGS["legacy"], "name", CAP)


@query("SELECT reference_id, target_id FROM capped_address_5000_10", "capped_address_5000_10")
def candidates_exact_address_capped(spark, sf_dir):
    return retrieval.exact_capped(_records(spark, sf_dir), CONFIGS["legacy"], "address", CAP)


def _config_query(name: str, df: int, k: int, joint: bool = True, base: bool = False):
    """A named configuration as it stands."""

    def build(spark, sf_dir):
        return retrieval.candidates(_records(spark, sf_dir), CONFIGS[name])

    build.__name__ = f"candidates_{name}"
    ctes = [f"{'joint' if joint else 'ranked'}{df}", "exact_both", f"capped_name_{df}_50", f"capped_address_{df}_50", *(["ranked5000"] if base else [])]
    sql = f"SELECT reference_id, target_id FROM {ctes[0]} WHERE rank <= {k} " + " ".join(f"UNION SELECT reference_id, target_id FROM {c}" for c in ctes[1:4])
    if base:
        sql += " UNION SELECT reference_id, target_id FROM ranked5000 WHERE rank <= 50"
    return query(sql, *ctes)(build)


candidates_exact_buckets = _config_query("exact_buckets", 5000, 50, joint=False)
candidates_joint_scoring = _config_query("joint_scoring", 5000, 50)
candidates_df20k = _config_query("df20k", 20000, 50)
candidates_k100 = _config_query("k100", 5000, 100)
candidates_df20k_k100 = _config_query("df20k_k100", 20000, 100)
candidates_union_baseline = _config_query("union_baseline", 20000, 100, base=True)


@query("SELECT reference_id, target_id FROM joint5 WHERE rank <= 50 UNION SELECT reference_id, target_id FROM exact_both", "joint5", "exact_both")
def candidates_max_df(spark, sf_dir):
    """The frequency cap at a value that test tables reach: no token of theirs is in 5,000 targets."""
    return retrieval.candidates(_records(spark, sf_dir), replace(CONFIGS["legacy"], joint=True, max_df=5))


def _quality(k):
    def build(spark, sf_dir):
        r = _records(spark, sf_dir)
        return evaluation.retrieval_quality(r, _truth(spark, sf_dir), retrieval.candidates(r, replace(CONFIGS["legacy"], top_candidates=k)))

    build.__name__ = f"retrieval_quality_k{k}"
    return query(oracle.quality(k), "ranked5000", "exact_both", "truth")(build)


retrieval_quality_k10, retrieval_quality_k50, retrieval_quality_k100 = map(_quality, (10, 50, 100))


@query(
    "SELECT r.country, round(avg(CASE WHEN g = 0 THEN 1.0 ELSE 1.25 * h / (h + 0.25 * g) END), 9) AS oracle_macro_f05 FROM (SELECT r.entity_id, r.country, count(t.target_id) AS g, count(c.target_id) AS h FROM records r LEFT JOIN truth t ON t.reference_id = r.entity_id "
    "LEFT JOIN candidates_legacy c ON c.reference_id = t.reference_id AND c.target_id = t.target_id WHERE r.source = 1 GROUP BY 1, 2) r GROUP BY 1",
    "candidates_legacy",
    "truth",
)
def candidate_oracle(spark, sf_dir):
    per = evaluation.by_reference(_records(spark, sf_dir), _truth(spark, sf_dir), _legacy(spark, sf_dir))
    return evaluation.summary(per, "country").select("country", F.col("candidate_oracle_macro_f05").alias("oracle_macro_f05"))


# Features


def _features(spark, sf_dir, *names):
    sided = feat.with_sides(_legacy(spark, sf_dir), _records(spark, sf_dir))
    columns = feat.set_features()
    return sided.select(*PAIR, *(F.round(columns[n], 9).alias(n) for n in names))


def _feature_query(name: str, *names: str):
    def build(spark, sf_dir):
        return _features(spark, sf_dir, *names)

    build.__name__ = name
    return query(f"SELECT reference_id, target_id, {', '.join(f'round({n}, 9) AS {n}' for n in names)} FROM features", "features")(build)


features_token = _feature_query("features_token", "name_jaccard", "address_jaccard", "name_containment", "address_containment")
features_number = _feature_query("features_number", *[n for n in feat.FEATURES if "number" in n])
features_exact_missing = _feature_query("features_exact_missing", "name_exact", "address_exact", "name_missing", "address_missing")
features_interaction = _feature_query("features_interaction", "name_jaccard_x_address_missing", "name_containment_x_address_missing")


@query()
def features_sequence(spark, sf_dir):
    return feat.char_features(feat.with_sides(_kept(spark, _legacy(spark, sf_dir), "legacy"), _records(spark, sf_dir))).select(*PAIR, "name_char", "address_char")


@query()
def features_all22(spark, sf_dir):
    return feat.features(_kept(spark, _legacy(spark, sf_dir), "legacy"), _records(spark, sf_dir))


# Pairs and policies


@query("SELECT c.reference_id, c.target_id, (t.target_id IS NOT NULL)::INT AS y FROM candidates_legacy c LEFT JOIN truth t USING (reference_id, target_id)", "candidates_legacy", "truth")
def pairs_labeled(spark, sf_dir):
    return pairs.labelled(_legacy(spark, sf_dir), _truth(spark, sf_dir))


@query("SELECT c.reference_id, c.target_id, r.name_raw AS reference_name, t.name_raw AS target_name FROM candidates_legacy c JOIN records r ON r.entity_id = reference_id JOIN records t ON t.entity_id = target_id", "candidates_legacy")
def pairs_text(spark, sf_dir):
    return pairs.with_text(_legacy(spark, sf_dir), _records(spark, sf_dir)).select(*PAIR, F.col("reference.name_raw").alias("reference_name"), F.col("target.name_raw").alias("target_name"))


@query("SELECT c.reference_id, c.target_id, (x.target_id IS NOT NULL)::INT AS hit FROM candidates_legacy c LEFT JOIN normalized_exact x USING (reference_id, target_id)", "candidates_legacy", "normalized_exact")
def cache_hits(spark, sf_dir):
    return pairs.cached(_legacy(spark, sf_dir), _exact(spark, sf_dir).withColumn("p", F.lit(1.0)), "p").drop("p")


@query("SELECT reference_id, n, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM (SELECT entity_id AS reference_id, count(c.target_id) AS n, sum(count(c.target_id)) OVER (ORDER BY entity_id) AS stop FROM records LEFT JOIN candidates_legacy c ON c.reference_id = entity_id WHERE source = 1 GROUP BY entity_id)", "candidates_legacy")
def csr_offsets(spark, sf_dir):
    return pairs.offsets(_records(spark, sf_dir), _legacy(spark, sf_dir))


@query("SELECT reference_id, target_id FROM scored WHERE pa >= 0.362", "scored")
def linear_score_policy(spark, sf_dir):
    return policy.thresholded(_scored(spark, sf_dir), 0.362, "pa")


@query("SELECT reference_id, target_id FROM scored WHERE CASE WHEN country = 'fr' THEN pb >= 0.665 ELSE (pa + pb) / 2 >= 0.6 END", "scored")
def blend_policy(spark, sf_dir):
    return policy.final_policy(_scored(spark, sf_dir), "fr")


@query("SELECT reference_id, target_id FROM scored WHERE CASE WHEN country = 'es' THEN pa >= 0.362 ELSE pb >= 0.665 END", "scored")
def hybrid_policy(spark, sf_dir):
    return policy.hybrid_policy(_scored(spark, sf_dir), "es")


@query("SELECT x.reference_id, x.target_id FROM raw_exact x JOIN records ON entity_id = reference_id WHERE country = 'es' UNION ALL SELECT x.reference_id, x.target_id FROM normalized_exact x JOIN records ON entity_id = reference_id WHERE country <> 'es'", "raw_exact", "normalized_exact")
def hybrid_sets(spark, sf_dir):
    return pairs.hybrid(_records(spark, sf_dir), {"es": "raw"}, "norm", raw=raw_exact(spark, sf_dir), norm=normalized_exact(spark, sf_dir))


@query(oracle.sweep("pa", GRID), "scored", "truth")
def threshold_sweep(spark, sf_dir):
    return policy.sweep(_records(spark, sf_dir), _truth(spark, sf_dir), _scored(spark, sf_dir), GRID, "pa")


@query(f"SELECT * FROM ({oracle.sweep('pa', GRID)}) ORDER BY macro_f05 DESC, threshold LIMIT 1", "scored", "truth")
def tuned_threshold(spark, sf_dir):
    return policy.pick(threshold_sweep(spark, sf_dir))


@query(oracle.blend_grid([0.0, 0.5, 1.0], GRID), "scored", "truth")
def blend_grid(spark, sf_dir):
    return policy.blend_grid(_records(spark, sf_dir), _truth(spark, sf_dir), _kept(spark, _scored(spark, sf_dir), "scored"), [0.0, 0.5, 1.0], GRID)


@query(oracle.country_grid(GRID), "scored", "truth")
def country_grid(spark, sf_dir):
    return policy.country_grid(_records(spark, sf_dir), _truth(spark, sf_dir), _kept(spark, _scored(spark, sf_dir), "scored"), GRID)


#: Labelled pairs that a model is fitted on, the first in hash order, at most; all candidates are scored.
FITTED = 20_000


def _model_pairs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All legacy candidates with the 22 features, label and split, and the bounded sample of the train part for fitting."""
    r, t = _records(spark, sf_dir), _truth(spark, sf_dir)
    # Labels and split meet the ids; features come after, so no join has them.
    marked = pairs.labelled(_kept(spark, _legacy(spark, sf_dir), "legacy"), t).join(audit.reference_split(r, t).select("reference_id", "split"), "reference_id")
    rows = _kept(spark, feat.features(_kept(spark, marked, "marked"), r, keep=("y", "split")), "model")
    # Written, as the fit reads it in each round.
    return rows, _kept(spark, rows.where("split = 'train'").orderBy(F.xxhash64(*PAIR), *PAIR).limit(FITTED), "fitted")


@query()
def lr_scores(spark, sf_dir):
    """Every candidate's probability, with the split that says whether its reference was held out of the fit."""
    rows, train = _model_pairs(spark, sf_dir)
    return model.probabilities(model.logistic(train), rows).select(*PAIR, "split", "y", "p")


@query()
def gbt_scores(spark, sf_dir):
    rows, train = _model_pairs(spark, sf_dir)
    return model.probabilities(model.boosted(train), rows).select(*PAIR, "split", "y", "p")


# Comparisons and fingerprints


def _two_evaluations(spark, sf_dir):
    r, t = _records(spark, sf_dir), _truth(spark, sf_dir)
    return tuple(evaluation.by_reference(r, t, exact.exact_matches(r, rule)) for rule in ("normalized_exact", "raw_exact"))


@query(
    "SELECT a.country, count(*) AS \"references\", round(avg(a.score - b.score), 9) AS mean_delta, count_if(a.score - b.score > 1e-5) AS wins, count_if(a.score - b.score < -1e-5) AS losses, count_if(abs(a.score - b.score) <= 1e-5) AS ties FROM evaluation a JOIN raw_evaluation b USING (reference_id) GROUP BY 1",
    "evaluation",
    "raw_evaluation",
)
def paired_comparison(spark, sf_dir):
    return evaluation.paired_comparison(*_two_evaluations(spark, sf_dir), "country")


@query()
def bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap_interval(*_two_evaluations(spark, sf_dir))


@query("SELECT country, count(*) AS \"references\", count_if(a <> b) AS changed FROM (SELECT entity_id, country, coalesce(x.ids, '') AS a, coalesce(y.ids, '') AS b FROM records LEFT JOIN (SELECT reference_id, string_agg(target_id, ',' ORDER BY target_id) AS ids FROM raw_exact GROUP BY 1) x ON x.reference_id = entity_id LEFT JOIN (SELECT reference_id, string_agg(target_id, ',' ORDER BY target_id) AS ids FROM normalized_exact GROUP BY 1) y ON y.reference_id = entity_id WHERE source = 1) GROUP BY 1", "raw_exact", "normalized_exact")
def change_counts(spark, sf_dir):
    r = _records(spark, sf_dir)
    return evaluation.change_counts(*(evaluation.lists_of(r, exact.exact_matches(r, rule)) for rule in ("raw_exact", "normalized_exact")))


@query("SELECT count(*) AS n, bit_xor(('0x' || substr(sha256(reference_id || '|' || ids), 1, 15))::BIGINT) AS digest FROM matching", "matching")
def prediction_fingerprint(spark, sf_dir):
    return evaluation.fingerprint(evaluation.lists_of(_records(spark, sf_dir), _exact(spark, sf_dir)))


@query(
    "WITH h AS (SELECT sha256(reference_id || chr(9) || target_id) AS h FROM normalized_exact), a AS (SELECT substr(h, 1, 6) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM h GROUP BY 1), "
    "b AS (SELECT substr(part, 1, 3) AS part, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM a GROUP BY 1) SELECT sha256(string_agg(h, chr(10) ORDER BY h)) AS sha256 FROM b",
    "normalized_exact",
)
def ordered_fingerprint(spark, sf_dir):
    return evaluation.ordered_fingerprint(_exact(spark, sf_dir), *PAIR)


# Outputs and their checks


@query("SELECT reference_id AS source1_entity_id, ids AS matched_entity_ids FROM matching", "matching")
def matching_results(spark, sf_dir):
    return sinks.list_rows(_records(spark, sf_dir), _exact(spark, sf_dir))


@query("SELECT entity_id AS source1_entity_id, coalesce(string_agg(c.target_id, ',' ORDER BY c.target_id), '') AS candidate_entity_ids FROM records LEFT JOIN candidates_legacy c ON c.reference_id = entity_id WHERE source = 1 GROUP BY 1", "candidates_legacy")
def candidate_pairs(spark, sf_dir):
    return sinks.list_rows(_records(spark, sf_dir), _legacy(spark, sf_dir), "candidate_entity_ids")


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", *rows.columns).alias("value"))


@query(oracle.SUBMISSION, "match_lines", "candidate_lines", "ends")
def submission_checks(spark, sf_dir):
    """The validator on files of all references with every fault that it knows: see the SQL's match_lines and candidate_lines."""
    r, ends = _records(spark, sf_dir), _ends(spark, sf_dir)
    matches = _lines(_less(sinks.list_rows(r, _truth(spark, sf_dir)), ends, "high", "source1_entity_id"))
    bad = ends.select(F.explode(F.array(F.concat("low", F.lit("\tX-1,S1-00000001,S2-none,S2-none")), F.lit("S1-none\t"), F.lit("no tab here"))).alias("value"))
    proposed = _lines(_less(sinks.list_rows(r, _legacy(spark, sf_dir), "candidate_entity_ids"), ends, "low", "source1_entity_id"))
    refs, known = rec.references(r).select(F.col("entity_id").alias("reference_id")), rec.targets(r).select(F.col("entity_id").alias("target_id"))
    return validation.submission(matches.unionByName(bad), refs, known, proposed.unionByName(ends.select(F.col("low").alias("value"))))


@query(oracle.COVERAGE, "faulty_lists", "candidate_lines")
def coverage_checks(spark, sf_dir):
    """Faulty lists against candidates that lack a reference."""
    r = _records(spark, sf_dir)
    proposed = _less(evaluation.lists_of(r, _legacy(spark, sf_dir)).select("reference_id", "ids"), _ends(spark, sf_dir), "low")
    return validation.coverage(rec.references(r).select(F.col("entity_id").alias("reference_id")), _faulty_lists(spark, sf_dir), proposed)


@query("SELECT name AS \"check\", CASE WHEN name = 'policy_mapping' THEN (SELECT count(*) FROM records a WHERE source = 1 AND country = 'es' AND EXISTS (SELECT 1 FROM normalized_exact n WHERE n.reference_id = a.entity_id AND NOT EXISTS (SELECT 1 FROM raw_exact x WHERE x.reference_id = n.reference_id AND x.target_id = n.target_id))) ELSE 0 END AS n, CASE WHEN name = 'policy_mapping' THEN coalesce((SELECT string_agg(reference_id, ',' ORDER BY reference_id) FROM (SELECT DISTINCT n.reference_id FROM normalized_exact n JOIN records a ON a.entity_id = n.reference_id WHERE a.country = 'es' AND NOT EXISTS (SELECT 1 FROM raw_exact x WHERE x.reference_id = n.reference_id AND x.target_id = n.target_id) ORDER BY 1 LIMIT 5)), '') ELSE '' END AS examples FROM (VALUES ('matches_missing'), ('candidates_missing'), ('not_expected'), ('duplicate_match_rows'), ('duplicate_candidate_rows'), ('match_not_in_candidates'), ('unknown_targets'), ('policy_mapping')) v(name)", "records", "raw_exact", "normalized_exact")
def hybrid_checks(spark, sf_dir):
    """The whole hybrid audit, on an output that takes the normalized rule everywhere though the policy says raw for one country."""
    r = _records(spark, sf_dir)
    raw, norm = (evaluation.lists_of(r, exact.exact_matches(r, rule)).select("reference_id", "ids") for rule in ("raw_exact", "normalized_exact"))
    return validation.hybrid_audit(r, {"es": "raw"}, "norm", norm, norm, raw=raw, norm=norm)


@query("SELECT coalesce(a.reference_id, b.reference_id) AS reference_id FROM (SELECT reference_id, list_sort(list(target_id)) AS ids FROM raw_exact GROUP BY 1) a FULL JOIN (SELECT reference_id, list_sort(list(target_id)) AS ids FROM normalized_exact GROUP BY 1) b USING (reference_id) WHERE a.ids IS DISTINCT FROM b.ids", "raw_exact", "normalized_exact")
def candidate_identity(spark, sf_dir):
    r = _records(spark, sf_dir)
    a, b = (evaluation.lists_of(r, exact.exact_matches(r, rule)).where(F.size("ids") > 0) for rule in ("raw_exact", "normalized_exact"))
    return validation.same_candidates(a, b)


@query(oracle.PACKET, "pair_ends", "true_pairs")
def packet_checks(spark, sf_dir):
    """Labelled pairs with a fault of each kind."""
    r, t = _records(spark, sf_dir), _truth(spark, sf_dir)
    names = list(feat.set_features())
    rows = pairs.labelled(feat.with_sides(_legacy(spark, sf_dir), r).select(*PAIR, *(c.alias(n) for n, c in feat.set_features().items())), t)
    rows = rows.withColumn("id", F.concat_ws("|", *PAIR))
    ends = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"))
    hidden = rows.join(F.broadcast(ends)).where("y = 1 AND id > low").agg(F.min("id").alias("hidden"))
    rows = rows.join(F.broadcast(ends.join(hidden)))
    rows = rows.withColumn("y", F.when(F.col("id") == F.col("low"), 2).when(F.col("id") == F.col("hidden"), 0).otherwise(F.col("y")))
    rows = rows.withColumn(names[0], F.when(F.col("id") == F.col("high"), float("nan")).otherwise(F.col(names[0])))
    rows = rows.withColumn("times", F.explode(F.when(F.col("id") == F.col("high"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return validation.packet(rows.select(*PAIR, *names, "y"), t, names=names)


@query("SELECT reference_id, target_id FROM candidates_legacy", "candidates_legacy")
def stream_matches(spark, sf_dir):
    """The streaming matcher over the same references gives the batch result."""
    at = sinks.scratch(spark, "stream")
    r = _records(spark, sf_dir)
    rec.references(r).write.parquet(f"{at}/in")
    config = CONFIGS["legacy"]
    matcher.match_stream(spark, f"{at}/in", r, f"{at}/out", config, matcher.run_identity(config, r, source=sf_dir), files_per_batch=4).awaitTermination()
    return matcher.matched(spark, f"{at}/out")


@query("SELECT reference_id, array_to_string(list_sort(list(target_id)), ',') AS ids FROM truth GROUP BY 1", "truth")
def truth_lists(spark, sf_dir):
    return _truth(spark, sf_dir).groupBy("reference_id").agg(join_ids(F.collect_list("target_id")).alias("ids"))


# Files: each query writes to a scratch folder and returns what is read back


@query("SELECT entity_id, name_raw AS business_name, address_raw AS business_address, country FROM raw_records", "raw_records")
def tsv_source(spark, sf_dir):
    at = sinks.scratch(spark, "tsv")
    rec.document_sources(spark, sf_dir).write.csv(at, sep="\t", header=True, quote='"', escape='"', emptyValue="")
    return files.read_tsv(spark, at)


@query("SELECT country, count(*) AS n_rows, sum(length(name_raw))::BIGINT AS name_characters FROM raw_records GROUP BY 1", "raw_records")
def tsv_gzip_source(spark, sf_dir):
    at = sinks.scratch(spark, "gzip")
    rec.document_sources(spark, sf_dir).write.option("compression", "gzip").csv(at, sep="\t", header=True, quote='"', escape='"', emptyValue="")
    return files.read_tsv(spark, at).groupBy("country").agg(F.count("*").alias("n_rows"), F.sum(F.length("business_name")).alias("name_characters"))


def _truth_file(spark, sf_dir) -> str:
    at = sinks.scratch(spark, "lists")
    sinks.write_lists(_records(spark, sf_dir), _truth(spark, sf_dir), at, files=1)
    return at


@query("SELECT reference_id, array_to_string(ids, ',') AS ids, len(ids) AS n FROM clean_lists", "clean_lists")
def truth_source(spark, sf_dir):
    """Lists written, read strictly and parsed."""
    return files.read_truth(spark, _truth_file(spark, sf_dir)).select("reference_id", F.concat_ws(",", "ids").alias("ids"), F.size("ids").cast("long").alias("n"))


@query("SELECT reference_id, array_to_string(ids, ',') AS ids FROM clean_lists WHERE reference_id IN (SELECT reference_id FROM normalized_exact)", "clean_lists", "normalized_exact")
def raw_truth_wanted(spark, sf_dir):
    return files.read_raw_truth(spark, _truth_file(spark, sf_dir), _exact(spark, sf_dir), strict=False).select("reference_id", F.concat_ws(",", "ids").alias("ids"))


@query("SELECT entity_id AS id, (SELECT count(*) FROM records WHERE source = 1) AS n_rows FROM records WHERE source = 1", "records")
def file_ids(spark, sf_dir):
    at = _truth_file(spark, sf_dir)
    return files.read_ids(spark, at).withColumn("n_rows", F.lit(files.count_rows(spark, at)).cast("long"))


@query("SELECT reference_id, unnest(string_split(ids, ',')) AS target_id FROM matching WHERE ids <> ''", "matching")
def prediction_lines(spark, sf_dir):
    """Predictions as JSON lines, read back and flattened."""
    at = sinks.scratch(spark, "predictions")
    sinks.write_predictions(evaluation.lists_of(_records(spark, sf_dir), _exact(spark, sf_dir)), at)
    return files.read_jsonl(spark, at, "reference_id string, predicted_ids array<string>").select("reference_id", F.explode("predicted_ids").alias("target_id"))


@query("SELECT DISTINCT country AS value FROM records", "records")
def json_array_source(spark, sf_dir):
    at = sinks.scratch(spark, "countries")
    whole = _records(spark, sf_dir).select("country").distinct().agg(F.to_json(F.collect_set("country")).alias("value"))
    whole.coalesce(1).write.text(at)
    return files.read_json_array(spark, at)


@query("SELECT entity_id, country, name_norm FROM records WHERE entity_id IN (SELECT target_id FROM truth)", "truth")
def record_store(spark, sf_dir):
    """The store of the targets that have an owner; the second call finds it made of the same inputs."""
    at, r = f"{sinks.scratch(spark, 'store')}/records", _records(spark, sf_dir)
    keep = _truth(spark, sf_dir).select(F.col("target_id").alias("entity_id")).distinct()
    identity = {"records": sinks.content_digest(r)}
    if not sinks.ingest(r, at, keep, identity) or sinks.ingest(r, at, keep, identity):
        raise AssertionError("the second call must use the store of the first")
    return spark.read.parquet(at).select("entity_id", "country", "name_norm")


@query("SELECT reference_id AS source1_entity_id, ids FROM matching", "matching")
def assembled_batches(spark, sf_dir):
    """References in three batches by a hash, each with its manifest, put together again."""
    r, made = _records(spark, sf_dir), _exact(spark, sf_dir)
    at, paths = sinks.scratch(spark, "batches"), []
    for n in range(3):
        mine = r.where((F.pmod(F.xxhash64("entity_id"), F.lit(3)) == n) | (F.col("source") > 1))
        own = made.join(rec.references(mine).select(F.col("entity_id").alias("reference_id")), "reference_id", "left_semi")
        identity = {"batch": n, "records": sinks.content_digest(mine)}
        sinks.write_batch(own.withColumn("p", F.lit(1.0)), own, mine, f"{at}/{n}", identity)
        if not sinks.batch_valid(spark, f"{at}/{n}", identity):
            raise AssertionError("a batch just written is valid")
        paths.append(f"{at}/{n}")
    return sinks.assemble(spark, paths, "matches", rec.references(r).count())


@query(f"SELECT threshold, macro_f05, tp, fp, fn FROM ({oracle.sweep('pa', GRID)})", "scored", "truth")
def threshold_file(spark, sf_dir):
    at = sinks.scratch(spark, "thresholds") + "/t"
    sinks.write_thresholds(threshold_sweep(spark, sf_dir), at)
    return spark.read.csv(at, header=True, schema="threshold double, macro_f05 double, tp long, fp long, fn long")


@query("SELECT k, count(*) AS n, count(DISTINCT reference_id) AS n_references FROM ranked5000 JOIN (VALUES (10), (50), (100)) v(k) ON rank <= k WHERE field = 'name' AND rank <= 50 GROUP BY 1", "ranked5000")
def route_files(spark, sf_dir):
    at = sinks.scratch(spark, "routes") + "/r"
    sinks.write_routes(candidates_name(spark, sf_dir), at)
    return spark.read.json(at).groupBy(F.col("k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("reference_id").alias("n_references"))


@query("SELECT s.split AS partition, count(*) AS n, sum((t.target_id IS NOT NULL)::INT)::BIGINT AS positives FROM candidates_legacy c JOIN split s USING (reference_id) LEFT JOIN truth t ON t.reference_id = c.reference_id AND t.target_id = c.target_id GROUP BY 1", "candidates_legacy", "split", "truth")
def packet_files(spark, sf_dir):
    """Labelled pairs by split in a packet whose files are checked by SHA-256 when they are read."""
    r, t = _records(spark, sf_dir), _truth(spark, sf_dir)
    at = sinks.scratch(spark, "packet")
    parts = audit.reference_split(r, t).select("reference_id", F.col("split").alias("partition"))
    sinks.write_packet(pairs.labelled(_legacy(spark, sf_dir), t).join(parts, "reference_id"), at, {"features": []})
    rows, _ = sinks.read_packet(spark, at)
    return rows.groupBy("partition").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))


# Errors, coverage and confirmation


@query(
    "WITH e AS (SELECT s.reference_id, s.target_id, pa, address_missing, address_numbers_both, address_numbers_equal, CASE WHEN pa >= 0.08 AND t.target_id IS NULL THEN 'FP' WHEN pa < 0.08 AND t.target_id IS NOT NULL THEN 'FN' END AS kind FROM scored s JOIN features f USING (reference_id, target_id) LEFT JOIN truth t USING (reference_id, target_id)), "
    "c AS (SELECT *, 'missing_address' AS category FROM e WHERE kind IS NOT NULL AND address_missing = 1 UNION ALL SELECT *, 'numeric_disagreement' FROM e WHERE kind IS NOT NULL AND address_numbers_both = 1 AND address_numbers_equal = 0) "
    "SELECT reference_id, target_id, category, kind, pa, r.name_raw AS reference_name, r.address_raw AS reference_address, t.name_raw AS target_name, t.address_raw AS target_address FROM c JOIN records r ON r.entity_id = reference_id JOIN records t ON t.entity_id = target_id",
    "scored",
    "features",
    "truth",
)
def error_mining(spark, sf_dir):
    """All errors of model a among the candidates, in the two categories, at a threshold that has some."""
    r = _records(spark, sf_dir)
    scored = _scored(spark, sf_dir, "address_missing", "address_numbers_both", "address_numbers_equal")
    rows = evaluation.mined_errors(r, _truth(spark, sf_dir), scored, 0.08, "pa", limit=None)
    return rows.select(*PAIR, "category", "kind", "pa", "reference_name", "reference_address", "target_name", "target_address")


@query(
    "SELECT threshold, tp, fp, links - tp AS fn, round(CASE WHEN links + fp = 0 THEN 1.0 ELSE 1.25 * tp / (1.25 * tp + fp + 0.25 * (links - tp)) END, 9) AS pooled_f05 FROM (SELECT threshold, count_if(pa >= threshold AND t.target_id IS NOT NULL) AS tp, count_if(pa >= threshold AND t.target_id IS NULL) AS fp, (SELECT count(*) FROM truth) AS links FROM scored s LEFT JOIN truth t USING (reference_id, target_id), (VALUES (0.362::DOUBLE), (0.665::DOUBLE)) v(threshold) GROUP BY 1)",
    "scored",
    "truth",
)
def pooled_at_thresholds(spark, sf_dir):
    return evaluation.pooled_at(_truth(spark, sf_dir), _scored(spark, sf_dir), [0.362, 0.665], "pa")


@query(
    oracle.findings(
        truth_missing="SELECT entity_id AS id FROM records WHERE source = 1 AND entity_id NOT IN (SELECT reference_id FROM faulty_lists)", truth_extra="SELECT 'S1-none' AS id", truth_repeated="SELECT low AS id FROM ends",
        prediction_missing="SELECT entity_id AS id FROM records WHERE source = 1 AND entity_id NOT IN (SELECT reference_id FROM normalized_exact)", prediction_extra="SELECT NULL::VARCHAR AS id WHERE false", prediction_repeated="SELECT NULL::VARCHAR AS id WHERE false",
    ),
    "faulty_lists",
    "ends",
    "normalized_exact",
)
def coverage_of_lists(spark, sf_dir):
    """What keeps the macro score from being taken: faulty truth lists, and predictions without the empty ones."""
    r = _records(spark, sf_dir)
    return evaluation.uncovered(r, _faulty_lists(spark, sf_dir), evaluation.lists_of(r, _exact(spark, sf_dir)).where(F.size("ids") > 0))


@query(f"SELECT {oracle.SUMMARY} FROM evaluation", "evaluation")
def macro_of_lists(spark, sf_dir):
    """The summary again, from lists that are first checked to cover the references."""
    r = _records(spark, sf_dir)
    return evaluation.macro_of_lists(r, _truth_lists(spark, sf_dir), evaluation.lists_of(r, _exact(spark, sf_dir)).select("reference_id", "ids"))


@query()
def locked_confirmation(spark, sf_dir):
    """Both models' thresholds, chosen on the dev part and judged on the holdout part."""
    r, t, s = _records(spark, sf_dir), _truth(spark, sf_dir), _kept(spark, _scored(spark, sf_dir), "scored")
    split = audit.reference_split(r, t).select("reference_id", "split")

    def part(name: str):
        own = split.where(F.col("split") == name).select("reference_id")
        inside = lambda x: x.join(own, "reference_id", "left_semi")
        refs = r.join(own.withColumnRenamed("reference_id", "entity_id"), "entity_id", "left_semi")
        return refs, inside(t), inside(s)

    return policy.confirmed(part("dev"), part("holdout"), ["pa", "pb"], GRID)


@query("SELECT c.reference_id, c.target_id, round(name_jaccard, 9) AS name_jaccard, round(address_jaccard, 9) AS address_jaccard, name_exact, address_exact, name_missing, address_missing FROM features c", "features")
def features_first_generation(spark, sf_dir):
    rows = feat.features(_legacy(spark, sf_dir), _records(spark, sf_dir), feat.GENERATIONS["v1"])
    return rows.select(*PAIR, *(F.round(n, 9).alias(n) if n.endswith("jaccard") else F.col(n) for n in feat.FEATURES[:6]))


# Generic audits on tables that are no entity data


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def events_distinct_kinds(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def orders_duplicate_customers(spark, sf_dir):
    return audit.duplicate_ids(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey")


@query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS \"O\", sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS \"F\" FROM lineitem GROUP BY 1")
def lineitem_pivot(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
