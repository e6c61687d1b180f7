"""Set-based evaluation of predicted links: per reference, pooled, and by segment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.text import oracle_score, score
from kinmatch.operators.audit import checks
from kinmatch.sources.records import references

PAIR = ["reference_id", "target_id"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def by_reference(records: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row a reference, with or without links: country, true_count, predicted_count, tp, fp, fn, score.

    Both sides are reduced to one row a reference before they meet the records.
    """
    true = truth.groupBy("reference_id").agg(F.count("*").alias("true_count"))
    marked = predictions.select(*PAIR).distinct().join(truth.select(*PAIR, F.lit(1).alias("hit")), PAIR, "left")
    made = marked.groupBy("reference_id").agg(F.count("*").alias("predicted_count"), F.count("hit").alias("tp"))
    out = references(records).select(F.col("entity_id").alias("reference_id"), "country").join(true, "reference_id", "left").join(made, "reference_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = out.select("reference_id", "country", zero("true_count"), zero("predicted_count"), zero("tp"))
    out = out.withColumn("fp", F.col("predicted_count") - F.col("tp")).withColumn("fn", F.col("true_count") - F.col("tp"))
    return out.withColumn("score", score(F.col("tp"), F.col("predicted_count"), F.col("true_count")))


def summary(evaluation: DataFrame, *by: str) -> DataFrame:
    """The ten measures of a partition, overall or for each value of `by`; without references it raises an error.

    Scores are rounded sums over the number of references, so equal inputs give equal results in any order.
    """
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    n, single, false_single = F.count("*"), F.count_if(F.col("true_count") == 0), F.count_if((F.col("true_count") == 0) & (F.col("predicted_count") > 0))
    oracle = F.avg(oracle_score(F.col("tp"), F.col("true_count")))
    measures = [
        F.when(n == 0, F.raise_error(F.lit("empty evaluation partition")).cast("long")).otherwise(n).alias("references"),
        F.round(F.avg("score"), 9).alias("macro_f05"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        F.round(ratio(tp, tp + fp), 9).alias("micro_precision"),
        F.round(ratio(tp, tp + fn), 9).alias("micro_recall"),
        single.alias("singletons"),
        false_single.alias("singleton_false_matches"),
        F.round(ratio(false_single, single), 9).alias("singleton_false_positive_rate"),
        F.count_if(F.col("predicted_count") > 0).alias("references_with_predictions"),
        F.round(ratio(F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)), n), 9).alias("exact_set_accuracy"),
        F.round(ratio(single, n), 9).alias("empty_baseline"),
        F.round(oracle, 9).alias("candidate_oracle_macro_f05"),
    ]
    return evaluation.groupBy(*by).agg(*measures)


def pooled_f05(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn == 0, 1.0).otherwise(1.25 * tp / (1.25 * tp + fp + 0.25 * fn))


def by_source(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """source (S2 or S3), tp, fp, fn over links."""
    left = predictions.select(*PAIR, F.lit(1).alias("p")).distinct()
    both = left.join(truth.select(*PAIR, F.lit(1).alias("t")), PAIR, "full_outer")
    hit = F.col("p").isNotNull() & F.col("t").isNotNull()
    return both.groupBy(F.substring("target_id", 1, 2).alias("source")).agg(F.count_if(hit).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def error_attribution(records: DataFrame, truth: DataFrame, candidates: DataFrame, predictions: DataFrame, *by: str) -> DataFrame:
    """Missed true links: those that retrieval never proposed, and those that the classifier refused."""
    marked = truth.select(*PAIR).join(candidates.select(*PAIR, F.lit(1).alias("c")).distinct(), PAIR, "left").join(predictions.select(*PAIR, F.lit(1).alias("p")).distinct(), PAIR, "left")
    marked = marked.join(references(records).select(F.col("entity_id").alias("reference_id"), "country"), "reference_id")
    return marked.groupBy(*by).agg(F.count("*").alias("true_links"), F.count_if(F.col("c").isNull()).alias("retrieval_fn"), F.count_if(F.col("c").isNotNull() & F.col("p").isNull()).alias("classifier_fn"))


def false_positives(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.join(truth, PAIR, "left_anti")


def false_negatives(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    return truth.join(predictions, PAIR, "left_anti")


def error_examples(records: DataFrame, pairs: DataFrame, limit: int | None = 10) -> DataFrame:
    """Pairs with both sides' texts, in id order, at most `limit`."""
    side = lambda who: records.select(F.col("entity_id").alias(f"{who}_id"), *([F.col("country")] if who == "reference" else []), F.col("name_raw").alias(f"{who}_name"), F.col("address_raw").alias(f"{who}_address"))
    out = pairs.select(*PAIR).join(side("reference"), "reference_id").join(side("target"), "target_id")
    out = out.select("reference_id", "country", "reference_name", "reference_address", "target_id", "target_name", "target_address")
    return out if limit is None else out.orderBy(*PAIR).limit(limit)


def retrieval_quality(records: DataFrame, truth: DataFrame, candidates: DataFrame) -> DataFrame:
    """Link recall, oracle score, share of references without any true candidate, and the distribution of list lengths.

    Order statistics are taken by index: element floor(n * q) of the sorted lengths, counting from 0.
    """
    per = by_reference(records, truth, candidates)
    lengths = per.groupBy("predicted_count").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy("predicted_count"))  # one row a different length
    placed = lengths.withColumn("upto", running)
    total = per.agg(
        F.count("*").alias("references"), F.sum("predicted_count").alias("candidates_total"), F.round(F.avg("predicted_count"), 9).alias("candidates_mean"), F.max("predicted_count").alias("candidates_max"),
        F.round(ratio(F.sum("tp"), F.sum("true_count")), 9).alias("link_recall"), F.round(F.avg(oracle_score(F.col("tp"), F.col("true_count"))), 9).alias("oracle_macro_f05"),
        F.round(ratio(F.count_if((F.col("true_count") > 0) & (F.col("tp") == 0)), F.count_if(F.col("true_count") > 0)), 9).alias("zero_retrieved_rate"),
    )
    spread = placed.join(F.broadcast(total.select("references")))  # a single row
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("references") * F.lit(q)), F.col("predicted_count")))
    ranks = spread.agg(at(0.5).alias("candidates_median"), at(0.95).alias("candidates_p95"))
    return total.join(F.broadcast(ranks))


def paired_comparison(left: DataFrame, right: DataFrame, *by: str, tolerance: float = 1e-5) -> DataFrame:
    """Two evaluations of the same references: mean difference (left - right), wins, losses and ties."""
    joined = left.select("reference_id", "country", F.col("score").alias("a")).join(right.select("reference_id", F.col("score").alias("b")), "reference_id")
    d = F.col("a") - F.col("b")
    return joined.groupBy(*by).agg(
        F.count("*").alias("references"), F.round(F.avg(d), 9).alias("mean_delta"), F.count_if(d > tolerance).alias("wins"), F.count_if(d < -tolerance).alias("losses"), F.count_if(F.abs(d) <= tolerance).alias("ties")
    )


def bootstrap_interval(left: DataFrame, right: DataFrame, resamples: int = 3000, seed: int = 42) -> DataFrame:
    """95 % interval of the mean difference by a paired bootstrap.

    Differences take few values, so they are counted first; a resample then draws its counts from one multinomial. The
    driver holds one number for each different value, rounded to 1e-9.
    """
    joined = left.select("reference_id", F.col("score").alias("a")).join(right.select("reference_id", F.col("score").alias("b")), "reference_id")
    counts = joined.groupBy(F.round(F.col("a") - F.col("b"), 9).alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    d, n = np.array([r.d for r in counts], float), np.array([r.n for r in counts], np.int64)
    means = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), resamples) @ d / n.sum()
    low, high = (float(x) for x in np.quantile(means, [0.025, 0.975]))
    return left.sparkSession.createDataFrame([(float(n @ d / n.sum()), low, high, resamples)], "mean_delta double, low double, high double, resamples int")


def change_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """country, references, changed: whose list of predictions differs. Inputs: reference_id, country, ids (sorted array)."""
    joined = old.select("reference_id", "country", F.col("ids").alias("a")).join(new.select("reference_id", F.col("ids").alias("b")), "reference_id")
    return joined.groupBy("country").agg(F.count("*").alias("references"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


def fingerprint(lists: DataFrame) -> DataFrame:
    """rows and an order-free digest: the XOR of a hash of every reference with its sorted ids."""
    return lists.agg(F.count("*").alias("n"), F.expr("bit_xor(cast(conv(substring(sha2(concat(reference_id, '|', concat_ws(',', ids)), 256), 1, 15), 16, 10) as bigint))").alias("digest"))


def ordered_fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One SHA-256 that depends on the set of rows alone: a tree of digests of sorted digests.

    Lines are grouped by the first six hex digits of their digest, the groups by the first three, so 10^12 rows make
    lists of some 60,000 digests, and a list is one of at most 4,096 above.
    """
    digest = lambda: F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))), 256).alias("h")
    parts = rows.select(F.sha2(F.concat_ws("\t", *columns), 256).alias("h")).groupBy(F.substring("h", 1, 6).alias("part")).agg(digest())
    parts = parts.groupBy(F.substring("part", 1, 3).alias("part")).agg(digest())
    return parts.agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list("h"))), 256).alias("sha256"))


def uncovered(records: DataFrame, truth_lists: DataFrame, predictions: DataFrame) -> DataFrame:
    """check, n, examples: references without a row in truth or predictions (reference_id, ids), rows of no reference, repeated rows."""
    refs = references(records).select(F.col("entity_id").alias("reference_id"))
    who = F.col("reference_id").alias("id")
    out = {}
    for name, rows in (("truth", truth_lists), ("prediction", predictions)):
        out[f"{name}_missing"] = refs.join(rows, "reference_id", "left_anti").select(who)
        out[f"{name}_extra"] = rows.join(refs, "reference_id", "left_anti").select(who)
        out[f"{name}_repeated"] = rows.groupBy("reference_id").agg(F.count("*").alias("n")).where("n > 1").select(who)
    return checks(out)


def macro_of_lists(records: DataFrame, truth_lists: DataFrame, predictions: DataFrame) -> DataFrame:
    """summary() of two tables of lists that must cover the references exactly; a ValueError says what does not."""
    found = uncovered(records, truth_lists, predictions).where("n > 0").collect()
    if found:
        raise ValueError("; ".join(f"{r.check}: {r.examples}" for r in found))
    links = lambda x: x.select("reference_id", F.explode(F.array_distinct("ids")).alias("target_id"))
    return summary(by_reference(records, links(truth_lists), links(predictions)))


def pooled_at(truth: DataFrame, scored: DataFrame, thresholds: Sequence[float], column: str = "p") -> DataFrame:
    """threshold, tp, fp, fn, pooled_f05 over all pairs, for each threshold; true links that are no candidates are misses."""
    links = truth.agg(F.count("*").alias("links"))  # one row
    marked = scored.join(truth.select(*PAIR, F.lit(1).alias("hit")), PAIR, "left")
    of = lambda t: F.struct(F.lit(float(t)).alias("threshold"), F.count_if((F.col(column) >= t) & F.col("hit").isNotNull()).alias("tp"), F.count_if((F.col(column) >= t) & F.col("hit").isNull()).alias("fp"))
    cells = marked.agg(F.array(*map(of, sorted(set(thresholds)))).alias("cells")).select(F.explode("cells").alias("c")).select("c.*").join(F.broadcast(links))
    cells = cells.withColumn("fn", F.col("links") - F.col("tp"))
    return cells.select("threshold", "tp", "fp", "fn", F.round(pooled_f05(F.col("tp"), F.col("fp"), F.col("fn")), 9).alias("pooled_f05"))


#: The error categories, over the features of a pair.
ERROR_CATEGORIES = {"missing_address": "address_missing = 1", "numeric_disagreement": "address_numbers_both = 1 AND address_numbers_equal = 0"}


def mined_errors(records: DataFrame, truth: DataFrame, scored: DataFrame, threshold: float, column: str = "p", limit: int | None = 5) -> DataFrame:
    """Errors of a thresholded model among the candidates, by category, with probability, both texts and the features.

    scored: pairs with a probability and the features that ERROR_CATEGORIES name; kind is FP or FN; an error of two
    categories gives two rows; of each category and kind the first `limit` pairs in id order are kept (None: all).
    """
    marked = scored.join(truth.select(*PAIR, F.lit(1).alias("hit")), PAIR, "left")
    kind = F.when((F.col(column) >= threshold) & F.col("hit").isNull(), "FP").when((F.col(column) < threshold) & F.col("hit").isNotNull(), "FN")
    wrong = marked.withColumn("kind", kind).where("kind IS NOT NULL").drop("hit")
    category = F.explode(F.filter(F.array(*(F.when(F.expr(rule), name) for name, rule in ERROR_CATEGORIES.items())), lambda x: x.isNotNull()))
    rows = wrong.withColumn("category", category)
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("category", "kind").orderBy(*PAIR))
        rows = rows.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
    texts = error_examples(records, rows.select(*PAIR).distinct(), limit=None).drop("country")
    return rows.join(texts, PAIR)


def lists_of(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every reference with its sorted ids, empty lists included."""
    ids = pairs.groupBy("reference_id").agg(F.sort_array(F.collect_set("target_id")).alias("ids"))
    return references(records).select(F.col("entity_id").alias("reference_id"), "country").join(ids, "reference_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
