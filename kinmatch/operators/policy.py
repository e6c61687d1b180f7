"""From probabilities to links: thresholds, blends, country policies, and their tuning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions.text import score
from kinmatch.operators.evaluation import by_reference, summary
from kinmatch.sources.records import references

PAIR = ["reference_id", "target_id"]

#: The final policy blends models a and b equally at 0.6, but France takes b at 0.665; the hybrid takes a
#: at 0.362 for India and b at 0.665 elsewhere.
FINAL_BLEND, FINAL_B, HYBRID_A = 0.6, 0.665, 0.362


def blend(a: Column, b: Column, weight: float = 0.5) -> Column:
    return (a + b) / 2 if weight == 0.5 else weight * a + (1 - weight) * b


def thresholded(scored: DataFrame, threshold: float, column: str = "p") -> DataFrame:
    """Pairs whose probability is at least the threshold."""
    return scored.where(F.col(column) >= threshold).select(*PAIR)


def final_policy(scored: DataFrame, exception: str = "France") -> DataFrame:
    """scored: pairs with country, pa, pb."""
    take = F.when(F.col("country") == exception, F.col("pb") >= FINAL_B).otherwise(blend(F.col("pa"), F.col("pb")) >= FINAL_BLEND)
    return scored.where(take).select(*PAIR)


def hybrid_policy(scored: DataFrame, exception: str = "India") -> DataFrame:
    take = F.when(F.col("country") == exception, F.col("pa") >= HYBRID_A).otherwise(F.col("pb") >= FINAL_B)
    return scored.where(take).select(*PAIR)


def sweep(records: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: Sequence[float], column: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """threshold (and `by`), macro_f05, tp, fp, fn of every threshold.

    A pair only matters through the highest threshold that it reaches, so pairs are counted a reference and such step
    once; no pair is repeated for each threshold. The grid is a literal of the plan.
    """
    grid = sorted({round(t, 6) for t in thresholds})
    values = F.array(*(F.lit(float(t)) for t in grid))
    reached = F.size(F.filter(values, lambda t: F.col(column) >= t))
    marked = scored.join(truth.select(*PAIR, F.lit(1).alias("hit")), PAIR, "left").withColumn("step", reached)
    # Step 0 stays until the end: a filter on it would be pushed into the scores and evaluate them again for each threshold.
    steps = marked.groupBy("reference_id", "step").agg(F.count("*").alias("made"), F.count("hit").alias("tp"))
    true = truth.groupBy("reference_id").agg(F.count("*").alias("true_count"))
    refs = references(records).select(F.col("entity_id").alias("reference_id"), "country").join(true, "reference_id", "left").withColumn("true_count", F.coalesce("true_count", F.lit(0)))
    # Each reference starts above the grid with nothing. What it has at a step it has down to the next one that it reaches.
    none = F.lit(0).cast("long")
    steps = refs.select("reference_id", "country", "true_count", F.lit(len(grid) + 1).alias("step"), none.alias("made"), none.alias("tp")).unionByName(steps, allowMissingColumns=True)
    whole = Window.partitionBy("reference_id")
    down = whole.orderBy(F.desc("step"))
    rows = steps.select(
        F.max("country").over(whole).alias("country"), F.max("true_count").over(whole).alias("true_count"), F.sum("made").over(down).alias("made"), F.sum("tp").over(down).alias("tp"),
        (F.lead("step", 1, 0).over(down) + 1).alias("low"), F.least("step", F.lit(len(grid))).alias("step"),
    ).where("low <= step AND true_count IS NOT NULL")
    # Equal outcomes are counted before they meet the thresholds.
    rows = rows.groupBy("country", "true_count", "made", "tp", "low", "step").agg(F.count("*").alias("n")).withColumn("score", score(F.col("tp"), F.col("made"), F.col("true_count")))
    cells = rows.withColumn("at", F.explode(F.sequence("low", "step"))).withColumn("threshold", F.element_at(values, F.col("at")))
    total = lambda c: F.sum(c * F.col("n"))
    return cells.groupBy(*by, "threshold").agg(
        F.round(total(F.col("score")) / F.sum("n"), 9).alias("macro_f05"), total(F.col("tp")).alias("tp"), total(F.col("made") - F.col("tp")).alias("fp"), total(F.col("true_count") - F.col("tp")).alias("fn")
    )


def pick(measured: DataFrame, highest: bool = False) -> DataFrame:
    """The row of the best macro score; of equal ones that of the lowest (or highest) threshold."""
    order = F.desc("threshold") if highest else F.asc("threshold")
    return measured.orderBy(F.desc("macro_f05"), order).limit(1)


#: The four tuning grids: coarse with the lowest winning (a, b); coarse, then fine around the best, with the highest
#: winning (c, d). In c, infinity means that no pair is taken.
GRIDS = {
    "a": ([round(-0.1 + 0.1 * i, 6) for i in range(13)], None, False),
    "b": ([round(0.05 * i, 6) for i in range(21)], None, False),
    "c": ([round(0.01 * i, 6) for i in range(1, 100)] + [float("inf")], (0.02, 0.002), True),
    "d": ([0.0, *(round(0.01 + 0.005 * i, 6) for i in range(197)), 1.0], (0.01, 0.001), True),
}


def tune(records: DataFrame, truth: DataFrame, scored: DataFrame, variant: str = "d", column: str = "p") -> tuple[float, float]:
    """Threshold and macro score that a tuning variant chooses."""
    coarse, fine, highest = GRIDS[variant]
    best = pick(sweep(records, truth, scored, coarse, column), highest).first()
    if fine and best.threshold != float("inf"):
        reach, step = fine
        near = [round(best.threshold + step * i, 6) for i in range(-round(reach / step), round(reach / step) + 1)]
        best = pick(sweep(records, truth, scored, [best.threshold, *(t for t in near if 0 <= t <= 1)], column), highest).first()
    return best.threshold, best.macro_f05


def confirmed(tuning: tuple[DataFrame, DataFrame, DataFrame], confirmation: tuple[DataFrame, DataFrame, DataFrame], columns: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """model, threshold, macro_f05, oracle_macro_f05, tp, fp, fn: each model's threshold is chosen on the tuning part, locked, and
    then judged once on the confirmation part, all models on the same candidates. A part is (records, truth, scored)."""
    out = None
    for column in columns:
        locked = pick(sweep(*tuning, thresholds, column)).first().threshold  # one row
        records, truth, scored = confirmation
        made = summary(by_reference(records, truth, thresholded(scored, locked, column)))
        oracle = summary(by_reference(records, truth, scored.select(*PAIR))).select(F.col("candidate_oracle_macro_f05").alias("oracle_macro_f05"))
        one = made.join(F.broadcast(oracle)).select(F.lit(column).alias("model"), F.lit(float(locked)).alias("threshold"), "macro_f05", "oracle_macro_f05", "tp", "fp", "fn")
        out = one if out is None else out.unionByName(one)
    return out


def blend_grid(records: DataFrame, truth: DataFrame, scored: DataFrame, weights: Sequence[float], thresholds: Sequence[float]) -> DataFrame:
    """weight, threshold, macro_f05, and worst: the least gain of any country over model b at FINAL_B."""
    base = sweep(records, truth, scored, [FINAL_B], "pb", ["country"]).select("country", F.col("macro_f05").alias("base"))
    union = None
    for w in weights:
        mixed = scored.withColumn("p", F.round(blend(F.col("pa"), F.col("pb"), w), 9))
        whole = sweep(records, truth, mixed, thresholds).select(F.lit(w).alias("weight"), "threshold", "macro_f05")
        parts = sweep(records, truth, mixed, thresholds, by=["country"]).join(base, "country").groupBy("threshold").agg(F.round(F.min(F.col("macro_f05") - F.col("base")), 9).alias("worst"))
        one = whole.join(parts, "threshold")
        union = one if union is None else union.unionByName(one)
    return union.select("weight", "threshold", "macro_f05", "worst")


def pick_blend(grid: DataFrame) -> DataFrame:
    """The best cell in which no country loses; ties go to the larger weight, then the larger threshold."""
    return grid.where("worst >= 0").orderBy(F.desc("macro_f05"), F.desc("weight"), F.desc("threshold")).limit(1)


def country_grid(records: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """country, model, threshold, macro_f05: each country's best of models a and b on the grid."""
    cells = None
    for name in ("a", "b"):
        one = sweep(records, truth, scored, thresholds, f"p{name}", ["country"]).withColumn("model", F.lit(name))
        cells = one if cells is None else cells.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("macro_f05"), "model", "threshold"))
    return cells.withColumn("rank", rank).where("rank = 1").select("country", "model", "threshold", "macro_f05")


def larger_set_wins(small: float, large: float, margin: float = 0.002) -> bool:
    """Whether a larger feature set is adopted."""
    return large > small + margin


def linear(weights: dict[str, float], intercept: float) -> Column:
    """A fixed logistic scorer over feature columns."""
    z = F.lit(intercept)
    for name, w in weights.items():
        z = z + w * F.col(name)
    return 1 / (1 + F.exp(-z))
