"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in hash order, repeated up to CAP times. A document's virtual finish time is its
source's cumulative size up to and including it, over the source's target; a queue closes with the document that reaches
the target. All queues are merged in the order of virtual time and truncated where the total budget is used up.

Prefix sums are taken in two steps - over sums of hash buckets, then inside a bucket - so no source, however large, is
ever sorted in one task. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import WORD_PATTERN, Scratch

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (1, 2, 3)
#: A source, and so a document, is taken at most so many times over.
CAP = 3
#: Hash buckets of a source's queue, and buckets of virtual time up to 1, at least; records a bucket, about. Their number
#: only divides the work: any gives the same mix.
BUCKETS, ROWS = 4096, 1_000_000
#: Salt of the shuffling hash.
SALT = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """sizes: source_key, source_size, one row a source -> also target: min(cap * size, level * weight), summing to the budget.

    The level is where resharing by weight ends: with the sources in order of cap * size / weight, the first that stays
    below its cap shares with all later ones what the earlier ones leave. The two windows run over one row a source.
    """
    by_name, by_ratio = Window.orderBy("source_key"), Window.orderBy("ratio", "source_key")
    ahead, behind = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight"))
    out = out.withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(share))
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(ahead), F.lit(0))) / F.sum("weight").over(behind))
    out = out.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key"))).over(Window.partitionBy()))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double")))
    return out.select("source_key", "source_size", target.alias("target"), F.floor("budget").cast("long").alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: str | None = None) -> DataFrame:
    """One row a document: id_col, size, source_size, target and taken, the words that the mix takes of it.

    A long column named in carry comes out beside them; it tells apart documents that are equal in id and size.

    Size is the number of words of the text, 0 for null and empty ones, of which nothing is taken. A null source is a
    source of its own, last in order. Rows with equal ids are documents of their own; equal rows share a place in the
    queue one after the other. With no words at all every target is 0. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = Scratch(spark, "mix")
    key = F.conv(F.substring(F.md5(F.concat(F.lit(SALT), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    # The key puts null behind every source.
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col))).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        key.alias("key"),
        (F.col(carry) if carry else F.lit(0).cast("long")).alias("carried"),
    )
    rows = held.table(rows, "sizes")  # texts are read once
    buckets = 1 << (max(BUCKETS, rows.count() // ROWS) - 1).bit_length()  # the count is in the files' footers
    rows = rows.withColumn("bucket", F.shiftright("key", 60 - buckets.bit_length() + 1))

    sums = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    before = F.sum("bucket_size").over(Window.partitionBy("source_key").orderBy("bucket")) - F.col("bucket_size")
    starts = sums.withColumn("before", before).drop("bucket_size").join(targets, "source_key")
    queue = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "size", "carried").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("within", F.sum("size").over(queue)).join(starts, ["source_key", "bucket"])
    placed = held.table(placed.withColumn("done", F.col("before") + F.col("within")).drop("before", "within", "bucket"), "queue")

    # Every repetition that its queue takes, in the order of virtual finish time.
    repeated = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))))
    repeated = repeated.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("done")) / F.col("target"))
    repeated = repeated.where(F.col("epoch") * F.col("source_size") + F.col("done") - F.col("size") < F.col("target"))
    # Finish times spread evenly up to 1; beyond it there is at most one repetition a source.
    slot = F.least(F.floor(F.col("finish") * buckets), F.lit(buckets)).cast("int")
    repeated = repeated.select("budget", "size", slot.alias("slot"), F.struct("finish", "source_key", "epoch", "key", "doc_id", "carried").alias("place"))
    slots = repeated.groupBy("slot").agg(F.sum("size").alias("slot_size"))
    slots = slots.withColumn("before", F.sum("slot_size").over(Window.orderBy("slot")) - F.col("slot_size")).drop("slot_size")
    merged = Window.partitionBy("slot").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, 0)
    used = repeated.withColumn("within", F.sum("size").over(merged)).join(slots, "slot")
    cut = used.where(F.col("before") + F.col("within") <= F.col("budget")).agg(F.max("place").alias("last")).first()["last"]

    kept = [F.col("carried").alias(carry)] if carry else []
    # The driver holds where the mix is cut, one row; each document compares its repetitions with it.
    if cut is None:
        return placed.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), *kept)
    kinds = {f.name: f.dataType for f in repeated.schema["place"].dataType.fields}
    last = F.struct(*(F.lit(cut[c]).cast(kinds[c]).alias(c) for c in kinds))
    finish = [(e * F.col("source_size") + F.col("done")) / F.col("target") for e in range(cap)]
    places = [F.struct(f.alias("finish"), "source_key", F.lit(e).alias("epoch"), "key", "doc_id", "carried") for e, f in enumerate(finish)]
    taken = [F.when((F.col("size") > 0) & (e * F.col("source_size") + F.col("done") - F.col("size") < F.col("target")) & (p <= last), 1).otherwise(0) for e, p in enumerate(places)]
    return placed.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (F.col("size") * sum(taken[1:], taken[0])).cast("long").alias("taken"), *kept)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SALT}' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most FROM d GROUP BY k),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY k) - 1) % 3)::BIGINT AS weight FROM s),
r AS (SELECT *, most::DOUBLE / weight AS ratio, (SELECT sum(size) FROM d)::BIGINT AS budget FROM w),
l AS (SELECT *, (budget::DOUBLE - coalesce(sum(most) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM r),
v AS (SELECT lv FROM l WHERE lv <= ratio ORDER BY ratio, k LIMIT 1),
t AS (SELECT k, source_size, budget, least(most::DOUBLE, coalesce((SELECT lv FROM v) * weight, most::DOUBLE)) AS target FROM l),
q AS (SELECT d.*, t.source_size, t.target, t.budget, (sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS done FROM d JOIN t USING (k)),
e AS (SELECT q.*, epoch, (epoch * source_size + done)::DOUBLE / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS epoch)
    WHERE size > 0 AND epoch * source_size + done - size < target),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, k, epoch, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS used FROM e),
x AS (SELECT doc_id, k, size, done, sum(size)::BIGINT AS taken FROM m WHERE used <= budget GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(x.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN x ON q.doc_id IS NOT DISTINCT FROM x.doc_id AND q.k = x.k AND q.size = x.size AND q.done = x.done
"""


def kept_documents(docs: DataFrame, **names) -> DataFrame:
    """The mix as documents: every row of docs as often as the mix takes it (not at all, once, or up to CAP times).

    Rows are told apart by a number of their own, so ids may repeat or be null; the columns of docs come out as they went in.
    """
    # Written once: the plan and the documents must see the same numbers.
    docs_ = Scratch(docs.sparkSession, "mix").table(docs.withColumn("_mixed_row", F.monotonically_increasing_id()), "documents")
    plan = mix(docs_, **names, carry="_mixed_row").where("taken > 0").select("_mixed_row", (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    times = F.explode(F.sequence(F.lit(1), F.col("_times")))
    return docs_.join(plan, "_mixed_row").withColumn("_times", times).select(*docs.columns)
