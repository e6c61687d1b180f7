"""Record tables: the schema, the store's normalized form, and the entity view of the test documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinmatch.functions.text import normalize, normalize_exact, source_of

#: Columns of the source, truth and output files.
SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_COLUMNS = ("source1_entity_id", "candidate_entity_ids")


def text_schema(columns: tuple[str, ...]) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in columns])


def normalized(sources: DataFrame, exact: bool = False) -> DataFrame:
    """Source rows -> records: id, source, raw and normalized texts, and whether all three normalized fields are there."""
    norm = normalize_exact if exact else normalize
    raw = {"name": "business_name", "address": "business_address", "country": "country"}
    out = sources.select("entity_id", source_of(F.col("entity_id")).alias("source"), *(F.coalesce(c, F.lit("")).alias(f"{n}_raw" if n != "country" else n) for n, c in raw.items()))
    out = out.withColumns({"country_norm": norm(F.col("country")), "name_norm": norm(F.col("name_raw")), "address_norm": norm(F.col("address_raw"))})
    return out.withColumn("eligible", ((F.col("country_norm") != "") & (F.col("name_norm") != "") & (F.col("address_norm") != "")).cast("int"))


_partitions: dict[tuple[str, str], int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, dealt to all cores where its files have too few row groups to be read by all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = (spark.sparkContext.applicationId, f"{sf_dir}/{name}")
    if key not in _partitions:
        _partitions[key] = rows.rdd.getNumPartitions()
    want = spark.sparkContext.defaultParallelism
    return rows if _partitions[key] >= want else rows.repartition(want)


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test documents seen as source rows: the whole first line is the name, the whole second the address, language
    the country."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    line = lambda n: F.split_part("text", F.lit("\n"), F.lit(n))
    entity = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return docs.select(entity.alias("entity_id"), line(1).alias("business_name"), line(2).alias("business_address"), F.col("lang").alias("country"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(document_sources(spark, sf_dir))


def document_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True links of the test documents: reference and target of one country whose whole normalized texts are equal."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    entity = F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    # The digest stands for the text in the shuffle.
    rows = docs.where("text IS NOT NULL").select(entity.alias("id"), (F.col("doc_id") % 3 + 1).alias("source"), F.col("lang").alias("country"), F.sha2(normalize(F.col("text")), 256).alias("digest"))
    refs = rows.where("source = 1").select(F.col("id").alias("reference_id"), "country", "digest")
    targets = rows.where("source IN (2, 3)").select(F.col("id").alias("target_id"), "country", "digest")
    return refs.join(targets, ["country", "digest"]).select("reference_id", "target_id")


def references(records: DataFrame) -> DataFrame:
    return records.where("source = 1")


def targets(records: DataFrame) -> DataFrame:
    return records.where("source IN (2, 3)")


def first_wins(*tables: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows of several tables by name; of rows with one key, that of the earliest table stays."""
    union = tables[0].withColumn("_rank", F.lit(0))
    for n, t in enumerate(tables[1:], 1):
        union = union.unionByName(t.withColumn("_rank", F.lit(n)))
    whole = [c for c in union.columns if c not in (key, "_rank")]
    best = union.groupBy(key).agg(F.min_by(F.struct(*whole), F.col("_rank")).alias("_row"))
    return best.select(key, *(F.col("_row")[c].alias(c) for c in whole)).select(*tables[0].columns)
