"""File sinks. A table is written to a temporary folder beside its place and moved there when complete."""

from __future__ import annotations

import hashlib
import itertools
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.functions.text import join_ids
from kinmatch.sources.records import CANDIDATE_COLUMNS, TRUTH_COLUMNS, references


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _filesystem(spark, path)
    return fs.exists(at)


_serial = itertools.count()


def scratch(spark: SparkSession, name: str) -> str:
    """A new place below spark.checkpoint.dir, which all executors share; a temporary folder where that is unset in local mode."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local.setdefault("root", "file://" + tempfile.mkdtemp(prefix="kinmatch-"))
    return f"{root.rstrip('/')}/kinmatch-{name}-{spark.sparkContext.applicationId}-{next(_serial)}"


_local: dict[str, str] = {}


def publish(df: DataFrame, path: str, write) -> None:
    """write(df, temporary path), then one rename; a place that is taken raises an error."""
    spark = df.sparkSession
    at, fs = _filesystem(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    temporary = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    write(df, temporary)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(temporary), at):
        raise OSError(f"cannot publish {path}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _filesystem(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def write_report(spark: SparkSession, path: str, report: dict, title: str | None = None) -> None:
    """A JSON file and, with a title, a Markdown table of the same beside it."""
    write_text(spark, path, json.dumps(report, indent=1, sort_keys=True, ensure_ascii=False))
    if title:
        rows = "".join(f"| {k} | {v} |\n" for k, v in sorted(report.items()))
        write_text(spark, path.removesuffix(".json") + ".md", f"# {title}\n\n| measure | value |\n|---|---|\n{rows}")


def content_digest(rows: DataFrame) -> str:
    """Number and order-free digest of rows: two sums of row hashes, so it does not depend on files or partitions."""
    columns = sorted(rows.columns)
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    n, a, b = rows.agg(F.count("*"), part(1), part(2)).first()
    return f"{n}:{int(a or 0) % (1 << 64):016x}{int(b or 0) % (1 << 64):016x}"


def ingest(records: DataFrame, path: str, keep: DataFrame | None = None, identity: dict | None = None) -> bool:
    """The record store: Parquet by country; keep: entity_id of the rows wanted.

    identity (digests of the inputs) is written beside it; a store that is there already is used again, and False
    returned, if its identity is the same, and is an error if not.
    """
    spark, note = records.sparkSession, f"{path.rstrip('/')}.identity.json"
    if identity is not None and exists(spark, path):
        if exists(spark, note) and json.loads(spark.read.text(note, wholetext=True).first()[0]) == identity:
            return False
        raise ValueError(f"{path} was made from other inputs")
    rows = records if keep is None else records.join(keep.select("entity_id"), "entity_id", "left_semi")
    # Within a file ids are ordered, so lookups of id ranges skip row groups.
    publish(rows.repartition("country", F.pmod(F.xxhash64("entity_id"), F.lit(64))).sortWithinPartitions("country", "source", "entity_id"), path, lambda d, p: d.write.partitionBy("country").parquet(p))
    if identity is not None:
        write_text(spark, note, json.dumps(identity, sort_keys=True))
    return True


def list_rows(records: DataFrame, pairs: DataFrame, column: str = TRUTH_COLUMNS[1]) -> DataFrame:
    """One row a reference, links or not: the id, and its sorted ids joined by commas."""
    ids = pairs.groupBy("reference_id").agg(join_ids(F.collect_set("target_id")).alias(column))
    rows = references(records).select(F.col("entity_id").alias("reference_id")).join(ids, "reference_id", "left")
    return rows.select(F.col("reference_id").alias(TRUTH_COLUMNS[0]), F.coalesce(column, F.lit("")).alias(column))


def write_lists(records: DataFrame, pairs: DataFrame, path: str, column: str = TRUTH_COLUMNS[1], files: int | None = None) -> None:
    """list_rows() in reference order as TSV; a file count of 1 makes a single file for handing in."""
    rows = list_rows(records, pairs, column)
    rows = rows.orderBy(TRUTH_COLUMNS[0]) if files != 1 else rows.coalesce(1).sortWithinPartitions(TRUTH_COLUMNS[0])
    publish(rows, path, lambda d, p: d.write.csv(p, sep="\t", header=True, emptyValue="", quote="", escape="", lineSep="\n"))


def write_candidates(records: DataFrame, pairs: DataFrame, path: str, files: int | None = None) -> None:
    write_lists(records, pairs, path, CANDIDATE_COLUMNS[1], files)


def write_batch(scored: DataFrame, matches: DataFrame, records: DataFrame, path: str, identity: dict) -> None:
    """A batch folder: scored pairs, both lists, and a manifest written last that makes it valid."""
    spark = scored.sparkSession
    publish(scored, f"{path}/pairs", lambda d, p: d.write.parquet(p))
    write_lists(records, matches, f"{path}/matches")
    write_candidates(records, scored.select("reference_id", "target_id"), f"{path}/candidates")
    write_text(spark, f"{path}/batch.json", json.dumps(identity | {"digest": identity_digest(identity)}, sort_keys=True))


def identity_digest(identity: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in identity.items() if k != "digest"}, sort_keys=True).encode()).hexdigest()


def batch_valid(spark: SparkSession, path: str, identity: dict) -> bool:
    """False for an absent batch; another identity or a damaged manifest raises an error."""
    if not exists(spark, f"{path}/batch.json"):
        return False
    held = json.loads(spark.read.text(f"{path}/batch.json", wholetext=True).first()[0])
    if held.get("digest") != identity_digest(held):
        raise ValueError(f"damaged manifest in {path}")
    if {k: v for k, v in held.items() if k != "digest"} != identity:
        raise ValueError(f"{path} belongs to another run")
    return True


def assemble(spark: SparkSession, paths: list[str], part: str, expected: int) -> DataFrame:
    """The rows of all batches' lists; another count than expected raises an error."""
    rows = spark.read.csv([f"{p}/{part}" for p in sorted(paths)], sep="\t", header=True, quote="", schema=f"{TRUTH_COLUMNS[0]} string, ids string").na.fill("")
    if (n := rows.count()) != expected:
        raise ValueError(f"{n} rows in batches, {expected} expected")
    return rows


def write_thresholds(measured: DataFrame, path: str) -> None:
    publish(measured.orderBy("threshold"), path, lambda d, p: d.write.csv(p, header=True))


def write_predictions(lists: DataFrame, path: str) -> None:
    """JSON lines of reference_id and predicted_ids."""
    publish(lists.select("reference_id", F.col("ids").alias("predicted_ids")), path, lambda d, p: d.write.json(p))


def write_routes(ranked: DataFrame, path: str, ks: tuple[int, ...] = (10, 50, 100)) -> None:
    """Ranked candidates as JSON lines, a folder for each list length; a row goes to every length that reaches it."""
    lengths = F.explode(F.filter(F.array(*map(F.lit, ks)), lambda k: F.col("rank") <= k))
    publish(ranked.withColumn("k", lengths), path, lambda d, p: d.write.partitionBy("k").json(p))


def file_digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every data file below path, by its place there; the driver gets one row a file."""
    root = str(_filesystem(spark, path)[1].makeQualified(_filesystem(spark, path)[0])).rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    tail = lambda p: p.split(":", 1)[-1].lstrip("/")  # noqa: E731  (file:/ and file:/// are the same place)
    return {tail(r.path).removeprefix(tail(root)): r.sha256 for r in rows.collect()}


def write_packet(pairs: DataFrame, path: str, metadata: dict) -> None:
    """Labelled feature rows by partition, and a manifest with counts and the SHA-256 of every file."""
    spark = pairs.sparkSession
    publish(pairs, f"{path}/pairs", lambda d, p: d.write.partitionBy("partition").parquet(p))
    counts = {r["partition"]: r["n"] for r in spark.read.parquet(f"{path}/pairs").groupBy("partition").agg(F.count("*").alias("n")).collect()}
    write_text(spark, f"{path}/metadata.json", json.dumps(metadata | {"pairs": counts, "files": file_digests(spark, f"{path}/pairs")}, sort_keys=True))


def read_packet(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows and the manifest of a packet; a file that is missing, new or changed raises a ValueError."""
    metadata = json.loads(spark.read.text(f"{path}/metadata.json", wholetext=True).first()[0])
    found = file_digests(spark, f"{path}/pairs")
    wrong = sorted(name for name in found.keys() | metadata["files"].keys() if found.get(name) != metadata["files"].get(name))
    if wrong:
        raise ValueError(f"packet files differ from the manifest: {wrong[:5]}")
    return spark.read.parquet(f"{path}/pairs"), metadata
