"""File sources. Malformed input raises an error when it is read; nothing is inferred."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kinmatch.functions.text import parse_ids
from kinmatch.sources.records import SOURCE_COLUMNS, TRUTH_COLUMNS, text_schema

#: The files of a data set, in order.
DATASET_FILES = ("train/source_1.tsv", "train/source_2.tsv", "train/source_3.tsv", "test/source_1.tsv", "test/source_2.tsv", "test/source_3.tsv", "train/ground_truth.tsv")


def dataset_paths(root: str) -> list[str]:
    return [f"{root.rstrip('/')}/{f}" for f in DATASET_FILES]


def read_tsv(spark: SparkSession, path: str | list[str], columns: Sequence[str] = SOURCE_COLUMNS) -> DataFrame:
    """A TSV with quotes, quoted line ends and a header equal to columns; empty fields are empty strings. Gzip is read too.

    A row with too few or too many fields, or another header, raises an error.
    """
    schema = StructType([*text_schema(tuple(columns)).fields, StructField("_bad", StringType(), True)])
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True, enforceSchema=False, quote='"', escape='"', multiLine=True, columnNameOfCorruptRecord="_bad", mode="PERMISSIVE", encoding="UTF-8")
    checked = rows.where(F.when(F.col("_bad").isNotNull(), F.raise_error(F.concat(F.lit("malformed row: "), "_bad")).cast("boolean")).otherwise(True))
    return checked.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def preview(spark: SparkSession, path: str, limit: int = 5, columns: Sequence[str] = SOURCE_COLUMNS) -> DataFrame:
    """The first rows of one file, not a sample."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return read_tsv(spark, path, columns).limit(limit)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """reference_id, ids: a truth file with its lists parsed; an invalid or repeated id raises an error."""
    rows = read_tsv(spark, path, TRUTH_COLUMNS)
    return rows.select(F.col(TRUTH_COLUMNS[0]).alias("reference_id"), parse_ids(F.col(TRUTH_COLUMNS[1])).alias("ids"))


def read_raw_truth(spark: SparkSession, path: str, wanted: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """reference_id, ids of a truth file without quoting: lines cut at the tab, lists at commas.

    wanted: reference_id of the rows to keep; with strict, one that the file lacks raises an error.
    """
    lines = spark.read.text(path).where(~F.lower("value").startswith(TRUTH_COLUMNS[0])).where("value <> ''")
    cut = F.split("value", "\t", 2)
    rest = F.coalesce(F.get(cut, F.lit(1)), F.lit(""))
    rows = lines.select(F.get(cut, F.lit(0)).alias("reference_id"), F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, ",")).alias("ids"))
    if wanted is None:
        return rows
    if not strict:
        return rows.join(wanted.select("reference_id"), "reference_id", "left_semi")
    out = wanted.select("reference_id").join(rows, "reference_id", "left")
    return out.where(F.when(F.col("ids").isNull(), F.raise_error(F.concat(F.lit("no truth for "), "reference_id")).cast("boolean")).otherwise(True))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id: the distinct values of a file's first column, without header and blanks."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("id")).where("trim(id) <> ''").distinct()


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines less the header."""
    return max(0, spark.read.text(path).count() - 1)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a blank or invalid line raises an error that shows it."""
    lines = spark.read.text(path)
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("value", parsed.alias("j"))
    wrong = (F.trim("value") == "") | F.col("j").isNull() | F.col("j._bad").isNotNull()
    checked = rows.where(F.when(wrong, F.raise_error(F.concat(F.lit("invalid JSON line: "), F.substring("value", 1, 80))).cast("boolean")).otherwise(True))
    return checked.select("j.*").drop("_bad")


def invalid_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line_number, value of the lines that read_jsonl() refuses; numbers count from 1 in each file."""

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                lines = content.decode("utf-8", "replace").split("\n")
                lines = lines[:-1] if lines[-1] == "" else lines
                for at in range(0, len(lines), 10_000):
                    some = lines[at : at + 10_000]
                    yield pd.DataFrame({"file": name, "line_number": range(at + 1, at + 1 + len(some)), "value": some})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(numbered, "file string, line_number long, value string")
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return rows.withColumn("j", parsed).where((F.trim("value") == "") | F.col("j").isNull() | F.col("j._bad").isNotNull()).drop("j")


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """value: the elements of a file that is one JSON array of strings."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("value"))


def read_zip_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """member, line_number, value: text lines of the members of ZIP files whose names end in suffix."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(suffix):
                            with z.open(name) as f:
                                text = io.TextIOWrapper(f, "utf-8-sig")
                                while some := list(enumerate_lines(text, 10_000)):
                                    yield pd.DataFrame({"member": name, "line_number": [n for n, _ in some], "value": [v for _, v in some]})

    def enumerate_lines(text, most: int):
        start = getattr(text, "kinmatch_line", 0)
        for n in range(most):
            line = text.readline()
            if not line:
                return
            text.kinmatch_line = start + n + 1
            yield start + n + 1, line.rstrip("\n")

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "member string, line_number long, value string")


def attach(spark: SparkSession, **tables: DataFrame) -> None:
    """Names tables for SQL across them; views read, and never write."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
