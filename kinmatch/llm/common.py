"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.sources.records import table

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a Python worker turns into strings at once; a longer text is a portion of its own.
PORTION = 4 << 20
#: Bytes of labelled texts that the driver holds for fitting.
SAMPLE_BYTES = 128 << 20

_serial = itertools.count()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids whose crc32 is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in slices whose texts have at most `most` bytes together, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def spread_nulls(key: str, by: str, parts: int = 1024) -> Column:
    """A second join key that deals rows with a null key, which join nothing, to many tasks; 0 for all others."""
    return F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(parts))).otherwise(F.lit(0).cast("long"))


def fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns of these names, in upper or lower case."""
    taken = {n.lower() for n in names}
    return df.select(*(f"`{c}`" for c in df.columns if c.lower() not in taken))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def scratch_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; where that is unset, a temporary folder in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="kinmatch-")
            spark.sparkContext.setCheckpointDir(root)
    own = f"{root.rstrip('/')}/kinmatch-{spark.sparkContext.applicationId}"
    if own not in _roots:
        _roots.add(own)
        atexit.register(_forget, spark, own)
    return own


_roots: set[str] = set()


def _forget(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables written to the shared checkpoint folder: lineage ends there, and any executor can read them again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{scratch_root(spark)}/{name}-{next(_serial)}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}-{next(_serial)}"
        df.write.option("compression", "zstd").parquet(at)
        kept = self.spark.read.schema(df.schema).parquet(at)
        kept._kinmatch_path = at
        return kept

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing lazy reads any more."""
        for t in tables:
            if at := getattr(t, "_kinmatch_path", None):
                remove(self.spark, at)


def training_sample(
    docs: DataFrame, marks: DataFrame, mark: str, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES
) -> list[tuple[int, str, int]]:
    """(id, text, label) of labelled rows for fitting: at most most[label] rows of each label, none of them held out.

    The bounds are the documented parameters most and most_bytes: rows are taken in the order of a hash of their id, so
    reruns agree, and each as long as its whole text fits into what is left of its label's equal share of most_bytes.
    Null labels, null ids and ids labelled both ways are left out; of a repeated id the smallest text counts.
    """
    lab = marks.where(F.col(mark).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    lab = lab.groupBy(F.col(id_col).alias("_id")).agg(F.min(mark).alias("_y"), F.max(mark).alias("_z")).where("_y = _z")
    picked = []
    for y in sorted(most):
        picked += [(r[0], y) for r in lab.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most[y]).select("_id").collect()]
    if not picked:
        return []
    kind = marks.schema[id_col].dataType.simpleString()
    wanted = lambda pairs: F.broadcast(docs.sparkSession.createDataFrame([(i,) for i, _ in pairs], f"_id {kind}"))  # noqa: E731  (bounded by most)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    sizes = dict(texts.join(wanted(picked), "_id").groupBy("_id").agg(F.max(F.octet_length("_text"))).collect())
    left = dict.fromkeys(most, most_bytes // len(most))
    fitting = []
    for i, y in picked:
        if i in sizes and sizes[i] <= left[y]:
            left[y] -= sizes[i]
            fitting.append((i, y))
    if not fitting:
        return []
    first = dict(texts.join(wanted(fitting), "_id").groupBy("_id").agg(F.min("_text")).collect())
    return [(i, first[i], y) for i, y in sorted(fitting)]
