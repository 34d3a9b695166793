"""Stage tables in the shared folder, and the input convention of the operators.

Input convention, the same for every operator here: ``docs`` may carry any other
columns under any names; only the named id and text columns are read. A null
text counts as empty. A row whose id is null can't be named in a result and is
left out (packing keeps it). The id identifies the text: rows that repeat an id with the same text
each get the result of that document.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from residuum.session import shared_path

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def every_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id bigint, text string)``: null texts empty, null ids kept."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id bigint, text string)``: null texts empty, rows without an id left out."""
    return every_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull())


def one_text(docs: DataFrame) -> DataFrame:
    """One row for each id of ``docs(doc_id, text, ...)``; an id with two different texts raises, as its results would be mixed up."""
    h = F.xxhash64("text")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.groupBy("doc_id").agg(F.first("text").alias("text"), *(F.first(c).alias(c) for c in others), F.min(h).alias("_low"), F.max(h).alias("_high"))
    wrong = F.raise_error(F.concat(F.lit("two different texts have doc_id "), F.col("doc_id").cast("string")))
    return rows.select("doc_id", F.when(F.col("_low") == F.col("_high"), F.col("text")).otherwise(wrong.cast("string")).alias("text"), *others)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and return the table read back.

    Lineage ends here, so a lost executor costs a re-read of files every executor
    can reach. The shuffle files of the write go when it ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._stage_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_held: list = []


def hold(broadcast):
    """``broadcast``, to be destroyed by the next :func:`release` (when all rows that use it are written)."""
    _held.append(broadcast)
    return broadcast


def give_back() -> None:
    """Return memory that the driver's Python has freed to the system: a stage should not start on top of the one before."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it trims by itself or not at all
        pass


def release() -> None:
    """Destroy the broadcasts of earlier stages and give memory back. Call it when their results have been written."""
    while _held:
        _held.pop().destroy()
    give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
