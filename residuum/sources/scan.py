"""Parquet scans and sinks.

Sinks never overwrite the path a lazy plan is reading: every save goes to a new
version directory ``<root>/v=<n>`` and a reader resolves the highest version.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop_fs(spark, path)
    return bool(fs.exists(p))


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a parquet table with a declared schema; a missing path is an empty table."""
    if not path_exists(spark, path):
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def rows_to_table(spark: SparkSession, rows, schema: T.StructType) -> DataFrame:
    """Driver-side records (e.g. one scraped page) → table with a fixed schema."""
    return spark.createDataFrame(list(rows), schema)


def json_records_to_table(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """A column of JSON records (one object per row) → typed columns, on the executors."""
    return df.select(F.from_json(F.col(column), schema).alias("_r")).select("_r.*")


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _hadoop_fs(spark, root)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        n = st.getPath().getName()
        if n.startswith("v=") and n[2:].isdigit() and fs.exists(
                spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(n[2:]))
    return sorted(out)


def latest_version_path(spark: SparkSession, root: str) -> str | None:
    v = _versions(spark, root)
    return f"{root.rstrip('/')}/v={v[-1]}" if v else None


def sink_parquet(df: DataFrame, root: str, version: int | None = None) -> str:
    """Write a full table as a new version under ``root``; returns its path.

    ``version`` makes the write idempotent (a retried job rewrites the same
    version); by default the next free number is used.
    """
    spark = df.sparkSession
    if version is None:
        v = _versions(spark, root)
        version = (v[-1] + 1) if v else 0
    path = f"{root.rstrip('/')}/v={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_latest(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    p = latest_version_path(spark, root)
    if p is None:
        return scan_parquet(spark, os.path.join(root, "v=none"), schema)
    return scan_parquet(spark, p, schema)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Deterministic n-row sample: rows ordered by a seeded hash of the key.

    A top-k (TakeOrderedAndProject) over md5(seed || key): each task keeps only
    its n best rows, so nothing but n rows per task reaches the driver.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")
