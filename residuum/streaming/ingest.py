"""Resumable ingest and keep-best upsert.

The original resumes a crawl from a JSON list of processed seed ids and
appends scraped rows to one parquet file. Here:

* batch form — ``pending_seeds`` is a ``left_anti`` join of seeds against the
  ledger; ``ledger_union`` adds newly processed ids; ``commit_batch`` publishes a
  batch's rows and its processed ids, failed ones included, in one step, so a job
  that dies between the two writes leaves neither;
* stream form — new record files arrive in a folder; a Structured Streaming
  query with a checkpoint in the shared folder picks up only unseen files
  (``trigger(availableNow=True)`` processes the backlog and stops), and
  ``foreachBatch`` writes each micro-batch idempotently keyed by ``batch_id``.
  A rerun with the same checkpoint adds nothing; a failed batch is retried.
  The keep-best table is a set of sorted runs: a batch writes only its own
  winners, readers merge the runs, and compaction merges runs of similar size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.operators.features import dedup_best
from residuum.sources import scan as SC
from residuum.streaming import runs as R


def pending_seeds(seeds: DataFrame, ledger: DataFrame, key: str = "seed_id") -> DataFrame:
    """Seeds not yet in the ledger (anti join; the ledger side is deduplicated first)."""
    return seeds.join(ledger.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def ledger_union(ledger: DataFrame, new_ids: DataFrame, key: str = "seed_id") -> DataFrame:
    return ledger.select(key).unionByName(new_ids.select(key)).distinct()


def ingest_stream(spark: SparkSession, source_dir: str, schema: T.StructType, sink_root: str,
                  checkpoint: str, fmt: str = "parquet", max_files_per_trigger: int | None = None):
    """Append every new file under ``source_dir`` to versioned parquet under ``sink_root``.

    Runs the available backlog and returns the finished query. Each batch is
    written to ``sink_root/batch=<id>`` with overwrite, so a replayed batch
    rewrites the same files instead of duplicating them.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)

    def write(batch: DataFrame, batch_id: int):
        batch.select(*schema.fieldNames()).write.mode("overwrite").parquet(f"{sink_root.rstrip('/')}/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_ingested(spark: SparkSession, sink_root: str, schema: T.StructType) -> DataFrame:
    if not SC.path_exists(spark, sink_root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(sink_root).select(*schema.fieldNames())


LEDGER = "seed_id bigint, status string"


def commit_batch(spark: SparkSession, root: str, batch: str, rows: DataFrame, ids: DataFrame) -> bool:
    """Publish the rows of a batch and its ``ids(seed_id, status)`` together; False (nothing written) if ``batch`` is published.

    Ids of failed seeds belong in ``ids`` too, so that they are not taken again.
    """
    if any(e["name"] == batch for e in R.entries(spark, root)):
        return False
    folders = {"rows": R.new_folder(root, "rows"), "ids": R.new_folder(root, "ids")}
    rows.write.parquet(folders["rows"])
    ids.select(F.col("seed_id").cast("bigint").alias("seed_id"), F.col("status").cast("string").alias("status")).distinct().write.parquet(folders["ids"])
    return R.publish(spark, root, batch, [{"kind": k, "path": p} for k, p in folders.items()])


def committed_rows(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return R.read_live(spark, root, "rows", schema)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """``seed_id, status`` of every processed seed."""
    return R.read_live(spark, root, "ids", LEDGER)


def _write_run(spark: SparkSession, root: str, df: DataFrame, key: str, level: int) -> dict:
    """``df`` as a new sorted run: files are ranges of the key, as many as their bytes ask for."""
    path = R.new_folder(root, "runs")
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(path)
    return {"kind": "run", "path": path, "level": level, "rows": spark.read.parquet(path).count()}


def _compact(spark: SparkSession, root: str, schema: T.StructType, key: str, order: str, tiebreak: str, fan_in: int, name: str) -> None:
    """Merge ``fan_in`` runs of a level into one of the next, from the lowest level up: a row is rewritten once per level."""
    level = 0
    while True:
        runs = R.live(spark, root, "run")
        if level > max((r["level"] for r in runs), default=-1):
            return
        full = [r["path"] for r in runs if r["level"] == level]
        if len(full) >= fan_in:
            merged = dedup_best(spark.read.schema(schema).parquet(*full), key, order, tiebreak)
            R.publish(spark, root, f"{name}-merge-{level}", [_write_run(spark, root, merged, key, level + 1)], full)
        level += 1


def read_best(spark: SparkSession, root: str, schema: T.StructType, key: str = "name", order: str = "review_count",
              tiebreak: str = "venue_id") -> DataFrame:
    """The keep-best table: the best row of each key over the live runs (one partial aggregate)."""
    return dedup_best(R.read_live(spark, root, "run", schema), key, order, tiebreak)


def stream_dedup_best(spark: SparkSession, source_dir: str, schema: T.StructType, table_root: str,
                      checkpoint: str, key: str = "name", order: str = "review_count",
                      tiebreak: str = "venue_id", fmt: str = "parquet", max_files_per_trigger: int | None = None,
                      fan_in: int = 4):
    """Keep-best-per-key table maintained across micro-batches, as sorted runs.

    A micro-batch writes one run with its own winners and publishes it under the
    batch's number, so what it writes is in proportion to the batch and a replay
    changes nothing. When ``fan_in`` runs stand at a level they are merged into one
    of the next; with n batches a row is rewritten about log(n) / log(fan_in) times.
    Replaced runs stay until ``runs.vacuum``. Readers use ``read_best``.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def merge(batch: DataFrame, batch_id: int):
        session, name = batch.sparkSession, f"batch-{batch_id}"
        if not any(e["name"] == name for e in R.entries(session, table_root)):
            winners = dedup_best(batch.select(*schema.fieldNames()), key, order, tiebreak)
            R.publish(session, table_root, name, [_write_run(session, table_root, winners, key, 0)])
        _compact(session, table_root, schema, key, order, tiebreak, fan_in, name)

    q = (reader.load(source_dir).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
