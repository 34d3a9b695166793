"""Session construction and the shared folder used for lineage cuts and sinks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "residuum",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session with the settings the operators are designed around.

    On a cluster the master, memory and checkpoint folder come from the
    submit environment; here only engine behaviour is configured.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach; it is read from the session and never overridden. Tests and local
    runs without the setting get a fresh temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="residuum-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A path under the shared checkpoint folder (``…/residuum/<parts>/<uuid>``)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    segs = [base, "residuum", *parts]
    if unique:
        segs.append(uuid.uuid4().hex)
    return "/".join(segs) if "://" in base else os.path.join(*segs)


ROWS_PER_TASK = 100_000
TASKS_PER_CORE = 2
FEW_PARTITIONS = 32     # as many are always left as they are


def useful_partitions(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Most partitions that ``rows`` rows need: ``TASKS_PER_CORE`` for each core, more with ``rows_per_task``."""
    return max(FEW_PARTITIONS, TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def materialize(df):
    """Cut lineage: write ``df`` to the shared checkpoint folder once.

    The frame is persisted and counted first so the checkpoint write reuses the
    rows instead of recomputing the plan; the cache is released afterwards. The
    checkpoint (in ``spark.checkpoint.dir``, not the cache) is what later plans
    read, so a lost executor costs a re-read, not a recomputation. (Measured:
    twice as fast as a parquet stage table for the radius count's
    multi-million-row candidate tables.)

    Adaptive execution merges small partitions neither when it fills the cache nor
    when it reads a checkpoint, so the rows are written in as many partitions as
    they ask for (``useful_partitions``), and no more than there are.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = cached.coalesce(useful_partitions(df.sparkSession, cached.count())).checkpoint(eager=True)
    cached.unpersist()
    return out
