"""Running totals inside groups of any size, without one task for one group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructType

from residuum.llm.staging import shuffle_partitions, stage


def running_totals(df: DataFrame, group: str, order: list[str], values: list[str], name: str) -> DataFrame:
    """``df`` with each of ``values`` replaced by its total over the rows of the group up to this one.

    Rows are range-partitioned by group and order, so a group with very many rows is spread over many tasks; each
    task adds up its own part of each group. Only groups that span tasks need offsets: at most the first and the last
    of each task, so the table of offsets has at most two rows for each partition and is broadcast. Values are
    bigints of 0 and more; rows with equal ``group`` and ``order`` must have equal values or their order is free.
    """
    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, np.zeros(len(values), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = {c: i for i, c in enumerate(batch.schema.names)}
            groups = batch.column(at[group]).to_numpy(zero_copy_only=False)
            first = np.concatenate([[True], groups[1:] != groups[:-1]])
            begin = np.flatnonzero(first)[np.cumsum(first) - 1]
            columns = list(batch.columns)
            same = groups == last if last is not None else np.zeros(len(groups), bool)
            for j, v in enumerate(values):
                own = batch.column(at[v]).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(own)
                total = total - (total - own)[begin] + np.where(same, carry[j], 0)
                columns[at[v]] = pa.array(total)
                carry[j] = total[-1]
            last = groups[-1]
            yield pa.record_batch(columns, names=batch.schema.names)

    keys = [group, *order]
    ranged = (df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
              .withColumn("_part", F.spark_partition_id().cast("bigint")))
    schema = StructType([f if f.name not in values else f.__class__(f.name, LongType()) for f in ranged.schema.fields])
    local = stage(ranged.mapInArrow(add_up, schema), name)
    ends = (local.groupBy("_part").agg(F.min(group).alias("a"), F.max(group).alias("b"))
            .select("_part", F.explode(F.array_distinct(F.array("a", "b"))).alias(group)))
    several = ends.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group))).where("_n > 1").drop("_n")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (local.join(F.broadcast(several), ["_part", group]).groupBy("_part", group).agg(*[F.max(v).alias(f"_{v}") for v in values])
               .select("_part", group, *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values]))
    return (local.join(F.broadcast(offsets), ["_part", group], "left")
            .select(*[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in values else F.col(c) for c in df.columns]))
