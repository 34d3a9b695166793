"""Global numbering, contiguous folds and top-k (W3, P15 numbering, T1-T5).

A global ``row_number()``/``ntile()`` without PARTITION BY runs in a single
task. ``global_row_number`` instead range-partitions on the order key, counts
rows per partition (one small row per partition), turns the counts into
offsets and adds each row's position inside its partition: every task works
on its own range. The per-partition offset table has one row per partition,
so broadcasting it is bounded by the partition count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import constants as K
from residuum.session import materialize


def global_row_number(df: DataFrame, order_cols: list, out: str = "rn",
                      total_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order_cols`` order (the order must be total).

    The range-partitioned, sorted rows are checkpointed to the shared folder
    once, so the per-partition counts and the positions come from the same
    materialised partitioning (and a lost executor cannot reshuffle them).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id()
                            - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    ranged = materialize(ranged)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = (ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
                  .withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
                  .withColumn("_tot", F.sum("_cnt").over(Window.partitionBy())))
    res = ranged.join(F.broadcast(offs), "_pid").withColumn(out, F.col("_off") + F.col("_pos") + 1)
    keep = [out]
    if total_col:
        res = res.withColumnRenamed("_tot", total_col)
        keep.append(total_col)
    return res.select(*df.columns, *keep)


def shuffle_grid(n: int) -> tuple[int, int]:
    """Rows and columns of the grid of ``shuffled_index``."""
    root = math.isqrt(n - 1) + 1
    a = min(range(root, 2 * root + 1), key=lambda k: (k * -(-n // k) - n, k))
    return a, -(-n // a)


def shuffled_index(i: Column, n: int, *seeds: Column, rounds: int = 4) -> Column:
    """A seeded bijection of [0, n): where index ``i`` goes, computed for each row alone, without a sort.

    A Feistel network over a grid of a x b cells just large enough for ``n``: in turn the row is moved by a hash of the
    column and the column by a hash of the row, which can be undone, so the map is one to one. A result outside [0, n) is
    mapped again; it can stay outside only as often as there are cells to spare, and the grid is chosen with few.
    """
    if n < 1:
        return i
    a, b = shuffle_grid(n)
    grid_a, grid_b = F.lit(a).cast("bigint"), F.lit(b).cast("bigint")

    def once(x: Column) -> Column:
        cell = F.struct(F.floor(x / grid_b).alias("r"), F.pmod(x, grid_b).alias("c"))
        moved = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), cell, lambda s, k: F.struct(
            F.when(k % 2 == 0, F.pmod(s["r"] + F.pmod(F.xxhash64(s["c"], k, *seeds), grid_a), grid_a)).otherwise(s["r"]).alias("r"),
            F.when(k % 2 == 1, F.pmod(s["c"] + F.pmod(F.xxhash64(s["r"], k, *seeds), grid_b), grid_b)).otherwise(s["c"]).alias("c")),
            lambda s: s["r"] * grid_b + s["c"])
        return moved
    spare = a * b - n
    first = once(i.cast("bigint"))
    if not spare:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(spare)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))


def fold_of(rn: Column, total: Column, k: int) -> Column:
    """Contiguous fold id (0-based) of 1-based position ``rn`` among ``total`` rows;
    the first ``total % k`` folds are one row larger (the ``ntile`` rule)."""
    i = rn - 1
    q = F.floor(total / k)
    rem = total % k
    big = rem * (q + 1)
    return F.when(i < big, F.floor(i / (q + 1))).otherwise(rem + F.floor((i - big) / q)).cast("int")


def kfold_contiguous(df: DataFrame, order_cols: list, k: int = K.CV_FOLDS, out: str = "fold") -> DataFrame:
    """Unshuffled contiguous folds in ``order_cols`` order (sizes as ``ntile(k)``), 0-based."""
    r = global_row_number(df, order_cols, out="_rn", total_col="_n")
    return r.withColumn(out, fold_of(F.col("_rn"), F.col("_n"), k)).drop("_rn", "_n")


def top_k(df: DataFrame, by: str, k: int, descending: bool = True, tiebreak: str = "venue_id") -> DataFrame:
    """k rows by ``by`` (NULLs excluded), ties by ``tiebreak`` — TakeOrderedAndProject."""
    o = F.desc(by) if descending else F.asc(by)
    return df.where(F.col(by).isNotNull()).orderBy(o, F.asc(tiebreak)).limit(k)
