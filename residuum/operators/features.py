"""Frequency features, keep-best dedup and bucketing.

Group statistics are computed with ``groupBy`` (partial aggregation on the map
side) and joined back, never with an unordered window: a window puts a whole
group into one task, which a name or category holding a third of all rows
would turn into a single straggler. The joined-back side has one row per key,
so AQE can split a skewed probe partition or broadcast the small side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K


def is_chain(df: DataFrame, name: str = "name", out: str = "is_chain",
             min_count: int = K.CHAIN_MIN_COUNT) -> DataFrame:
    """``count(name) > min_count`` for each row; NULL names are never chains."""
    counts = (df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("_k"))
                .agg(F.count(F.lit(1)).alias("_c")))
    j = df.join(counts, df[name] == counts["_k"], "left")
    return j.withColumn(out, F.coalesce(F.col("_c") > min_count, F.lit(False))).drop("_k", "_c")


def value_counts(df: DataFrame, column: str, out: str = "count") -> DataFrame:
    """Counts per non-null value, most frequent first (ties by value)."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count(F.lit(1)).alias(out))
              .orderBy(F.desc(out), F.asc(column)))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent non-null values (TakeOrderedAndProject over the counts)."""
    return value_counts(df, column).limit(k).select(column)


def top_category_bucket(df: DataFrame, column: str = "category", out: str = "category_encoded",
                        k: int = K.TOP_CATEGORIES, other: str = K.OTHER) -> DataFrame:
    """Keep the k most frequent values, everything else (NULL included) → ``other``.

    The membership side has at most k rows — a proven bound — so it is broadcast.
    """
    top = F.broadcast(top_values(df, column, k).select(F.col(column).alias("_top")))
    j = df.join(top, df[column] == top["_top"], "left")
    return j.withColumn(out, F.when(F.col("_top").isNotNull(), F.col(column)).otherwise(F.lit(other))) \
            .drop("_top")


def dedup_best(df: DataFrame, key: str = "name", order: str = "review_count",
               tiebreak: str = "venue_id") -> DataFrame:
    """One row per ``key``: highest ``order`` (NULLs last), ties to the smallest ``tiebreak``.

    NULL keys form one group. ``max_by`` is a partial aggregate, so each map
    task reduces its share of a hot key to one row before the shuffle.
    """
    cols = df.columns
    rank = F.struct(F.col(order).isNotNull().alias("a"), F.col(order).alias("b"),
                    (-F.col(tiebreak)).alias("c"))
    return (df.groupBy(F.col(key).alias("_k"))
              .agg(F.max_by(F.struct(*cols), rank).alias("_r"))
              .select("_r.*"))


def add_features(df: DataFrame) -> DataFrame:
    """log_reviews and price_level_num (pure projections)."""
    return df.withColumns({"log_reviews": C.log_reviews("review_count"),
                           "price_level_num": C.price_level_num("price_level")})
