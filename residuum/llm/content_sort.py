"""Exact deduplication by content sort, with DataFrame operations only.

Texts are equal when identical after lower-casing A-Z. Spark samples splitters of
the normalised text and range-partitions the rows by it, sorts each range (to
disk where needed), so that equal texts stand next to each other, and the window
over the sorted rows compares whole neighbouring texts: a run of equal ones is a
group, of which the row with the largest (or smallest) id stays. Splitters, which
the driver gets, hold the first ``LEAD`` characters and a hash of the whole text
that orders texts with the same lead; whole texts never leave the executors.

Hot groups. A group with more rows than a quarter of a mean partition is split:
its rows get a salt, which is the second sort key, so splitters fall inside the
group too. There are at most four such groups for each partition, so their
counts are a small table with a known bound. The winners of the salted parts,
one row each, are then compared by whole text once more.

Cases: null text is empty; empty texts equal each other; a row with a null id
stays only if no equal text has an id; of rows that repeat an id one stays;
other columns are carried along and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from residuum.llm.staging import shuffle_partitions, stage

LEAD = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased (``lower`` does just that to a text of ASCII alone)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _runs(docs: DataFrame, id_col: str, text_col: str, largest: bool) -> DataFrame:
    """``row, id, norm, parts, place, best, size`` from the sorted rows: place 1 is the winner of its (part of a) group."""
    spark = docs.sparkSession
    # lower() never tells apart what `normalised` holds equal, so a hot group has a hot key
    key = F.xxhash64(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    counts = docs.select(key.alias("key")).groupBy("key").count()
    mean = 1 + docs.count() // (4 * shuffle_partitions(spark))
    hot = counts.where(F.col("count") > mean).select("key", F.ceil(F.col("count") / mean).cast("int").alias("parts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("id"),
                       normalised(F.col(text_col)).alias("norm"), key.alias("key"))
    rows = (rows.join(F.broadcast(hot), "key", "left")
            .select("row", "id", "norm", F.substring("norm", 1, LEAD).alias("lead"), F.xxhash64("norm").alias("tie"),
                    F.coalesce("parts", F.lit(1)).alias("parts"),
                    F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0)).alias("salt")))
    return _compare(rows.repartitionByRange("lead", "tie", "salt"), ["lead", "tie", "norm", "salt"], largest)


def _compare(rows: DataFrame, keys: list[str], largest: bool) -> DataFrame:
    order = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    run = Window.partitionBy(*keys).orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (rows.withColumn("place", F.row_number().over(run)).withColumn("best", F.first("id").over(whole))
            .withColumn("size", F.count(F.lit(1)).over(whole)))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    found = stage(_runs(slim, "i", "t", largest)
                  .select("id", "best", "size", "place", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
                          F.when((F.col("parts") > 1) & (F.col("place") == 1), F.col("norm")).alias("winner")), "content-sort")
    # the winners of salted parts: a few rows for each of at most 4 x partitions hot groups
    pick = F.max("best") if largest else F.min("best")
    merged = (found.where("winner IS NOT NULL").groupBy("winner").agg(pick.alias("m_best"), F.sum("size").alias("m_size"))
              .select(F.sha2(F.col("winner").cast("binary"), 256).alias("sha"), "m_best", "m_size"))
    keep = F.coalesce("m_best", "best")
    return (found.join(F.broadcast(merged), "sha", "left")
            .select(F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("m_size", "size").cast("bigint").alias("group_size"),
                    ((F.col("place") == 1) & F.col("id").eqNullSafe(keep)).alias("kept"), F.col("sha").alias("text_sha256")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, without a join back."""
    won = stage(_runs(docs, id_col, text_col, largest).where("place = 1").select("row", "id", "norm", "parts"), "content-winners")
    hot = _compare(won.where("parts > 1").select("row", "id", "norm"), ["norm"], largest).where("place = 1")
    return won.where("parts = 1").select("row.*").unionByName(hot.select("row.*"))
