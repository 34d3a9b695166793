"""Seeded bijections of row numbers, and the plan of permutation importance."""

import pytest
from pyspark.sql import functions as F

from residuum.operators.ordering import shuffled_index
from residuum.plans import model as M


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 101, 1000, 9973])
def test_every_copy_is_a_permutation(spark, n):
    base = spark.range(n).select(F.col("id").alias("_i"), (F.col("id") * 2.0).alias("x"), (F.col("id") % 7).alias("y"))
    perm = M.permuted_values(base, ["x", "y"], n, 3, seed=11)
    per = perm.groupBy("_f", "_r").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_i").alias("d"), F.min("_i").alias("lo"), F.max("_i").alias("hi"),
                                       F.count_if((F.col("_f") == 0) & (F.col("_v") == F.col("_i") * 2)).alias("fixed")).collect()
    assert len(per) == 6 and all((r.n, r.d, r.lo, r.hi) == (n, n, 0, n - 1) for r in per)
    if n >= 1000:                                                             # about one fixed point is expected
        assert all(r.fixed <= 12 for r in per)
        a, b = ([r._i for r in perm.where(f"_f = 0 AND _r = {k}").orderBy("_v").collect()] for k in (0, 1))
        assert sum(x == y for x, y in zip(a, b)) <= 12                        # repeats differ
        assert sum(abs(x - y) == 1 for x, y in zip(a, a[1:])) <= 20           # neighbours part


def test_plan_of_the_copies_has_no_sort(spark):
    base = spark.range(1000).select(F.col("id").alias("_i"), F.rand(1).alias("x"))
    perm = M.permuted_values(base, ["x"], 1000, 10)
    plan = perm.join(base.hint("shuffle_hash"), "_i")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortMerge", "") and "rangepartitioning" not in plan
