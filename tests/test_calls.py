"""The external classifier: pacing of all callers together, answers kept by prompt, retried tasks, empty input, default columns."""

import os
import time

import pytest
from pyspark.sql import functions as F

from residuum.operators import classify as CL
from residuum.session import ensure_checkpoint_dir, shared_path


def _prompts(spark, n):
    return spark.range(n).select(F.col("id").alias("batch_id"), F.concat(F.lit("p"), "id").alias("prompt")).repartition(4)


def _logging(spark, name, before=lambda prompt, folder: None):
    """A service that notes every call in a folder all local tasks see."""
    folder = shared_path(spark, name)
    os.makedirs(folder)

    def fn(prompt):
        before(prompt, folder)
        with open(f"{folder}/{prompt}-{time.time():.6f}-{os.getpid()}", "w"):
            pass
        return prompt.upper()
    return fn, lambda: sorted((float(f.rsplit("-", 2)[1]), f.rsplit("-", 2)[0]) for f in os.listdir(folder))


def test_all_callers_together_keep_the_rate(spark):
    fn, calls = _logging(spark, "t_pace")
    out = CL.call_classifier(_prompts(spark, 12), fn, parallelism=4, calls_per_minute=240)      # one in 0.25 s
    assert {r.batch_id: r.response for r in out.collect()} == {i: f"P{i}" for i in range(12)}
    at = [t for t, _ in calls()]
    assert len(at) == 12
    assert at[-1] - at[0] >= 11 * 0.25 - 0.2
    for i in range(len(at) - 4):                                              # no five calls in the time of three
        assert at[i + 4] - at[i] >= 0.5


def test_answers_are_kept_by_prompt(spark):
    fn, calls = _logging(spark, "t_kept")
    store = shared_path(spark, "t_store")
    CL.call_classifier(_prompts(spark, 5), fn, parallelism=3, store=store)
    again = CL.call_classifier(_prompts(spark, 8), fn, parallelism=3, store=store)
    assert again.count() == 8 and len(calls()) == 8
    same = spark.createDataFrame([(0, "p0"), (1, "p0")], "batch_id long, prompt string")        # one prompt twice: one call
    assert CL.call_classifier(same, fn, parallelism=2, store=store).count() == 2 and len(calls()) == 8


def test_waves_grow_while_calls_are_quick(spark):
    folder, store = shared_path(spark, "t_waves"), shared_path(spark, "t_wave_store")
    os.makedirs(folder)

    def fn(prompt):
        open(f"{folder}/busy-{prompt}", "w").close()
        time.sleep(0.02)
        open(f"{folder}/{sum(f.startswith('busy') for f in os.listdir(folder))}-{prompt}", "w").close()
        os.remove(f"{folder}/busy-{prompt}")
        return prompt.upper()
    out = CL.call_classifier(_prompts(spark, 60), fn, parallelism=4, store=store)
    assert {r.batch_id: r.response for r in out.collect()} == {i: f"P{i}" for i in range(60)}
    assert len(os.listdir(folder)) == 60 and max(int(f.split("-")[0]) for f in os.listdir(folder)) <= 4   # calls at a time
    assert len(os.listdir(store)) == 4                                          # waves of 4, 8, 16 and 32 calls


def test_errors_are_called_again_and_back_off(spark):
    def fail_once(prompt, folder):
        if prompt == "p2" and not os.path.exists(f"{folder}/failed"):
            open(f"{folder}/failed", "w").close()
            raise RuntimeError("service down")
    fn, _ = _logging(spark, "t_errors", fail_once)
    store, started = shared_path(spark, "t_error_store"), time.time()
    first = CL.call_classifier(_prompts(spark, 6), fn, parallelism=3, store=store, back_off=2.0)
    assert {r.batch_id for r in first.where("error").collect()} == {2} and time.time() - started >= 2.0
    assert CL.call_classifier(_prompts(spark, 6), fn, parallelism=3, store=store).where("error").count() == 0


def test_the_service_limits_must_be_said_and_nothing_is_called_for_nothing(spark):
    fn, calls = _logging(spark, "t_nothing")
    with pytest.raises(ValueError):
        CL.call_classifier(_prompts(spark, 1), fn)
    assert CL.call_classifier(_prompts(spark, 0), fn, calls_per_minute=10).count() == 0
    df = spark.createDataFrame([("a", "Thai"), ("b", None)], "name string, category string")
    assert {r.name: r.category for r in CL.batch_inference(df, fn, calls_per_minute=10).collect()} == {"a": "Thai", "b": "Other"}
    assert calls() == []


def test_default_columns_of_a_bare_table(spark):
    from residuum.plans.jobs import default_columns
    t = spark.createDataFrame([("a", 3), ("a", None), ("a", 5), ("b", 7)], "name string, review_count long")
    rows = default_columns(t).collect()
    assert {(r.name, r.is_chain, r.cluster_density) for r in rows} == {("a", True, 10), ("b", False, 10)}
    assert min(r.log_reviews for r in rows) == 0.0
    kept = default_columns(t.withColumns({"cluster_density": F.lit(3), "is_chain": F.lit(False), "log_reviews": F.lit(1.0)}))
    assert {(r.is_chain, r.cluster_density, r.log_reviews) for r in kept.collect()} == {(False, 3, 1.0)}
