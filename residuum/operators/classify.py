"""Keyword classification and batched external labelling.

Keyword scoring is a projection: a short lexicon is compiled into one
``contains`` term per keyword, a longer one (more terms than generated code
takes well) into an automaton that walks each text once (``automaton.py``); the
scores are summed per label and the best label picked with ``array_max`` over
(score, -order) — no join, no shuffle, streaming-safe. The external classifier is the only Python
boundary: prompts are built by Spark, sent in Arrow batches through
``mapInPandas`` to a caller-supplied function, and the answers are parsed,
validated and matched back with built-in expressions and joins.
"""

from __future__ import annotations

import math
import time
import uuid
from typing import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residuum.session import materialize, shared_path
from residuum.functions import constants as K
from residuum.operators.automaton import automaton_label
from residuum.operators.ordering import global_row_number
from residuum.sources.scan import path_exists

MAX_TERMS = 64          # terms of a lexicon that go into one generated expression


# ---------------------------------------------------------------------------
# P14 — keyword scores
# ---------------------------------------------------------------------------

def keyword_scores(text: Column, lexicon: dict[str, list[str]]) -> list[tuple[str, Column]]:
    """Per label: Σ len(keyword) over keywords contained in lower(text) (duplicates count twice)."""
    low = F.lower(text)
    out = []
    for label, words in lexicon.items():
        terms = [F.when(low.contains(w), F.lit(len(w))).otherwise(F.lit(0)) for w in words]
        s = terms[0]
        for t in terms[1:]:
            s = s + t
        out.append((label, F.coalesce(s, F.lit(0))))
    return out


def keyword_label(text: Column, lexicon: dict[str, list[str]], other: str = K.OTHER) -> Column:
    """Highest-scoring label; ties go to the label listed first; no hit (or NULL/empty) → ``other``."""
    if sum(map(len, lexicon.values())) > MAX_TERMS:
        return automaton_label(text, lexicon, other)
    cands = [F.struct(score.alias("s"), F.lit(-i).alias("o"), F.lit(label).alias("l"))
             for i, (label, score) in enumerate(keyword_scores(text, lexicon))]
    best = F.array_max(F.array(*cands))
    return F.when(best["s"] > 0, best["l"]).otherwise(F.lit(other))


def keyword_classify(df: DataFrame, lexicon: dict[str, list[str]], text: str = "name",
                     out: str = "category", other: str = K.OTHER) -> DataFrame:
    return df.withColumn(out, keyword_label(F.col(text), lexicon, other))


# ---------------------------------------------------------------------------
# P15 — prompt batches
# ---------------------------------------------------------------------------

def leftover_names(df: DataFrame, category: str = "category", name: str = "name",
                   other: str = K.OTHER) -> DataFrame:
    """Distinct non-null names whose category is ``other`` (filter before distinct)."""
    return df.where(F.col(category) == other).where(F.col(name).isNotNull()).select(name).distinct()


def prompt_batches(names: DataFrame, name: str = "name", batch_size: int = K.BATCH_SIZE,
                   template: str = K.PROMPT_TEMPLATE, labels: list[str] = K.CUISINE_LABELS) -> DataFrame:
    """(batch_id, pos, name) members and per batch the prompt text.

    Names are numbered in sorted order without a single-task window; each batch
    holds at most ``batch_size`` names, so collecting a batch is bounded.
    """
    numbered = global_row_number(names.select(F.col(name).alias("name")), ["name"], out="rn")
    members = numbered.select(((F.col("rn") - 1) / batch_size).cast("bigint").alias("batch_id"),
                              ((F.col("rn") - 1) % batch_size).cast("int").alias("pos"), "name")
    head, tail = template.split("{names}")
    head = head.replace("{categories}", ", ".join(labels))
    batches = (members.groupBy("batch_id")
               .agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("_m"))
               .select("batch_id", F.size("_m").alias("n_names"),
                       F.transform("_m", lambda m: m["name"]).alias("names")))
    prompt = F.concat(F.lit(head), F.array_join(F.transform("names", lambda n: F.concat(F.lit("- "), n)), "\n"),
                      F.lit(tail))
    return members, batches.withColumn("prompt", prompt)


# ---------------------------------------------------------------------------
# P16 / P17 — parse and validate answers
# ---------------------------------------------------------------------------

def strip(c: Column) -> Column:
    """Without the white space (tab and carriage return too) at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def response_parse(responses: DataFrame, text: str = "response") -> DataFrame:
    """Lines containing a pipe → (batch_id, line_no, name, raw_category).

    name = field 0 trimmed, then leading '-'/' ' stripped; category = field 1
    trimmed; further fields are ignored.
    """
    lines = responses.select("batch_id", F.posexplode(F.split(strip(F.col(text)), "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("line").contains("|"))
    parts = F.split(F.col("line"), r"\|")
    return lines.select("batch_id", "line_no",
                        F.regexp_replace(strip(parts[0]), r"^[- ]+", "").alias("name"),
                        strip(parts[1]).alias("raw_category"))


def label_validate(c: Column, labels: list[str] = K.CUISINE_LABELS, other: str = K.OTHER) -> Column:
    """Exact label, else the first label (list order) contained case-insensitively, else ``other``."""
    exact = F.when(c.isin(*labels), c)
    low = F.lower(c)
    sub = None
    for lab in labels:
        cond = low.contains(lab.lower())
        sub = F.when(cond, F.lit(lab)) if sub is None else sub.when(cond, F.lit(lab))
    return F.coalesce(exact, sub, F.lit(other))


# ---------------------------------------------------------------------------
# J9 / J6 — match answers back, apply
# ---------------------------------------------------------------------------

def fuzzy_match(parsed: DataFrame, members: DataFrame, prefix: int = K.MATCH_PREFIX_CHARS) -> DataFrame:
    """Original name per answer line, then one category per original name.

    A line matches an original of its batch when the original starts with the
    first ``prefix`` characters of the returned name or contains it (case-
    insensitive); the first original in batch order wins, and a later line for
    the same original overwrites an earlier one. Batches are ≤ ``batch_size``
    rows, so the equi-join on batch_id is bounded per line.
    """
    m = members.select("batch_id", "pos", F.col("name").alias("orig"))
    ln, lo = F.lower(F.col("name")), F.lower(F.col("orig"))
    j = parsed.join(m, "batch_id").where(lo.startswith(F.substring(ln, 1, prefix)) | lo.contains(ln))
    per_line = j.groupBy("batch_id", "line_no").agg(
        F.min_by("orig", "pos").alias("orig"), F.first("category").alias("category"))
    return (per_line.groupBy("orig").agg(F.max_by("category", F.struct("batch_id", "line_no")).alias("category"))
                    .withColumnRenamed("orig", "name"))


def apply_labels(df: DataFrame, mapping: DataFrame, category: str = "category", name: str = "name",
                 other: str = K.OTHER) -> DataFrame:
    """Rows labelled ``other`` take the mapped label; unmatched and NULL stay/become ``other``."""
    mp = mapping.select(F.col("name").alias("_n"), F.col("category").alias("_c"))
    j = df.join(mp, df[name] == mp["_n"], "left")
    new = F.when(F.col(category) == other, F.coalesce(F.col("_c"), F.lit(other))) \
           .otherwise(F.coalesce(F.col(category), F.lit(other)))
    return j.withColumn(category, new).drop("_n", "_c")


# ---------------------------------------------------------------------------
# M8 — batch inference through a caller-supplied function
# ---------------------------------------------------------------------------

ANSWERS = "prompt_id string, response string, error boolean, at double"
WAVE_SECONDS = 30       # a wave of calls that took less may be followed by one twice as large


def call_classifier(batches: DataFrame, fn: Callable[[str], str], parallelism: int | None = None,
                    calls_per_minute: float | None = None, store: str | None = None, back_off: float = 5.0) -> DataFrame:
    """(batch_id, response, error) for every prompt; ``fn`` maps prompt text → answer text.

    What the service allows must be said: ``parallelism`` (most calls at a time), ``calls_per_minute`` (of all callers
    together), or both. Prompts go out in waves. A wave is one Spark job of up to ``parallelism`` (or a minute's) tasks with
    one call each. With ``parallelism`` alone a task makes twice as many calls, one after another, in each further wave while
    waves without errors end within ``WAVE_SECONDS``: the waves then grow with the time the calls take, not with the prompts.
    With a rate, the call with number k of a wave starts no earlier than k intervals after the wave, and the next wave no
    earlier than the wave's intervals have passed, counted from when its calls were made, whatever executors, retries or
    stalls do. A failing call marks its batch as an error
    (its names become ``Other``); the next wave is one call per task again and waits ``back_off`` seconds, twice as long
    after each further wave with errors.

    Answers are kept by the hash of the prompt in the folder ``store`` (default: a new one in the shared folder), one
    write per wave: a rerun with the same store calls only what has no answer yet, and a lost task repeats its own calls
    of the wave alone. Errors are not kept.
    """
    if not parallelism and not calls_per_minute:
        raise ValueError("state what the service allows: parallelism or calls_per_minute")
    spark = batches.sparkSession
    store = store or shared_path(spark, "answers")
    size = int(parallelism or max(1, math.floor(calls_per_minute)))
    interval = 60.0 / calls_per_minute if calls_per_minute else 0.0
    prompts = batches.select("batch_id", "prompt", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_id"))
    todo = prompts.groupBy("prompt_id").agg(F.min("batch_id").alias("first"), F.first("prompt").alias("prompt"))
    if path_exists(spark, store):
        todo = todo.join(spark.read.schema(ANSWERS).parquet(f"{store}/*").where("NOT error"), "prompt_id", "left_anti")
    pending = shared_path(spark, "prompts")
    global_row_number(todo, ["first", "prompt_id"], out="n").write.parquet(pending)     # in the order of n: a wave reads its own part
    todo = spark.read.parquet(pending)
    left, done, rounds, start, wave, misses, run = todo.count(), 0, 1, 0.0, 0, 0, uuid.uuid4().hex
    while done < left:
        wait = time.time() + (back_off * 2 ** (misses - 1) if misses else 0.0)
        time.sleep(max(0.0, max(start, wait) - time.time()))
        begun, calls = time.time(), min(size * rounds, left - done)
        k = F.col("n") - 1 - done
        mine = todo.where((F.col("n") > done) & (F.col("n") <= done + calls)).select("prompt_id", "prompt", k.cast("int").alias("slot"))
        path = f"{store}/{run}-{wave:08d}"
        (mine.repartitionById(min(size, calls), F.col("slot") % size).sortWithinPartitions("slot")
         .mapInPandas(_caller(fn, begun, interval), ANSWERS).write.mode("overwrite").parquet(path))
        misses = 0 if spark.read.schema(ANSWERS).parquet(path).where("error").isEmpty() else misses + 1
        rounds = 1 if misses or interval else rounds * 2 if time.time() - begun < WAVE_SECONDS else rounds
        done, wave, start = done + calls, wave + 1, begun + calls * interval
        if interval:            # calls that came late, and then together, count from when they were made
            made = sorted(r.at for r in spark.read.schema(ANSWERS).parquet(path).select("at").collect())
            start = max([start, *(t + (calls - i) * interval for i, t in enumerate(made))])
    if not path_exists(spark, store):
        return prompts.select("batch_id", F.lit(None).cast("string").alias("response"), F.lit(False).alias("error")).limit(0)
    # a later answer to a prompt that failed before counts
    kept = spark.read.schema(ANSWERS).parquet(f"{store}/*").groupBy("prompt_id").agg(
        F.max("response").alias("response"), F.min("error").alias("error"))
    return prompts.join(kept, "prompt_id").select("batch_id", "response", "error")


def _caller(fn: Callable[[str], str], start: float, interval: float):
    def run(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in it:
            out = []
            for row in pdf.itertuples():
                time.sleep(max(0.0, start + row.slot * interval - time.time()))
                at = time.time()
                try:
                    out.append((row.prompt_id, fn(row.prompt), False, at))
                except Exception:          # the whole batch falls back to Other
                    out.append((row.prompt_id, None, True, at))
            yield pd.DataFrame(out, columns=["prompt_id", "response", "error", "at"])
    return run


def batch_inference(df: DataFrame, fn: Callable[[str], str], category: str = "category",
                    name: str = "name", batch_size: int = K.BATCH_SIZE, parallelism: int | None = None,
                    labels: list[str] = K.CUISINE_LABELS, other: str = K.OTHER, calls_per_minute: float | None = None,
                    store: str | None = None, back_off: float = 5.0) -> DataFrame:
    """Label leftover rows via an external classifier; returns ``df`` with updated categories.

    No leftovers: ``df`` as it is, without a call. See ``call_classifier`` for what the service allows and the store.
    """
    if leftover_names(df, category, name, other).isEmpty():
        return df.withColumn(category, F.coalesce(F.col(category), F.lit(other)))
    members, batches = prompt_batches(leftover_names(df, category, name, other), name, batch_size,
                                      labels=labels)
    # written once: the two branches below must see the same answer, and each prompt is one call
    answers = materialize(call_classifier(batches, fn, parallelism, calls_per_minute, store, back_off))
    parsed = response_parse(answers.where(~F.col("error")))
    parsed = parsed.withColumn("category", label_validate(F.col("raw_category"), labels, other))
    matched = fuzzy_match(parsed, members)
    failed = (members.join(answers.where(F.col("error")).select("batch_id"), "batch_id")
              .select("name", F.lit(other).alias("category")))
    mapping = failed.unionByName(matched.join(failed.select("name"), "name", "left_anti"))
    return apply_labels(df, mapping, category, name, other)
