"""Secret scan over an incremental blob ledger, with DataFrame operations only.

Every version of a file (here: every document) is content-addressed by the
SHA-256 of its text. The ledger holds the pairs of blob and rule version that
were scanned and the findings. A scan takes only the pairs the ledger lacks,
reads one text for each such blob, appends what it finds, and joins the ledger's
findings back to every path that has the blob. A new rule version therefore
scans each blob once more with that rule alone, and a rerun scans nothing.

Findings are written before the pairs are marked, so a run that dies between the
two is scanned again; findings are read as a set. Only blobs whose text was read
are marked.

Positions are code points. A text is split at the matches; the lengths of pieces
and matches, summed in order, are the positions, so no row-at-a-time code runs.

Cases: null text is the empty blob; rows without an id are left out; a blob that
a third of all rows share is scanned once; an id may have any number of versions;
a text of any length is scanned whole; an empty table gives no rows and leaves the
ledger as it is; other columns, under any names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from residuum.llm.staging import id_text, stage


@dataclass(frozen=True)
class Rule:
    """``group`` must have at least ``least`` code points, or the match is dropped."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns `AKIA[A-Z0-9]+` of 20 and `[0-9a-f]+` of 24 code points and more are runs that end at the same place
# wherever they begin, so the least length can stand in the pattern. That of `assign` can't: a short match uses up its text.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
SCANNED = "blob string, rule string"
FINDINGS = "blob string, rule string, kind string, start bigint, end bigint"


def _ledger(spark, path: str) -> tuple[DataFrame, DataFrame]:
    for name, schema in (("scanned", SCANNED), ("findings", FINDINGS)):
        spark.range(0).selectExpr(*[f"CAST(NULL AS {t}) AS {c}" for c, t in (x.split() for x in schema.split(", "))]) \
            .write.mode("append").parquet(f"{path}/{name}")
    return tuple(spark.read.schema(s).parquet(f"{path}/{n}") for n, s in (("scanned", SCANNED), ("findings", FINDINGS)))


def _matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``blob, todo, text`` to findings, by the rules each blob has to do, and one row with a null rule for each blob read."""
    def found(r: Rule):
        parts = F.arrays_zip(F.split("text", r.pattern, -1).alias("piece"),
                             F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("whole"),
                             F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("value"))
        return F.when(F.array_contains("todo", r.key) & F.col("text").rlike(r.pattern),
                      F.struct(F.lit(r.key).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"),
                               F.transform(parts, lambda x: F.struct(F.length(x["piece"]).alias("gap"), F.length(x["whole"]).alias("size"),
                                                                     F.length(x["value"]).alias("value"))).alias("parts")))
    piece = "array<struct<gap: int, size: int, value: int>>"
    read = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("least"),
                    F.from_json(F.lit("[{}]"), piece).alias("parts"))
    each = texts.select("blob", F.explode(F.array(*[found(r) for r in rules], read)).alias("f")).where("f IS NOT NULL")
    parts = each.select("blob", "f.rule", "f.kind", "f.least", F.posexplode("f.parts").alias("at", "p"))
    upto = Window.partitionBy("blob", "rule").orderBy("at")
    end = F.sum(F.col("p.gap") + F.coalesce("p.size", F.lit(0))).over(upto)
    return (parts.withColumn("end", end).where("rule IS NULL OR (p.size IS NOT NULL AND p.value >= least)")
            .selectExpr("blob", "rule", "kind", "CAST(end - p.size AS BIGINT) AS start", "CAST(end AS BIGINT) AS end"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Bring the ledger at folder ``ledger`` up to date; return ``(paths, findings)``.

    ``paths``: ``doc_id, blob`` of every row; ``findings``: ``blob, kind, start, end`` under these rule versions.
    """
    spark = versions.sparkSession
    scanned, findings = _ledger(spark, ledger)
    docs = id_text(versions, id_col, text_col).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    paths = stage(docs.select("doc_id", "blob"), "blob-paths")
    seen = scanned.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = stage(paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id")).join(seen, "blob", "left")
                 .select("blob", "doc_id", F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
                 .where(F.size("todo") > 0), "blob-todo")
    # a blob of ``todo`` stands beside one id, so this leaves one row for each blob
    texts = docs.join(todo, ["doc_id", "blob"]).dropDuplicates(["doc_id", "blob"]).select("blob", "todo", "text")
    found = stage(_matches(texts, rules).distinct(), "blob-findings")
    found.where("rule IS NOT NULL").write.mode("append").parquet(f"{ledger}/findings")
    (todo.join(found.where("rule IS NULL").select("blob"), "blob", "leftsemi").select("blob", F.explode("todo").alias("rule"))
     .write.mode("append").parquet(f"{ledger}/scanned"))
    now = spark.read.schema(FINDINGS).parquet(f"{ledger}/findings")
    return paths, now.where(F.col("rule").isin([r.key for r in rules])).select("blob", "kind", "start", "end").distinct()


def findings_by_document(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE, **columns: str) -> DataFrame:
    """One row for each row of ``versions``: ``doc_id``, ``n_<kind>`` for each kind, ``base_sha256``, ``spans``.

    ``spans`` is ``kind:start:end`` of all findings by start, then by the order of the rules, comma-joined.
    """
    paths, findings = scan(versions, ledger, rules, **columns)
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    by_blob = findings.groupBy("blob").agg(
        *[F.count(F.when(F.col("kind") == r.kind, 1)).alias(f"n_{r.kind}") for r in rules],
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))),
                                     lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))).alias("spans"))
    out = paths.join(by_blob, "blob", "left")
    spans = F.coalesce("spans", F.lit(""))
    return out.select("doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("bigint").alias(f"n_{r.kind}") for r in rules],
                      F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
