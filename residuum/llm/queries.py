"""Registered queries of this subpackage and the DuckDB SQL for them where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from residuum.llm import chat, content_sort, decontaminate, jaccard, packing, periodic, prefix_trie, quality, recompression, secrets, suffix, toxicity, url_cascade
from residuum.llm.staging import table
from residuum.session import shared_path

CHAT_PARTS = 5
QUERIES: dict = {}
SQL: dict = {}

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


@query("op5_decontaminate", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, win.n FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SECRET_SQL = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(A)KIA([A-Z0-9]+)",
    "hex": r"([0-9a-f])([0-9a-f]*)",
}
_SECRET_KEEP = {"assign": "length(v) >= 6", "access": "length(m) >= 20", "hex": "length(m) >= 24"}


def _spans_sql(rank: int, kind: str) -> str:
    p = _SECRET_SQL[kind]
    return f"""SELECT doc_id, {rank} AS r, '{kind}' AS kind, e - length(m) AS s, e FROM (
      SELECT doc_id, i, m, v, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
        SELECT doc_id, unnest(range(len(g))) AS i, unnest(g) AS g, unnest(list_resize(m, len(g))) AS m, unnest(list_resize(v, len(g))) AS v FROM (
          SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', 2) AS v FROM d)))
      WHERE m IS NOT NULL AND {_SECRET_KEEP[kind]}"""


@query("op1_secrets", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_spans_sql(i, k) for i, k in enumerate(_SECRET_SQL))}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
      count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, r) AS spans
      FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)""")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings_by_document(table(spark, sf_dir, "documents"), shared_path(spark, "llm", "secret-ledger"))


@query("op2_exact_dedup", f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {AZ}) AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.duplicate_groups(table(spark, sf_dir, "documents"))


@query("op6_ngram_jaccard", rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)""")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(table(spark, sf_dir, "documents"))


@query("op7_recompression")
def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op9_suffix_array")
def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_chat_format")
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one transcript, parsed into turns. The model trains on conversations whose crc32 modulo ``CHAT_PARTS`` is not 0; the others are held out."""
    held = quality.fold("conv_id", CHAT_PARTS) == 0
    out = chat.parse_conversations(table(spark, sf_dir, "conversations"), keep=~held)
    return out.withColumn("held_out", held)


_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_cascade.RULES)


@query("op11_url_cascade", rf"""
WITH u AS (SELECT row_number() OVER () AS i, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {AZ}), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES {_RULES}),
b AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN b USING (i)""")
def op11_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(table(spark, sf_dir, "pages"), url_cascade.rule_table(spark))


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""


@query("op12_prefix_trie", f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, b, h, least(h, coalesce(base_n, 0)) AS k, least(h, coalesce(base_n, 0)) + greatest(n - h, 0) AS len FROM (
  SELECT conv_id, n, conv_id - ((conv_id % 5) + 5) % 5 AS b, {_CRC32.format(x='conv_id')} % 9 AS h FROM n) LEFT JOIN (SELECT conv_id AS b, n AS base_n FROM n) USING (b)),
r AS (SELECT c.conv_id, i AS d, role, text FROM c JOIN t ON t.conv_id = b AND i <= k
      UNION ALL SELECT conv_id, i - h + k, role, text FROM c JOIN t USING (conv_id) WHERE i > h),
p AS (SELECT conv_id, d, text, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r
      UNION ALL SELECT conv_id, 0, '', '' FROM c),
m AS (SELECT conv_id, d, k, text, min(conv_id) OVER w AS node, count(*) OVER w AS n_convs FROM p WINDOW w AS (PARTITION BY d, sha256(k))),
nodes AS (SELECT node, d, n_convs, (n_convs - 1) * strlen(text) AS saved FROM m WHERE conv_id = node),
up AS (SELECT x.node, x.d, y.node AS parent FROM nodes x JOIN m y ON y.conv_id = x.node AND y.d = x.d - 1),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM up GROUP BY ALL),
flat AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node, d)),
sums AS (SELECT m.node, m.d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
         FROM flat JOIN m ON m.conv_id = flat.node AND m.d <= flat.d GROUP BY ALL),
ends AS (SELECT node, d, sha256(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id)) AS e FROM m JOIN c ON c.conv_id = m.conv_id AND len = d GROUP BY ALL)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       coalesce(e, sha256('')) AS ends_sha256
FROM flat JOIN sums USING (node, d) LEFT JOIN up USING (node, d) LEFT JOIN ends USING (node, d)""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_of(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.with_shared_starts(turns, *prefix_trie.shared_start(F.col("conv_id"))))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), rewrite=periodic.periodic_tail)
    best = periodic.greatest_run(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
