"""URL filters by a Bloom filter cascade, with DataFrame operations only.

A url's keys are every suffix of its host at a label border joined with every
prefix of its path that is as long as some rule's path. A rule (host, path) is
itself such a key, and it fits a url when it is among the url's keys. So the
question is exact membership of keys in the listed ones, and the universe of keys
that will ever be asked is known: those of the corpus.

A cascade answers it without a join. Level 1 is a Bloom filter of the listed keys.
Level 2 holds the keys of the corpus that level 1 lets through though they are not
listed, level 3 the listed keys that level 2 lets through, and so on until a level
lets nothing through that it should not. A key is in the list when the first level
that stops it is an even one (or when it passes an odd last level).

Size. With ``r`` listed and ``s`` asked keys the first level's rate of false
positives is ``r / (s * sqrt(2))``, so that about ``r`` keys reach level 2: all
levels together take about ``1.44 * r * (log2(s / r) + 3)`` bits, a function of the
list, with only the logarithm of the corpus in it. The size is computed from the
counts before a filter is built. Up to ``max_filter_bytes`` the levels are
constants of the plan (sent once per task); beyond that the keys of the distinct
(host, path) pairs meet the rules in a shuffled equi-join, with the same result.

Passes over the corpus read the url column alone: one counts keys, one writes the
false positives of level 1 (few, distinct), one judges.

Cases: a null url, and one without ``://``, has an empty host and path and no key;
every row gets a row, rows with a null or repeated id too; other columns, of any
name, are not read. A rule needs a host; its path may be empty (any path fits). Of
rules that fit, the one with most characters wins, at equal length the one with
the longer host; a key listed as both blocks. Without a fitting rule the key is
not in the list of blocked ones: ``allow``. An empty list or table is allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from residuum.llm.content_sort import LOWER, UPPER
from residuum.llm.staging import discard, stage

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Fixed values of the query: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bits in a byte of a filter: bytes below 128 are characters of one byte, which built-in functions read in constant time.
WIDTH = 7
CHUNK = 4096
MAX_FILTER_BYTES = 64 << 20


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """``verdict, host, path``."""
    return spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` positions in ``data``, ``hashes`` of them for each key."""

    number: int
    bits: int
    hashes: int
    data: bytes = b""


def _places(key: Column, level: Level) -> tuple[Column, Column]:
    """Start and stride of a key's positions, small enough that no sum of them overflows."""
    start = F.shiftrightunsigned(F.xxhash64(F.lit(level.number), key), 2)
    return start, F.shiftrightunsigned(F.xxhash64(key, F.lit(level.number)), 24).bitwiseOR(F.lit(1).cast("bigint"))


def _passes(key: Column, level: Level) -> Column:
    start, stride = _places(key, level)
    data = F.lit(bytearray(level.data))

    def is_set(i: Column) -> Column:
        at = F.pmod(start + i * stride, F.lit(level.bits).cast("bigint"))
        byte = F.ascii(F.substring(data, F.floor(at / WIDTH).cast("int") + 1, F.lit(1)).cast("string"))
        return F.getbit(byte.cast("bigint"), (at % WIDTH).cast("int")) == 1
    return F.forall(F.sequence(F.lit(0).cast("bigint"), F.lit(level.hashes - 1).cast("bigint")), is_set)


def _shape(number: int, keys: int, rate: float) -> Level:
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    return Level(number, max(64, math.ceil(keys * math.log2(1 / rate) / math.log(2))), hashes)


def _filled(keys: DataFrame, level: Level) -> Level:
    """The level with the bits of ``keys(key)`` set; the driver gets the filter's bytes, no key."""
    start, stride = _places(F.col("key"), level)
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(level.hashes - 1).cast("bigint"))
    at = keys.select(F.explode(F.transform(steps, lambda i: F.pmod(start + i * stride, F.lit(level.bits).cast("bigint")))).alias("at"))
    byte = F.floor(F.col("at") / WIDTH)
    bytes_ = (at.groupBy(F.floor(byte / CHUNK).alias("chunk"), (byte % CHUNK).cast("int").alias("byte"))
              .agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("at") % WIDTH).cast("int"))).alias("v")))
    text = F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda j: F.chr(F.coalesce(F.try_element_at("m", j), F.lit(0))))
    chunks = (bytes_.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("byte", "v"))).alias("m"))
              .select("chunk", F.array_join(text, "").alias("text")))
    data = bytearray((level.bits // WIDTH // CHUNK + 1) * CHUNK)
    for c in chunks.toLocalIterator():
        data[c.chunk * CHUNK:(c.chunk + 1) * CHUNK] = c.text.encode("latin-1")
    return Level(level.number, level.bits, level.hashes, bytes(data))


def first_level(listed: int, asked: int) -> Level:
    return _shape(1, listed, min(0.5, max(2.0 ** -40, listed / (math.sqrt(2) * max(asked, 1)))))


def filter_bytes(listed: int, asked: int) -> int:
    """Bytes that all levels take: level 1 as planned, the others about two bits each for as many keys as are listed."""
    return (first_level(listed, asked).bits + 6 * listed) // WIDTH


def rest_of_cascade(first: Level, listed: DataFrame, leaked: DataFrame) -> list[Level]:
    """The levels after ``first``, a filter of ``listed(key)``; ``leaked(key)`` is what it lets through unlisted."""
    levels, held, other = [first], leaked, listed
    staged = []
    while n := held.count():
        levels.append(_filled(held, _shape(len(levels) + 1, n, 0.5)))
        held, other = stage(other.where(_passes(F.col("key"), levels[-1])), f"cascade-{len(levels)}"), held
        staged.append(held)
    discard(*staged)
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether ``key`` is in the list that ``levels`` encode."""
    inside = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        inside = F.when(_passes(key, level), inside).otherwise(F.lit(level.number % 2 == 0))
    return inside


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _keys(lengths: list[int]) -> Column:
    """``struct(size, host_size, key)`` for every key of a row with ``host`` and ``path``."""
    labels = F.when(F.col("host") != "", F.sequence(F.lit(1), F.size(F.split("host", r"\.", -1)))).otherwise(F.array().cast("array<int>"))
    ends = F.transform(labels, lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    one = lambda h: F.transform(fitting, lambda n: F.struct(
        (F.length(h) + n).alias("size"), F.length(h).alias("host_size"), F.concat(h, F.left(F.col("path"), n)).alias("key")))
    return F.flatten(F.transform(F.filter(ends, lambda h: h != ""), one))


def _judged(found: Column) -> list[Column]:
    best = F.array_max(found)
    return [best["key"].alias("rule"), F.coalesce(best["verdict"], F.lit("allow")).alias("verdict")]


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row for each row of ``pages``: ``page_id, host, path, rule, verdict`` under ``rules(verdict, host, path)``.

    ``rule`` is the host and path of the rule that decides, null if none fits.
    """
    spark = pages.sparkSession
    parts = F.struct(*[c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"))])
    urls = (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
            .select("page_id", parts.alias("p")).select("page_id", "p.host", "p.path"))
    given = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    if not given.where("coalesce(host, '') = '' OR coalesce(verdict, '') NOT IN ('allow', 'block')").isEmpty():
        raise ValueError("a rule needs a host and a verdict, allow or block")
    listed = stage(given.groupBy(F.concat("host", "path").alias("key")).agg(
        F.max("verdict").alias("verdict"), F.max(F.length("path")).alias("length")), "url-rules")
    # the distinct lengths of rule paths, at most as many as the longest path has characters
    lengths = sorted(r.length for r in listed.select("length").distinct().collect())
    sizes = {r.verdict: r["count"] for r in listed.groupBy("verdict").count().collect()}
    keys = _keys(lengths)
    asked = urls.agg(F.sum(F.size(keys)).alias("n")).first().n or 0 if lengths else 0
    if sum(filter_bytes(n, asked) for n in sizes.values()) > max_filter_bytes:
        return _judged_by_join(urls, listed, keys)
    lists = {v: listed.where(F.col("verdict") == v).select("key") for v in sizes}
    firsts = {v: _filled(lists[v], first_level(sizes[v], asked)) for v in sizes}
    cascades = {}
    if firsts:
        asked_keys = urls.select(F.explode(keys).alias("k")).select("k.key").select("key", *[_passes(F.col("key"), level).alias(v) for v, level in firsts.items()])
        through = asked_keys.where(" OR ".join(firsts)).distinct()
        # what a list and the leaked keys have in common is listed: told apart by a flag in one aggregate
        marked = through.unionByName(listed.select("key", *[(F.col("verdict") == v).alias(v) for v in firsts]).withColumn("listed", F.lit(True)), allowMissingColumns=True)
        leaked = stage(marked.groupBy("key").agg(*[F.max(v).alias(v) for v in firsts], *[
            F.max(F.col(v) & F.coalesce("listed", F.lit(False))).alias(f"is_{v}") for v in firsts]), "url-leaked")
        cascades = {v: rest_of_cascade(firsts[v], lists[v], leaked.where(f"{v} AND NOT is_{v}").select("key")) for v in firsts}
        discard(leaked)
    verdict = lambda k: F.coalesce(*[F.when(member(k, cascades[v]), F.lit(v)) for v in ("block", "allow") if v in cascades], F.lit(None).cast("string"))
    found = F.filter(F.transform(keys, lambda k: F.struct(k["size"].alias("size"), k["host_size"].alias("host_size"), k["key"].alias("key"),
                                                          verdict(k["key"]).alias("verdict"))), lambda k: k["verdict"].isNotNull())
    return urls.withColumn("found", found).select("page_id", "host", "path", *_judged(F.col("found")))


def _judged_by_join(urls: DataFrame, listed: DataFrame, keys: Column) -> DataFrame:
    """The same for a list too long for the plan: distinct pairs meet the rules by key, and the pairs' answers the rows."""
    pairs = urls.select("host", "path").distinct()
    hits = (pairs.select("host", "path", F.explode(keys).alias("k")).select("host", "path", "k.*").join(listed.select("key", "verdict"), "key")
            .groupBy("host", "path").agg(F.max(F.struct("size", "host_size", "key", "verdict")).alias("best")))
    return (urls.join(hits, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")))
