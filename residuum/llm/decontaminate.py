"""Benchmark decontamination by winnowing.

Words of a text are runs of letters and digits after lower-casing A-Z. A window
is ``WINDOW`` consecutive words of a benchmark item (an item with fewer words is
one window as a whole); a document word inside any occurrence of a window is hit.

Method. Of each ``WINDOW - GRAM + 1`` consecutive ``GRAM``-word hashes the
smallest is kept (all ties), on either side. Any shared span of ``WINDOW`` words
holds the same hashes on both sides, so both sides keep the same one inside it:
no shared window is missed. Document fingerprints that can't be in the benchmark
are dropped against a bitmap whose size is bounded (``MAX_BITS``) however large
the benchmark is; what is left is joined with the benchmark's fingerprints by a
plain equi-join, and each joined pair is extended word by word over the text
around it. Items shorter than a window are looked up by the hash of all their
words, one pass for each length that occurs (at most ``WINDOW - 1``).

Cases: null or empty text has no words and is clean; an item without words has
no window; repeated items count one by one; a repeated document row gets the
result of its document; without items every document is clean, without documents
there are no rows; texts of any length are read whole; other columns, under any
names, are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from residuum.llm.staging import id_text, stage
from residuum.llm.textops import (ALNUM, BYTE_CODE, LOWER, blocks, find_words, prefix_hash, span_hash, window_minima,
                                  word_hashes)

WINDOW = 10
GRAM = 5
MAX_BITS = 1 << 27
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FP = "doc_id bigint, n_words bigint, fp bigint, kind int, pos bigint, before int, context binary"
_FP_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("fp", pa.int64()), ("kind", pa.int32()),
                       ("pos", pa.int64()), ("before", pa.int32()), ("context", pa.binary())])
_SPARE = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(docs: DataFrame, keep=None, lengths=(), items: bool = False) -> DataFrame:
    """Rows of ``_FP``: one of kind -1 for each document with its number of words, and one
    for each kept fingerprint (kind 0; for short windows their length) with the words around it.

    ``keep`` is a broadcast bitmap over ``fp``; ``lengths`` are the short windows to look for.
    With ``items`` each short text gives its one window.
    """
    def run(batches):
        bits = None if keep is None else keep.value
        for b in blocks(batches):
            data = LOWER[b.data]
            words = find_words(data, b.off, ALNUM)
            count = np.diff(words.first)
            yield pa.record_batch([pa.array(b.ids), pa.array(count, pa.int64())] + [
                pa.nulls(len(b.ids), t) if t != pa.int32() or i else pa.array(np.full(len(b.ids), -1, np.int32))
                for i, t in ((0, pa.int64()), (0, pa.int32()), (0, pa.int64()), (1, pa.int32()), (0, pa.binary()))],
                schema=_FP_ARROW)
            n = len(words.start)
            if not n:
                continue
            total = prefix_hash(word_hashes(data, words))
            doc = np.repeat(np.arange(len(b.ids)), count)
            upto = words.first[1:][doc]
            at = np.arange(n)
            for kind in (0, *lengths) if not items else (0, *range(1, WINDOW)):
                size = kind or GRAM
                if n < size:
                    continue
                h = span_hash(total, at[:n - size + 1], at[size - 1:] + 1)
                fits = at[:n - size + 1] + size <= upto[:n - size + 1]
                if not kind:
                    h[~fits] = _SPARE
                    if n - size + 1 < WINDOW - GRAM + 1:
                        fits[:] = False
                    fits &= window_minima(h, WINDOW - GRAM + 1)
                if items:
                    fits &= (count[doc] >= WINDOW if not kind else count[doc] == kind)[:n - size + 1]
                if bits is not None:
                    where = h & np.uint64(len(bits) * 8 - 1)
                    fits &= (bits[(where >> np.uint64(3)).astype(np.int64)] >> (where & np.uint64(7)).astype(np.uint8)) & 1 > 0
                p = np.flatnonzero(fits)
                for q in np.array_split(p, len(p) // 4096 + 1) if len(p) else ():
                    low = q if kind else np.maximum(q - (WINDOW - GRAM), words.first[doc[q]])
                    high = q + size if kind else np.minimum(q + WINDOW, upto[q])
                    s, e = words.start[low].tolist(), words.end[high - 1].tolist()
                    yield pa.record_batch([
                        pa.array(b.ids[doc[q]]), pa.nulls(len(q), pa.int64()), pa.array(h[q].view(np.int64)),
                        pa.array(np.full(len(q), kind, np.int32)), pa.array(q - words.first[doc[q]]),
                        pa.array((q - low).astype(np.int32)), pa.array([data[x:y].tobytes() for x, y in zip(s, e)], pa.binary())],
                        schema=_FP_ARROW)
    return docs.mapInArrow(run, _FP)


def _bitmap(fps: DataFrame, most: int = MAX_BITS):
    """Broadcast bitmap of the fingerprints: 16 bits for each, at most ``most`` bits."""
    spark = fps.sparkSession
    bits = 1 << 16
    n = fps.count()
    while bits < min(16 * n, most):
        bits *= 2
    part = 1 << 15

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(part, np.uint8)
        marks[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(marks, bitorder="little").tobytes()]})

    spots = fps.select(F.col("fp").bitwiseAND(F.lit(bits - 1)).alias("spot")).distinct()
    packed = (spots.select((F.col("spot") / part).cast("long").alias("part"), (F.col("spot") % part).alias("bit"))
              .groupBy("part").applyInPandas(pack, "part long, bits binary"))
    out = np.zeros(bits // 8, np.uint8)
    for row in packed.toLocalIterator():
        out[row["part"] * part // 8:(row["part"] + 1) * part // 8] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(out)


def _extend(batches):
    """Of joined fingerprints, those whose shared run of words reaches a whole window."""
    for batch in batches:
        out = {"doc_id": [], "item_id": [], "low": [], "high": []}
        for doc, pos, kind, before, context, item, item_before, item_context in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = _WORD.findall(context), _WORD.findall(item_context)
            size = kind or GRAM
            if a[before:before + size] != b[item_before:item_before + size]:
                continue
            left = right = 0
            if not kind:
                while left < before and left < item_before and a[before - left - 1] == b[item_before - left - 1]:
                    left += 1
                x, y = before + size, item_before + size
                while x + right < len(a) and y + right < len(b) and a[x + right] == b[y + right]:
                    right += 1
                if left + size + right < WINDOW:
                    continue
            for k, v in zip(out, (doc, item, pos - left, pos + size + right)):
                out[k].append(v)
        yield pa.record_batch([pa.array(v, pa.int64()) for v in out.values()], names=list(out))


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(documents, hits)``: ``doc_id, n_words`` for each row, and ``doc_id, item_id, low, high``:
    runs ``low:high`` of the document's words that lie in windows of the item."""
    theirs = stage(fingerprint(id_text(items, item_col, item_text_col), items=True).where("kind >= 0"), "winnow-items")
    lengths = sorted(r["kind"] for r in theirs.where("kind > 0").select("kind").distinct().collect())
    ours = stage(fingerprint(id_text(docs, id_col, text_col), _bitmap(theirs), lengths), "winnow-docs")
    pairs = (ours.where("kind >= 0").alias("d")
             .join(theirs.alias("b"), F.expr("d.fp = b.fp AND d.kind = b.kind"))
             .selectExpr("d.doc_id", "d.pos", "d.kind", "d.before", "d.context", "b.doc_id AS item_id",
                         "b.before AS item_before", "b.context AS item_context"))
    hits = pairs.mapInArrow(_extend, "doc_id bigint, item_id bigint, low bigint, high bigint").distinct()
    return ours.where("kind = -1").select("doc_id", "n_words"), stage(hits, "winnow-hits")


def contamination(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """One row for each document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    counted, hits = find_hits(docs, items, **columns)
    words = (hits.select("doc_id", "low", "high").distinct()
             .select("doc_id", F.explode(F.sequence("low", F.col("high") - 1)).alias("w"))
             .distinct().groupBy("doc_id").agg(F.count("w").alias("n_hit")))
    found = (hits.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("found")))
    per = words.join(found, "doc_id")
    return (counted.join(per, "doc_id", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                    F.greatest(F.coalesce(F.size("found"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_items"),
                    F.sha2(F.coalesce(F.concat_ws(",", "found"), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
