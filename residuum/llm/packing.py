"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenized, closed with the end id, and cut into pieces of ``LENGTH``
ids only if longer. With a tokenizer whose normalizer and splitter are those of
``NORMALIZER`` and ``SPLITTER``, no rule reaches across white space, so each
white-space-separated word is encoded once per task and looked up after that; with
any other, whole texts are encoded.

A piece of full length is a sequence. The rest is dealt by row number into shards of
about ``SHARD`` pieces; a shard wastes less than one sequence against packing all
together. Each shard is evolved on ``ISLANDS`` islands, tasks of their own, for
``EPOCHS`` epochs; between epochs each island's elite migrates to the next island
by a join. An individual is a set of sequences. Crossover injects whole
well-filled sequences of one parent into the other and removes the sequences that
hold a piece twice; mutation empties the worst filled and a few others. Displaced
pieces first take the place of one or two shorter pieces where a sequence gets
fuller by it, then go by best fit. An island stops early at a proven bound: the
least number by all ids, or by the pieces that can't stand together.

Cases: a null or empty text is the end id alone; rows without an id are packed too;
repeated rows are packed one by one; equal lengths are ordered by id.
"""

from __future__ import annotations

import json
import os
import random
import re
import zlib
from array import array
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from residuum.llm.staging import every_text, stage
from residuum.llm.textops import blocks

LENGTH = 2048
SHARD = 4096
ISLANDS = 2
TASK_ISLANDS = 8
MOST_TASKS = 10_000
EPOCHS = 2
GENERATIONS = 60
POPULATION = 6
KNOWN_WORDS = 1_000_000  # a worker forgets its words beyond that (about 250 MB)
# The tokenizer rules that the word table stands for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Numbers of white-space-separated words; the ids of each stand in ``flat``.

    A word of basic and Latin-1 letters with ASCII punctuation after it is one run of letters and one of
    punctuation to the tokenizer, so it is looked up in these two parts, and a new run of letters goes to the
    model alone. Any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.by_word = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == SPLITTER
        if not self.by_word:
            return
        letters = [chr(c) for c in (*range(97, 123), 0xDF, *range(0xE0, 0xF7), *range(0xF8, 0x100))]
        self.mapped = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.parts = {}
        self.flat, self.start, self.size = array("I"), array("q"), array("q")

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        m = _SIMPLE.fullmatch(text)
        if m:
            letters, marks = m.groups()
            letters = letters.lower()
            ids = self.parts.get(letters)
            if ids is None:
                ids = self.parts[letters] = [t.id for t in self.tokenizer.model.tokenize(letters.translate(self.mapped))]
            if marks:
                more = self.parts.get(marks)
                if more is None:
                    more = self.parts[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids
                ids = ids + more
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self[word] = n = len(self.start)
        self.start.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return n

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of each text's ids."""
        if not self.by_word:
            found = [self.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
            return np.fromiter((i for f in found for i in f), np.uint32), np.array([len(f) for f in found], np.int64)
        texts = [t.split() for t in texts]
        count = np.array([len(t) for t in texts])
        at = np.fromiter((self[w] for t in texts for w in t), np.int64, int(count.sum()))
        size = np.array(self.size)[at] if len(at) else at
        ends = np.cumsum(size)
        ids = np.array(self.flat)[np.repeat(np.array(self.start)[at] - ends + size, size) + np.arange(ends[-1])] if len(at) else at
        total = np.concatenate([[0], ends])
        edge = np.concatenate([[0], np.cumsum(count)])
        per = total[edge[1:]] - total[edge[:-1]]
        if len(self) > KNOWN_WORDS:
            self.reset()
        return ids.astype(np.uint32), per


@lru_cache(maxsize=1)
def _words(path: str) -> _Words:
    """One for each Python worker, which Spark uses again for later tasks."""
    return _Words(path)


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of ``docs(doc_id, text)``; ``tokenizer`` is a path that executors have."""
    def run(batches):
        words = None
        for batch in batches:
            names, done = batch.column(0).to_pylist(), 0  # an id may be null
            for b in blocks([pa.record_batch([pa.array(np.zeros(len(names), np.int64)), batch.column(1)], names=["doc_id", "text"])]):
                words = words or _words(tokenizer or default_tokenizer())
                ids, count = words.encode([b.data[x:y].tobytes() for x, y in zip(b.off[:-1].tolist(), b.off[1:].tolist())])
                out, at = [], 0
                for doc, n in zip(names[done:done + len(b.ids)], count.tolist()):
                    mine = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    out += [(doc, i // length, i, len(p), zlib.crc32(p.tobytes())) for i in range(0, n + 1, length) for p in (mine[i:i + length],)]
                done += len(b.ids)
                yield pa.record_batch([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*out))],
                                      names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.mapInArrow(run, _PIECES)


Bin = tuple  # (ids in it, pieces)


def least_bins(lengths: list[int], length: int = LENGTH) -> int:
    """A bound no packing can beat: for every size k, pieces longer than ``length - k`` stand alone among those of k or more,
    pieces over half stand apart from each other, and the others fill at most the room that these leave."""
    n = np.sort(np.asarray(lengths, np.int64))
    if not len(n):
        return 0
    total = np.concatenate([[0], np.cumsum(n)])
    half = int(np.searchsorted(n, length // 2, "right"))
    k = np.unique(np.concatenate([[0], n[:half]]))
    alone = np.searchsorted(n, length - k, "right")  # pieces from here on are longer than length - k
    alone = np.maximum(alone, half)
    small = total[half] - total[np.searchsorted(n, k, "left")]
    room = (alone - half) * length - (total[alone] - total[half])
    return int((len(n) - half + np.maximum(0, -(-(small - room) // length))).max())


def best_fit(bins: list[Bin], items, lengths: list[int], length: int) -> list[Bin]:
    """``bins`` and new ones with ``items`` in, the longest first, each in the fullest that still has room."""
    bins = list(bins)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # a bit for each amount of room
    for at, (fill, _) in enumerate(bins):
        by_room.setdefault(length - fill, []).append(at)
        rooms |= 1 << (length - fill)
    for i in sorted(items, key=lambda i: -lengths[i]):
        n = lengths[i]
        high = rooms >> n
        if high:
            room = n + (high & -high).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at] = (bins[at][0] + n, bins[at][1] + (i,))
        else:
            room, at = length, len(bins)
            bins.append((n, (i,)))
        by_room.setdefault(room - n, []).append(at)
        rooms |= 1 << (room - n)
    return bins


def _replace(bins: list[Bin], displaced: list[int], lengths: list[int], length: int) -> tuple[list[Bin], list[int]]:
    """Displaced pieces in the place of one or two shorter ones, wherever a sequence gets fuller by it; returns what is displaced then."""
    pool = sorted(displaced, key=lambda i: lengths[i])
    size = [lengths[i] for i in pool]
    out = []
    for fill, held in bins:
        room = length - fill
        if room and size:
            best, choice = 0, None
            for x in range(len(held)):
                one = lengths[held[x]]
                for y in range(x, min(len(held), x + 8)):
                    gone = one if x == y else one + lengths[held[y]]
                    at = bisect_right(size, gone + room) - 1
                    if at >= 0 and size[at] - gone > best:
                        best, choice = size[at] - gone, (x, y, at)
                # one piece by two: the longest displaced one, and the longest that still fits beside it
                at = bisect_right(size, one + room) - 1
                if at > 0:
                    other = bisect_right(size, one + room - size[at], 0, at) - 1
                    if other >= 0 and size[at] + size[other] - one > best:
                        best, choice = size[at] + size[other] - one, (x, x, at, other)
            if choice:
                x, y, *take = choice
                back = {x, y}
                new = [pool[t] for t in take]
                for t in take:  # the greater place first
                    del pool[t], size[t]
                for z in back:
                    t = bisect_right(size, lengths[held[z]])
                    pool.insert(t, held[z])
                    size.insert(t, lengths[held[z]])
                fill, held = fill + best, tuple(i for z, i in enumerate(held) if z not in back) + tuple(new)
        out.append((fill, held))
    return out, pool


def _fitness(bins: list[Bin]) -> tuple[int, int]:
    return len(bins), -sum(fill * fill for fill, _ in bins)


def _settle(keep: list[Bin], displaced: list[int], lengths, length, rnd) -> list[Bin]:
    rnd.shuffle(keep)
    return best_fit(*_replace(keep, displaced, lengths, length), lengths, length)


def _cross(a, b, lengths, length, rnd):
    full = sorted(a, key=lambda x: -x[0])
    inject = full[:rnd.randint(len(full) // 4, max(len(full) // 4, 3 * len(full) // 4))]
    taken = {i for _, held in inject for i in held}
    keep, displaced = [], []
    for x in b:
        if taken.isdisjoint(x[1]):
            keep.append(x)
        else:
            displaced += [i for i in x[1] if i not in taken]
    return _settle(inject + keep, displaced, lengths, length, rnd)


def _mutate(a, lengths, length, rnd):
    worst = sorted(range(len(a)), key=lambda k: a[k][0])[:max(2, len(a) // 100)]
    gone = {*worst, *rnd.sample(range(len(a)), min(len(a), max(2, len(a) // 50)))}
    return _settle([x for k, x in enumerate(a) if k not in gone], [i for k in gone for i in a[k][1]], lengths, length, rnd)


def evolve(lengths: list[int], seeds: list[list[int]], seed: int, length: int = LENGTH, generations: int = GENERATIONS, population: int = POPULATION) -> list[int]:
    """The best packing found, as a sequence number for each piece; ``seeds`` are packings of the same form."""
    rnd = random.Random(seed)
    least = least_bins(lengths, length)
    people = []
    for s in seeds:
        bins: dict = {}
        for i, k in enumerate(s):
            bins.setdefault(k, []).append(i)
        people.append([(sum(lengths[i] for i in b), tuple(b)) for b in bins.values()])
    people.append(best_fit([], range(len(lengths)), lengths, length))
    if min(map(len, people)) > least:
        while len(people) < population:
            people.append(_mutate(people[rnd.randrange(len(people))], lengths, length, rnd))
        people.sort(key=_fitness)
        for _ in range(generations):
            if len(people[0]) <= least:
                break
            a, b = rnd.sample(people[:max(2, population // 2)], 2)
            child = _cross(a, b, lengths, length, rnd) if rnd.random() < 0.3 else _mutate(a, lengths, length, rnd)
            if _fitness(child) < _fitness(people[-1]):
                people[-1] = child
                people.sort(key=_fitness)
    best = min(people, key=_fitness)
    out = [0] * len(lengths)
    for k, (_, held) in enumerate(best):
        for i in held:
            out[i] = k
    return out


def _epoch(islands: DataFrame, turn: int, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            best = [evolve(r["lengths"], r["seeds"], hash((turn, r["shard"], r["island"])), length) for r in rows]
            yield pa.record_batch([batch.column("shard"), batch.column("island"), pa.array(best, pa.list_(pa.int32())),
                                   pa.array([max(b) + 1 for b in best], pa.int32())], names=["shard", "island", "best", "bins"])
    return islands.mapInArrow(run, "shard long, island int, best array<int>, bins int")


def assign(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """``cut`` (rows of :func:`pieces`) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    short = cut.where(F.col("length") < length)  # rows are dealt by their number: repeated ones and those without an id spread as well
    shards = -(-short.count() // SHARD) or 1
    item = F.struct((-F.col("length")).alias("less"), "doc_id", "piece", "start", "length", "ids_crc32")
    groups = stage(short.groupBy(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard"))
                   .agg(F.sort_array(F.collect_list(item)).alias("items")), "packing-shards")
    islands = groups.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("items.length").alias("lengths"))
    tasks = min(-(-shards * ISLANDS // TASK_ISLANDS), MOST_TASKS)  # by number, or their few bytes would share one task
    elite = None
    for turn in range(EPOCHS):
        if elite is None:
            ready = islands.withColumn("seeds", F.array().cast("array<array<int>>"))
        else:
            own = elite.select("shard", "island", F.col("best").alias("own"))
            guest = elite.select("shard", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.col("best").alias("guest"))
            ready = (islands.join(own, ["shard", "island"]).join(guest, ["shard", "island"])
                     .select("shard", "island", "lengths", F.array("own", "guest").alias("seeds")))
        elite = stage(_epoch(ready.repartition(tasks, "shard", "island"), turn, length), "packing-elites")
    best = elite.groupBy("shard").agg(F.min_by("best", F.struct("bins", "island")).alias("best"))
    placed = (groups.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "best")).alias("x"))
              .select("x.items.*", ((F.col("shard") + 1) * (1 << 32) + F.col("x.best")).alias("sequence_id")))
    by = Window.partitionBy("sequence_id").orderBy("doc_id", "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"]
    # numbers of full pieces are negative, so they never meet those above
    whole = cut.where(F.col("length") == length).select(*columns[:-1], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return placed.select(*columns, (F.sum("length").over(by) - F.col("length")).cast("bigint").alias("offset")).unionByName(whole)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return assign(stage(pieces(every_text(docs, id_col, text_col), tokenizer, length, end_id), "packing-pieces"), length)
