"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are the roles. A line is observed as its speaker marker (``User:``,
``### Assistant`` ...), the class of its length, and whether it ends as a question.
How the role goes on depends on whether the line opens a block (the first line of
a turn, or one after an empty line or with a marker): openings and continuations
have transitions of their own. All probabilities are counts over the labelled
lines, added to ``PRIOR`` counts that say a marker mostly tells the truth.

Transcripts. The texts of a conversation, in order and with an empty line between
them, are one transcript; where its turns begin, and whose they are, is not read but
recovered: a block opens after an empty line or at a marker, and a turn begins where
the decoded role changes, or at a marker.

Viterbi. Lines are numbered in the order of their transcripts and cut into chunks of
``CHUNK`` lines, whatever turns they belong to. For each chunk the best score from
every role before it to every role at its end is a small matrix; these are combined
in order, which gives the roles at the borders, and then each chunk is decoded
between its borders. No task holds more than the lines of a chunk, the border
matrices of a transcript (one for ``CHUNK`` lines) or the text of one turn.

Cases: null text is one empty line; null turns come first; rows without a
conversation id are left out; repeated rows of a conversation follow one another
(with given turns they share the first one's role), those of raw transcripts count
once; a transcript of empty lines has no turns; an unknown or null given role
doesn't train; a text of any length is cut like many short ones; an empty table
gives no rows; other columns, under any names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from residuum.llm.staging import discard, shuffle_partitions, stage

ROLES = ("system", "user", "assistant")
MARKERS = {"system": "system", "instructions": "system", "user": "user", "human": "user", "customer": "user", "q": "user",
           "question": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant",
           "a": "assistant", "answer": "assistant"}
MARKER = r"(?i)^[\s#>*_\[(<|-]*(" + "|".join(MARKERS) + r")[\s*_\])>|-]*[:>\])|]+\s*"
LENGTHS = (1, 30, 60, 100, 150, 220, 320, 480, 700, 1000)
PRIOR = 50.0
CHUNK = 1 << 12


def _observed(line: Column) -> list[Column]:
    name = F.lower(F.regexp_extract(line, MARKER, 1))
    mark = F.coalesce(F.element_at(F.create_map(*[x for k, v in MARKERS.items() for x in (F.lit(k), F.lit(ROLES.index(v) + 1))]), name), F.lit(0))
    size = sum((F.length(line) >= n).cast("int") for n in LENGTHS)
    return [mark.cast("int").alias("mark"), size.alias("size"), F.rtrim(line).endswith("?").cast("int").alias("asks")]


def lines_of_turns(turns: DataFrame) -> DataFrame:
    """Observations of the lines of ``turns(conv, turn, tie, text, role)``."""
    lines = turns.select("conv", "turn", "tie", "role", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("conv", "turn", "tie", "line", "role", (F.col("line") == 0).cast("int").alias("opens"), *_observed(F.col("t")))


def lines_of_transcripts(pieces: DataFrame) -> DataFrame:
    """Observations and texts ``t`` of the lines of ``pieces(conv, turn, tie, text, role)``; an empty line stands between pieces. Empty lines are left out."""
    cut = pieces.select("conv", "turn", "tie", "role", F.split("text", "\n").alias("ts")).withColumn("bs", F.concat(F.array(F.lit("")), F.slice("ts", 1, F.size("ts") - 1)))
    zipped = cut.select("conv", "turn", "tie", "role", F.arrays_zip("ts", "bs").alias("z"))
    lines = zipped.select("conv", "turn", "tie", "role", F.posexplode("z").alias("line", "x")).select("conv", "turn", "tie", "role", "line", F.col("x.ts").alias("t"), F.col("x.bs").alias("before"))
    seen = lines.where("trim(t) <> ''").select("conv", "turn", "tie", "line", "role", "t", "before", *_observed(F.col("t")))
    return seen.withColumn("opens", ((F.trim("before") == "") | (F.col("mark") > 0)).cast("int")).drop("before")


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``row``, rising in the order of conversation, turn and line, and ``chunk``: a line's number in its conversation div ``CHUNK``.

    Chunks don't depend on how Spark deals the rows, so neither does the choice between equally likely roles.
    """
    order = ("conv", "turn", "tie", "line")

    def run(batches):
        part = TaskContext.get().partitionId()
        n = part << 40
        for batch in batches:
            row = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row), pa.array(np.full(len(row), part))], names=[*batch.schema.names, "row", "part"])
    schema = T.StructType([*lines.schema, T.StructField("row", T.LongType()), T.StructField("part", T.LongType())])
    dealt = stage(lines.repartitionByRange(shuffle_partitions(lines.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, schema), "chat-dealt")
    ahead = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("conv", "part").agg(F.min("row").alias("start"), F.count(F.lit(1)).alias("n"))
              .select("conv", "part", (F.col("start") - F.coalesce(F.sum("n").over(ahead), F.lit(0))).alias("start")))
    out = stage(dealt.join(starts, ["conv", "part"]).withColumn("chunk", F.expr(f"(row - start) div {CHUNK}")).drop("part", "start"), "chat-lines")
    discard(dealt)
    return out


def _before(lines: DataFrame, value: str) -> DataFrame:
    """``lines`` with ``before``: a struct of ``value`` on the line before in its conversation, null on the first.

    No window holds more than the lines of a chunk or the chunks of a conversation.
    """
    ends = lines.groupBy("conv", "chunk").agg(F.max_by(F.struct(value), "row").alias("end"))
    ends = ends.select("conv", "chunk", F.lag("end").over(Window.partitionBy("conv").orderBy("chunk")).alias("end"))
    inside = Window.partitionBy("conv", "chunk").orderBy("row")
    return lines.join(ends, ["conv", "chunk"]).withColumn("before", F.coalesce(F.lag(F.struct(value)).over(inside), "end")).drop("end")


def _running(lines: DataFrame, value: str) -> DataFrame:
    """``lines`` with ``total``: the sum of ``value`` over a conversation's lines up to this one; windows as in :func:`_before`."""
    sums = lines.groupBy("conv", "chunk").agg(F.sum(value).alias("s"))
    ahead = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "chunk", F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("conv", "chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.join(sums, ["conv", "chunk"]).withColumn("total", F.col("ahead") + F.sum(value).over(inside)).drop("ahead")


class Model:
    """Log probabilities: ``begin[role]``, ``go[opens][role, next]``, ``seen[feature][role, value]``."""

    def __init__(self, steps=(), emitted=()):
        k = len(ROLES)
        begin, go = np.ones(k), np.ones((2, k, k)) + np.array([np.eye(k) * PRIOR, 1 - np.eye(k)])
        seen = {"mark": np.ones((k, k + 1)), "size": np.ones((k, len(LENGTHS) + 1)), "asks": np.ones((k, 2))}
        seen["mark"][:, 0] += PRIOR
        seen["mark"][np.arange(k), np.arange(k) + 1] += PRIOR
        for before, role, opens, n in steps:
            if before is None:
                begin[role] += n
            else:
                go[opens, before, role] += n
        for role, *values, n in emitted:
            for table, v in zip(seen.values(), values):
                table[role, v] += n
        self.begin = np.log(begin / begin.sum())
        self.go = np.log(go / go.sum(axis=2, keepdims=True))
        self.seen = [np.log(t / t.sum(axis=1, keepdims=True)) for t in seen.values()]

    def emission(self, values: np.ndarray) -> np.ndarray:
        return sum(t[:, values[:, i]].T for i, t in enumerate(self.seen))


def train(lines: DataFrame) -> Model:
    """Counts over labelled lines: as many rows as there are roles and feature values, whatever the input."""
    if "row" not in lines.columns:
        lines = numbered(lines)
    role = F.expr(f"CASE {' '.join(f'WHEN lower(role) = {r!r} THEN {i}' for i, r in enumerate(ROLES))} END").alias("r")
    known = lines.select("conv", "chunk", "row", role, "opens", "mark", "size", "asks")
    steps = (_before(known, "r").select(F.col("before.r").alias("from"), "r", "opens", F.col("before").isNull().alias("first"))
             .where("r IS NOT NULL AND (first OR from IS NOT NULL)").groupBy("from", "r", "opens").count())
    emitted = known.where("r IS NOT NULL").groupBy("r", "mark", "size", "asks").count()
    return Model([tuple(x) for x in steps.collect()], [tuple(x) for x in emitted.collect()])


def _groups(batches, keys: int):
    """Arrays of the rows of each run of equal first ``keys`` columns; a run may cross batches."""
    held = None
    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns], axis=1) if batch.num_rows else None
        if rows is None:
            continue
        held = rows if held is None else np.concatenate([held, rows])
        cut = np.flatnonzero((held[1:, :keys] != held[:-1, :keys]).any(axis=1)) + 1
        parts = np.split(held, cut)
        yield from parts[:-1]
        held = parts[-1]
    if held is not None and len(held):
        yield held


def _walk(score: np.ndarray, go: np.ndarray, emit: np.ndarray, opens: np.ndarray):
    """Viterbi from the scores of the roles before the lines: final scores and the way back."""
    back = np.empty(emit.shape, np.int64)
    for i in range(len(emit)):
        reach = score[:, None] + go[opens[i]]
        back[i] = reach.argmax(axis=0)
        score = reach.max(axis=0) + emit[i]
    return score, back


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """``row, role`` with the recovered role of each line of ``lines``, as :func:`numbered` gives them."""
    k = len(ROLES)
    seen = ("opens", "mark", "size", "asks")
    rows = lines.select("conv", "chunk", "row", *[F.col(c).cast("bigint").alias(c) for c in seen])
    go = model.go

    def matrices(batches):
        for g in _groups(batches, 2):
            emit = model.emission(g[:, 4:7])
            m = np.stack([_walk(np.where(np.arange(k) == r, 0.0, -np.inf), go, emit, g[:, 3])[0] for r in range(k)])
            own = _walk(np.zeros(k), np.stack([np.tile(model.begin, (k, 1))] * 2), emit[:1], g[:1, 3])[0]
            if len(g) > 1:
                own = _walk(own, go, emit[1:], g[1:, 3])[0]
            yield pa.record_batch([pa.array([int(g[0, 0])]), pa.array([int(g[0, 1])]), pa.array([np.concatenate([own, m.ravel()]).tolist()], pa.list_(pa.float64()))],
                                  names=["conv", "chunk", "m"])
    dealt = rows.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "row")
    border = stage(dealt.mapInArrow(matrices, "conv bigint, chunk bigint, m array<double>"), "chat-borders")

    def borders(batches):
        def convs():
            held, conv = [], None
            for batch in batches:
                for c, ch, m in zip(*(x.to_pylist() for x in batch.columns)):
                    if c != conv and held:
                        yield conv, held
                        held = []
                    conv = c
                    held.append((ch, np.array(m[:k]), np.array(m[k:]).reshape(k, k)))
            if held:
                yield conv, held
        for conv, chunks in convs():
            score, backs = chunks[0][1], []
            for _, _, m in chunks[1:]:
                reach = score[:, None] + m
                backs.append(reach.argmax(axis=0))
                score = reach.max(axis=0)
            ends = [int(score.argmax())]
            for b in reversed(backs):
                ends.append(int(b[ends[-1]]))
            ends.reverse()
            yield pa.record_batch([pa.array([conv] * len(ends)), pa.array([c[0] for c in chunks]), pa.array([-1] + ends[:-1], pa.int64()), pa.array(ends, pa.int64())],
                                  names=["conv", "chunk", "enter", "leave"])
    ends = border.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(borders, "conv bigint, chunk bigint, enter bigint, leave bigint")

    def roles(batches):
        for g in _groups(batches, 2):
            emit = model.emission(g[:, 4:7])
            enter, leave = int(g[0, 7]), int(g[0, 8])
            if enter < 0:
                score, back = model.begin + emit[0], np.zeros((1, k), np.int64)
                if len(g) > 1:
                    back = np.concatenate([back, _walk(score, go, emit[1:], g[1:, 3])[1]])
            else:
                back = _walk(np.where(np.arange(k) == enter, 0.0, -np.inf), go, emit, g[:, 3])[1]
            path = [leave]
            for b in back[:0:-1]:
                path.append(int(b[path[-1]]))
            yield pa.record_batch([pa.array(g[:, 2]), pa.array([ROLES[p] for p in reversed(path)])], names=["row", "role"])
    return (rows.join(ends, ["conv", "chunk"]).select("conv", "chunk", "row", *seen, "enter", "leave")
            .repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "row").mapInArrow(roles, "row bigint, role string"))


def rendered(role: Column, text: Column) -> Column:
    """A canonical turn: the role's tag, the text without its speaker marker, and an end tag."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(F.regexp_replace(text, MARKER, "")), F.lit("\n<|end|>\n"))


def _turns(conversations: DataFrame, keep: Column | None, conv_col: str, turn_col: str, text_col: str, role_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return conversations.select(F.col(conv_col).cast("bigint").alias("conv"), F.coalesce(F.col(turn_col).cast("bigint"), F.lit(-1)).alias("turn"),
                                F.xxhash64(text).alias("tie"), text.alias("text"), F.col(role_col).cast("string").alias("role"),
                                (F.lit(True) if keep is None else keep).alias("keep")).where("conv IS NOT NULL")


def format_turns(conversations: DataFrame, keep: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                 text_col: str = "text", role_col: str = "role") -> DataFrame:
    """Turns with given borders: one row for each row with a conversation id, ``conv_id, turn, given_role, role, rendered``.

    The given roles only train (on the rows where ``keep`` holds); they are never an input of decoding.
    """
    turns = _turns(conversations, keep, conv_col, turn_col, text_col, role_col)
    lines = numbered(lines_of_turns(turns))
    model = train(lines_of_turns(turns.where("keep")))
    found = (decode(lines, model).join(lines.where("line = 0").select("row", "conv", "turn", "tie"), "row").groupBy("conv", "turn", "tie").agg(F.min("role").alias("found")))
    return (turns.join(found, ["conv", "turn", "tie"])
            .select(F.col("conv").alias("conv_id"), "turn", F.col("role").alias("given_role"), F.col("found").alias("role"), rendered(F.col("found"), F.col("text")).alias("rendered")))


def _parsed(lines: DataFrame, model: Model) -> DataFrame:
    """``conv, number, role, rendered, given_turn, given_role, n_given``: the recovered turns of numbered lines, and what its first line was given as."""
    known = lines.select("conv", "chunk", "row", "turn", "line", "mark", F.col("role").alias("given_role"), "t").join(decode(lines, model), "row")
    begins = F.col("before").isNull() | (F.col("before.role") != F.col("role")) | (F.col("mark") > 0)
    cut = _running(_before(known, "role").withColumn("begins", begins.cast("int")).drop("before"), "begins")
    first = lambda c: F.min_by(F.struct(c), "row")[c]  # noqa: E731  (keeps a null)
    return (cut.groupBy("conv", "total").agg(F.first("role").alias("role"), F.sort_array(F.collect_list(F.struct("row", "t"))).alias("lines"), first("turn").alias("given_turn"),
                                             first("given_role").alias("given_role"), F.count_distinct("turn").alias("n_given"))
            .select("conv", (F.col("total") - 1).alias("number"), "role", rendered(F.col("role"), F.array_join(F.col("lines.t"), "\n")).alias("rendered"),
                    "given_turn", "given_role", "n_given"))


def parse_conversations(conversations: DataFrame, keep: Column | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                        text_col: str = "text", role_col: str = "role") -> DataFrame:
    """Each conversation as one transcript, parsed: ``conv_id, number`` (from 0)``, role, rendered`` of each recovered turn, and to compare
    ``given_turn, given_role`` of its first line and ``n_given``, the number of given turns it has lines of.

    Given roles and turn borders train, on the rows where ``keep`` holds; decoding reads only the order of the texts.
    """
    turns = _turns(conversations, keep, conv_col, turn_col, text_col, role_col)
    lines = numbered(lines_of_transcripts(turns))
    model = train(numbered(lines_of_transcripts(turns.where("keep")).drop("t")))
    return _parsed(lines, model).withColumnRenamed("conv", "conv_id")


def parse_transcripts(transcripts: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Turns of raw transcripts: ``id, turn, role, rendered``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    pieces = transcripts.select(F.col(id_col).cast("bigint").alias("conv"), F.lit(0).alias("turn"), F.xxhash64(text).alias("tie"), text.alias("text"),
                                F.lit(None).cast("string").alias("role")).where("conv IS NOT NULL").distinct()
    return _parsed(numbered(lines_of_transcripts(pieces)), model).select(F.col("conv").alias("id"), F.col("number").alias("turn"), "role", "rendered")
