"""Keyword scoring with a lexicon of any size: a multi-pattern automaton as two constant arrays.

The words are compiled into one automaton (a trie whose missing moves follow the
longest suffix that is a prefix of a word). Its moves are a dense table, a row for
each state and a column for each character of the lexicon; a text is walked once,
character by character, by the built-in ``aggregate``, whatever the number of words.
The table's size is known before the plan is made and checked. No join, no shuffle,
no Python on the executors.

A step of the walk costs as much as a plain search compares in thousands of
characters, so up to ``MAX_SEARCHED`` words are searched one by one (``contained``),
in the distinct runs of the lexicon's characters in the text: a word lies within
one of them.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CELLS = 8_000_000
MAX_SEARCHED = 2048     # words; beyond that a text is walked


def _ints(values: list[int]) -> Column:
    """A constant array (folded once when the plan is optimised)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>") if values else F.array().cast("array<int>")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated one time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def contained(words: list[str], text: Column) -> Column:
    """Numbers of the ``words`` (distinct, none empty) that ``text`` contains, in their order."""
    letters = set("".join(words))
    between = next(c for c in map(chr, range(10, 0x110000)) if c not in letters)
    runs = F.split(text, "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(letters)) + "]+")
    numbers, all_words = _ints(list(range(len(words)))), F.array(*[F.lit(w) for w in words])
    return _once(F.array_join(F.array_distinct(runs), between), lambda t: F.filter(numbers, lambda i: t.contains(F.get(all_words, i))))


class Automaton:
    """``moves[state * width + class]`` is the next state; ``found[state]`` the words that end there; class 0 is any other character."""

    def __init__(self, words: list[str], max_cells: int = MAX_CELLS):
        self.words = list(dict.fromkeys(w for w in words if w))
        letters = sorted(set("".join(self.words)))
        self.classes = {c: i for i, c in enumerate(letters, 1)}
        self.width = len(letters) + 1
        if (1 + sum(map(len, self.words))) * self.width > max_cells:
            raise ValueError(f"the lexicon's automaton takes more than {max_cells} cells; split the lexicon")
        trie, ends = [{}], [[]]
        for i, w in enumerate(self.words):
            at = 0
            for c in w:
                if c not in trie[at]:
                    trie[at][c] = len(trie)
                    trie.append({})
                    ends.append([])
                at = trie[at][c]
            ends[at].append(i)
        self.states = len(trie)
        moves, fall = [0] * (self.states * self.width), [0] * self.states
        queue = deque([0])
        while queue:                                       # breadth first: a state's fall-back is complete before it
            at = queue.popleft()
            row, back = at * self.width, fall[at] * self.width
            if at:
                moves[row:row + self.width] = moves[back:back + self.width]
                ends[at] += ends[fall[at]]
            for c, to in trie[at].items():
                fall[to] = moves[back + self.classes[c]] if at else 0
                moves[row + self.classes[c]] = to
                queue.append(to)
        self.moves, self.found = moves, ends

    def hits(self, text: Column) -> Column:
        """Numbers of the words that ``text`` contains, each once, in the order of their first end."""
        top = max(map(ord, self.classes), default=0)
        class_of = [0] * (top + 1)
        for c, i in self.classes.items():
            class_of[ord(c)] = i
        moves, classes = _ints(self.moves), _ints(class_of)
        ends = F.split(F.lit(";".join(" ".join(map(str, e)) for e in self.found)), ";")
        new = lambda acc: F.when(F.get(ends, acc["state"]) != "", F.array_union(
            acc["hits"], F.split(F.get(ends, acc["state"]), " ").cast("array<int>"))).otherwise(acc["hits"])
        start = F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("hits"))
        step = lambda acc, ch: F.struct(
            F.get(moves, acc["state"] * self.width + F.coalesce(F.get(classes, F.ascii(ch)), F.lit(0))).alias("state"), new(acc).alias("hits"))
        return F.aggregate(F.split(text, ""), start, step, new)


def automaton_label(text: Column, lexicon: dict[str, list[str]], other: str, max_cells: int = MAX_CELLS) -> Column:
    """The label of ``keyword_label`` (highest Σ length of contained words, ties to the label listed first, else ``other``)."""
    low = F.lower(text)
    every = list(dict.fromkeys(w for words in lexicon.values() for w in words if w))
    machine = Automaton(every, max_cells)
    number = {w: i for i, w in enumerate(every)}
    labels = list(lexicon)
    weight = [0] * (len(every) * len(labels))
    for j, label in enumerate(labels):
        for w in lexicon[label]:
            if w:                                          # the empty word is in every text, and weighs nothing
                weight[number[w] * len(labels) + j] += len(w)
    if not every:
        return F.lit(other)
    weights, names = _ints(weight), F.array(*[F.lit(x) for x in labels])
    scores = lambda found: F.array_max(F.transform(_ints(list(range(len(labels)))), lambda j: F.struct(
        F.aggregate(found, F.lit(0), lambda s, w: s + F.get(weights, w * len(labels) + j)).alias("s"), (-j).alias("o"))))
    hits = contained(every, low) if len(every) <= MAX_SEARCHED else machine.hits(low)
    label = _once(_once(hits, scores), lambda best: F.when(best["s"] > 0, F.get(names, -best["o"])))
    return F.coalesce(label, F.lit(other))
