"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text are classed by the factor of so many words that begins at them.
Going from length l to l + 1, a class falls apart by the classes of the positions that
follow its members.  Only classes that were cut off since the last length are looked at,
and of the parts of a class that fell apart all but the largest (the smaller halves), so
a position is looked at a logarithmic number of times at most.  Members of a class are
linked in order of position; neighbours whose distance equals the length begin a square
of a primitive root.  Squares of one period that begin at consecutive positions are a run.

The texts of a batch are refined together, each with classes of its own, as arrays: a
step costs the same whether one text or a thousand take part in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraline.llm.common import small_batches, tidy

#: A run holds its period so many times, and so many words, at least.
EXPONENT, LEAST = 4, 6
#: Words of texts that are refined together; a longer text is refined alone.
TOGETHER = 400_000
#: Positions to look at up to which a step goes one by one: whole arrays cost more.
FEW = 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class _Refined:
    """The classes of all positions at one length; a position that ends each text is a class of its own."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, exponent: int):
        n = len(words) + len(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes + 1)
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(n, bool)
        inner[ends] = False
        at = np.flatnonzero(inner)
        #: The longest period that a run in the position's text can have; 0 at positions that are alone in their class.
        self.longest = (sizes // exponent)[text].astype(np.int32)
        self.longest[ends] = 0
        self.bound = self.longest.copy()
        key = text[at] * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(key, kind="stable")
        sorted_at, key = at[order], key[order]
        begins = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        which = np.cumsum(begins) - 1
        classes = int(which[-1]) + 1 if len(which) else 0
        self.ids = classes + len(sizes)
        self.of = np.zeros(n, np.int64)
        self.of[sorted_at], self.of[ends] = which, classes + np.arange(len(sizes))
        self.size, self.head = np.ones(2 * self.ids, np.int64), np.zeros(2 * self.ids, np.int64)
        self.size[:classes], self.head[:classes], self.head[classes : self.ids] = np.bincount(which, minlength=classes), sorted_at[begins], ends
        self.next, self.before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.next[sorted_at[:-1][~begins[1:]]] = sorted_at[1:][~begins[1:]]
        self.before[sorted_at[1:][~begins[1:]]] = sorted_at[:-1][~begins[1:]]
        self.longest[at[self.size[self.of[at]] == 1]] = 0
        #: The length at which a position got the neighbour that it has.
        self.since = np.ones(n, np.int32)
        self.marked = np.zeros(n, bool)
        self.small, self.level, self.squares = np.arange(n), 1, []

    def _parted(self, at: np.ndarray) -> None:
        """Positions that get another neighbour at the next length: had they the old one when its distance was the length?"""
        gap = self.next[at] - at
        square = (gap >= self.since[at]) & (gap <= self.level)
        if square.any():
            self.squares.append((at[square], gap[square]))
        self.since[at] = self.level + 1

    def _room(self, more: int) -> None:
        if self.ids + more > len(self.size):
            self.size, self.head = (np.concatenate([x, np.zeros(max(more, len(x)), np.int64)]) for x in (self.size, self.head))

    def step(self) -> bool:
        """From one length to the next; False if no class can fall apart any more."""
        if len(self.small) <= FEW:
            self._few_steps()
        t = self.small[self.small > 0] - 1
        t = t[self.longest[t] > self.level]
        if not len(t):
            return False
        t.sort()
        key = self.of[t] * self.ids + self.of[t + 1]
        order = np.argsort(key, kind="stable")
        t, key = t[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(t)))
        parent_of = self.of[t[first]]
        new_parent = np.concatenate([[True], parent_of[1:] != parent_of[:-1]])
        parent, which = parent_of[new_parent], np.cumsum(new_parent) - 1
        at = np.flatnonzero(new_parent)
        rest = self.size[parent] - np.add.reduceat(size, at)
        # a class that only one part is of, and nothing else, hasn't fallen apart
        whole = (np.diff(np.append(at, len(size))) == 1) & (rest == 0)
        if whole.any():
            kept = ~whole[which]
            t = t[np.repeat(kept, size)]
            if not len(t):
                self.small = t
                self.level += 1
                return True
            size, which = size[kept], (np.cumsum(~whole) - 1)[which[kept]]
            parent, rest = parent[~whole], rest[~whole]
            first = np.cumsum(size) - size
            at = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        largest = np.maximum.reduceat(size, at)

        # what stays behind is linked past what leaves
        leaving = t if (rest > 0).all() else t[np.repeat((rest > 0)[which], size)]
        self.marked[leaving] = True
        # ends of stretches of leaving neighbours; -1 is the last text's end, which never leaves
        starts, stops = leaving[~self.marked[self.before[leaving]]], leaving[~self.marked[self.next[leaving]]]
        self.marked[leaving] = False
        starts, stops = (x[np.lexsort((x, self.of[x]))] for x in (starts, stops))
        a, b = self.before[starts], self.next[stops]
        inside = a >= 0
        self._parted(a[inside])
        self.next[a[inside]] = b[inside]
        self.head[self.of[starts[~inside]]] = b[~inside]
        self.before[b[b >= 0]] = a[b >= 0]
        self.size[parent] = rest

        # what leaves is linked among itself
        self._room(len(size))
        last = first + size - 1
        follows, precedes = np.append(t[1:], -1), np.concatenate([[-1], t[:-1]])
        follows[last], precedes[first] = -1, -1
        other = t[follows != self.next[t]]
        self._parted(other)
        self.next[t], self.before[t] = follows, precedes
        self.of[t] = np.repeat(self.ids + np.arange(len(size)), size)
        self.size[self.ids : self.ids + len(size)], self.head[self.ids : self.ids + len(size)] = size, t[first]
        self.ids += len(size)
        self.longest[t[first[size == 1]]] = 0
        self.longest[self.head[parent[rest == 1]]] = 0

        # all parts but the largest of each class
        chosen = np.ones(len(size), bool)
        behind = rest < largest
        most = np.flatnonzero(behind[which] & (size == largest[which]))
        chosen[most[np.concatenate([[True], which[most][1:] != which[most][:-1]])[: len(most)]]] = False
        self.small = np.concatenate([t[np.repeat(chosen, size)], *self._members(self.head[parent[behind & (rest > 0)]])])
        self.level += 1
        return True

    def _few_steps(self) -> None:
        """step() one position at a time, as long as few are to be looked at."""
        of, following, before, since, longest = map(memoryview, (self.of, self.next, self.before, self.since, self.longest))
        small, level, found = self.small.tolist(), self.level, []
        self._room(2 * FEW)
        size, head = memoryview(self.size), memoryview(self.head)

        def parted(i: int) -> None:
            if since[i] <= following[i] - i <= level:
                found.append((i, following[i] - i))
            since[i] = level + 1

        while small and len(small) <= FEW:
            classes: dict[int, dict[int, list[int]]] = {}
            for i in sorted(small):
                if i and longest[i - 1] > level:
                    classes.setdefault(of[i - 1], {}).setdefault(of[i], []).append(i - 1)
            small = []
            if self.ids + FEW > len(size):
                del size, head
                self._room(2 * FEW)
                size, head = memoryview(self.size), memoryview(self.head)
            for parent, parts in classes.items():
                rest = size[parent] - sum(map(len, parts.values()))
                if not rest and len(parts) == 1:
                    continue
                if rest:
                    for part in parts.values():
                        for i in part:
                            a, b = before[i], following[i]
                            if a >= 0:
                                parted(a)
                                following[a] = b
                            else:
                                head[parent] = b
                            if b >= 0:
                                before[b] = a
                size[parent] = rest
                if rest == 1:
                    longest[head[parent]] = 0
                for part in parts.values():
                    for i, a, b in zip(part, [-1, *part[:-1]], [*part[1:], -1], strict=True):
                        if following[i] != b:
                            parted(i)
                        following[i], before[i], of[i] = b, a, self.ids
                    if len(part) == 1:
                        longest[part[0]] = 0
                    size[self.ids], head[self.ids] = len(part), part[0]
                    self.ids += 1
                largest = max(parts.values(), key=len)
                if rest >= len(largest):
                    largest = None
                elif rest:
                    i = head[parent]
                    while i >= 0:
                        small.append(i)
                        i = following[i]
                for part in parts.values():
                    if part is not largest:
                        small += part
            level += 1
        self.small, self.level = np.array(small, np.int64), level
        if found:
            self.squares.append(tuple(np.array(found, np.int64).T))

    def _members(self, at: np.ndarray) -> Iterator[np.ndarray]:
        while len(at):
            yield at
            at = self.next[at]
            at = at[at >= 0]

    def all_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, root's length) of all primitive squares whose roots are no longer than the bound of their text."""
        while self.step():
            pass
        at = np.flatnonzero(self.next >= 0)
        gap = self.next[at] - at
        square = (gap >= self.since[at]) & (gap <= self.bound[at])
        found = [*self.squares, (at[square], gap[square])]
        return np.concatenate([s for s, _ in found]), np.concatenate([g for _, g in found])


def runs_of(words: np.ndarray, sizes: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of texts of `sizes` words each, by text, start and period.

    words: a number for each word, equal for equal words.  Of runs, those that hold their
    smallest period `exponent` times (2 or more) and `least` words.
    """
    sizes = np.asarray(sizes, np.int64)
    start, period = _Refined(np.asarray(words, np.int64), sizes, exponent).all_squares()
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    first = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)])[: len(start)])
    length = np.diff(np.append(first, len(start))) - 1 + 2 * period[first]
    start, period = start[first], period[first]
    enough = length >= np.maximum(least, exponent * period)
    start, length, period = start[enough], length[enough], period[enough]
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.searchsorted(begins, start, side="right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - begins[text])[order], length[order], period[order]


class _Numbers(dict):
    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _collapsed(words: list[bytes], spans: list[tuple[int, int, int]]) -> bytes:
    """Words joined by a space, of each run only its first period."""
    if not spans:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in spans:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()])


def _refined(exponent: int, least: int):
    def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        sizes, numbers = [len(t) for t in texts], _Numbers()
        flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, sum(sizes))
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for text, *run in zip(*(x.tolist() for x in runs_of(flat, sizes, exponent, least)), strict=True):
            spans[text].append(tuple(run))
        rows = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in spans], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
        collapsed = pa.array([_collapsed(t, own) for t, own in zip(texts, spans, strict=True)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), rows, collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        ids, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                words = (text or b"").split()  # bytes: at U+0020 and U+0009 to U+000D alone
                if ids and held + len(words) > TOGETHER:
                    yield answer(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                held += len(words)
        if ids:
            yield answer(ids, texts)

    return run


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """One row per row: doc_id, n_words, runs (start, length and period in words, by start, then period), collapsed.

    Words are what lies between U+0020 and U+0009 to U+000D, numbered from 0.  A run is a
    stretch of words with smallest period q, at least `least` words and `exponent` times q
    long, that no neighbouring word extends.  `collapsed` has the words joined by a space
    without those that a run contains after its first q.  Null text: as an empty one, no
    words and an empty `collapsed`.  Each row, of a repeated or null doc_id too, is
    answered for itself; other columns are left out.  Texts are taken whole, so a task holds one text at a time
    or several of TOGETHER words in all.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_refined(exponent, least)), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs in which the tail of each tenth text by crc32 of its doc_id is made periodic; texts of null doc_ids stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    at = docs.withColumn("vl_words", F.when(h % 10 == 0, words))
    n = F.size("vl_words").cast("long")
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("vl_words", F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")))
    return at.withColumn("text", F.when(F.size("vl_words") > 0, F.array_join(made, " ")).otherwise(F.col("text"))).drop("vl_words")


def digests(rows: DataFrame) -> DataFrame:
    """The rows of periodic_runs() with the run of the greatest exact exponent and digests in place of lists and texts."""
    runs = F.col("runs")
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best: Column = F.aggregate(runs, none, lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return rows.withColumn("best", best).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
