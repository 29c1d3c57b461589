"""Periodic runs of words: every maximal stretch that repeats a period of words at least four times, by internal pattern matching.

Several texts are searched together, as one sequence of numbers in which no two texts share a number. Its suffix array comes
from prefix doubling, and with it, for each power of two B, the interval of the array that holds all occurrences of each
dyadic block (the B words from a multiple of B on).

A run of period q and length 4 q or more holds a whole block of B = 2^k words, B/2 <= q < B, and the block occurs again q
words on or q words before, still inside the run. Because B >= q, an occurrence nearer than q would give the run a smaller
period (Fine and Wilf), so occurrences of the block in its neighbouring windows are an arithmetic progression of difference
q, whose first member is the block's range successor (or predecessor): the nearest position in the interval beyond the
block's own. A wavelet tree over the suffix array answers that. Each difference is a candidate period, which is
extended to both sides by longest common extensions over the classes of the doubling; what is long enough is a run.

Defined cases: null and empty texts have no words and no runs; texts of any length are read whole, a long one is searched by
itself; repeated rows are searched each; further columns are carried, those named runs or collapsed are replaced; an
empty table gives no rows. Null doc_ids have no bearing here (see queries.op12_periodic_runs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histoloom.llm import rows
from histoloom.llm.workers import tidied

#: Words of several texts that are searched together; a longer text is searched alone.
WORDS_AT_ONCE = 1 << 16
#: Least repeats of the period in a run, and least words of a run.
REPEATS, LEAST_WORDS = 4, 6


class WaveletTree:
    """Numbers 0..n-1 in some order, by their bits from the highest on; each bit's ones are counted by words of 64."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.bits = max(1, int(self.n - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        values = values.astype(np.int32)
        for k in range(self.bits - 1, -1, -1):
            ones = (values >> k & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(self.n - ones.sum()))
            values = np.concatenate([values[~ones], values[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place of a level."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[level][word] + np.bitwise_count(below)

    def count_below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers at places low..high-1 are under each bound (0..n)."""
        found, low, high, whole = np.zeros(len(low), np.int64), low.astype(np.int64), high.astype(np.int64), high - low
        for level in range(self.bits):
            one = (bound >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = self._ones(level, low), self._ones(level, high)
            found += np.where(one, (high - b) - (low - a), 0)
            low, high = np.where(one, self.zeros[level] + a, low - a), np.where(one, self.zeros[level] + b, high - b)
        return np.where(bound >= self.n, whole, found)

    def select(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The number of each rank (from 0) among those at places low..high-1."""
        value, low, high, rank = np.zeros(len(low), np.int64), low.astype(np.int64), high.astype(np.int64), rank.astype(np.int64)
        for level in range(self.bits):
            a, b = self._ones(level, low), self._ones(level, high)
            zeros = (high - b) - (low - a)
            one = rank >= zeros
            rank = np.where(one, rank - zeros, rank)
            value = value << 1 | one
            low, high = np.where(one, self.zeros[level] + a, low - a), np.where(one, self.zeros[level] + b, high - b)
        return value


def doubled(numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The suffix array of texts side by side, and for k = 0, 1, ... the class of each place by its first 2^k words and the size of each class.

    numbers: the words as numbers, no two texts with one in common; ends: for each place the end of its text. A class is named
    by its first place in the suffix array. The last k is the first one at which no two places are alike.
    """
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    classes, sizes = [], []

    def named(ordered: np.ndarray, first: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and class size of rows in order; first: whether a row begins a class; base: the place of each row in the array."""
        at = np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
        count = np.diff(np.append(np.nonzero(first)[0], len(ordered)))
        return base[at], np.repeat(count, count)

    by = numbers[order]
    own, size = named(order, np.concatenate([[True], by[1:] != by[:-1]]), np.arange(n))
    rank, many = np.empty(n, np.int32), np.empty(n, np.int32)
    rank[order], many[order] = own, size
    classes.append(rank)
    sizes.append(many)
    step = 1
    while (open_ := np.nonzero(many[order] > 1)[0]).size:  # places of the array whose class is not settled
        rows = order[open_]
        beyond = rows + step
        inside = beyond < ends[rows]
        follow = np.where(inside, rank[np.minimum(beyond, n - 1)].astype(np.int64) + 1, 0)
        key = rank[rows].astype(np.int64) * (n + 1) + follow  # the end of a text comes before all words, and is like no other end
        by = np.argsort(key, kind="stable")
        rows, key, inside = rows[by], key[by], inside[by]
        order[open_] = rows
        first = np.concatenate([[True], (key[1:] != key[:-1]) | ~inside[1:]])
        own, size = named(rows, first, open_)
        rank, many = rank.copy(), many.copy()
        rank[rows], many[rows] = own, size
        classes.append(rank)
        sizes.append(many)
        step *= 2
    return order, classes, sizes


def _extension(classes: list[np.ndarray], a: np.ndarray, b: np.ndarray, begins: np.ndarray, ends: np.ndarray, forward: bool) -> np.ndarray:
    """Words that two places (a < b, one text) have in common from there on, or back from the words before them."""
    total, a, b = np.zeros(len(a), np.int64), a.copy(), b.copy()
    for k in range(len(classes) - 1, -1, -1):
        step = 1 << k
        if forward:
            fits = b + step <= ends
            same = fits & (classes[k][np.where(fits, a, 0)] == classes[k][np.where(fits, b, 0)])
            a, b = np.where(same, a + step, a), np.where(same, b + step, b)
        else:
            fits = a - step >= begins
            same = fits & (classes[k][np.where(fits, a - step, 0)] == classes[k][np.where(fits, b - step, 0)])
            a, b = np.where(same, a - step, a), np.where(same, b - step, b)
        total += np.where(same, step, 0)
    return total


def find_runs(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of texts side by side, in order of start and period; places count through all texts."""
    n = len(numbers)
    if not n:
        return np.zeros((0, 3), np.int64)
    text_end = np.cumsum(lengths)
    ends, begins = np.repeat(text_end, lengths), np.repeat(text_end - lengths, lengths)
    order, classes, sizes = doubled(numbers, ends)
    tree = None
    found = [np.zeros((0, 3), np.int64)]
    for k in range(1, len(classes)):
        block = 1 << k
        at = np.arange(0, n - block + 1, block)
        at = at[(at + block <= ends[at]) & (sizes[k][at] > 1)]
        if not len(at):
            continue
        tree = tree or WaveletTree(order)
        low = classes[k][at].astype(np.int64)
        high = low + sizes[k][at]
        upto = tree.count_below(low, high, at)  # occurrences before the block itself
        for after in (True, False):
            there = upto + 1 < high - low if after else upto > 0
            own = at[there]
            other = tree.select(low[there], high[there], upto[there] + 1 if after else upto[there] - 1)
            period = np.abs(other - own)
            near = (period >= block // 2) & (period < block)
            a, b = np.minimum(own, other)[near], np.maximum(own, other)[near]
            start = a - _extension(classes, a, b, begins[a], ends[a], False)
            end = b + _extension(classes, a, b, begins[a], ends[a], True)
            long = end - start >= np.maximum(LEAST_WORDS, REPEATS * period[near])
            found.append(np.stack([start, end, period[near]], axis=1)[long])
    runs = np.concatenate(found)
    return np.unique(runs, axis=0) if len(runs) else runs


def _searched(texts: list[list[bytes]]) -> list[tuple[list[dict], bytes]]:
    """Runs and collapsed text of each word sequence."""
    numbers, lengths, base = [], np.fromiter(map(len, texts), np.int64, len(texts)), 0
    for words in texts:
        known = {w: k for k, w in enumerate(dict.fromkeys(words), base)}
        numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        base += len(known)
    runs = find_runs(np.concatenate([*numbers, np.zeros(0, np.int64)]), lengths)
    begins = np.cumsum(lengths) - lengths
    cuts = np.searchsorted(runs[:, 0], np.append(begins, lengths.sum()))
    out = []
    for words, begin, low, high in zip(texts, begins.tolist(), cuts, cuts[1:]):
        if low == high:
            out.append(([], b" ".join(words)))
            continue
        own = runs[low:high] - [begin, begin, 0]
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, own[:, 0] + own[:, 2], 1)
        np.add.at(gone, own[:, 1], -1)
        kept = np.nonzero(np.cumsum(gone[:-1]) == 0)[0].tolist()
        out.append(([{"start": s, "length": e - s, "period": p} for s, e, p in own.tolist()], b" ".join([words[k] for k in kept])))
    return out


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `runs`, an array of (start, length, period) in words, by start and period, and `collapsed`: the words joined by one space, each run cut to its first period."""
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    whole = rows.packed(docs.select(*[rows.quoted(c) for c in names]))
    whole = whole.select(rows.ROW, F.coalesce(rows.field(text).cast("string"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, some, size = [], [], 0
            for text in batch.column("text"):
                words = text.as_py().encode().split()  # at ASCII white space
                if some and size + len(words) > WORDS_AT_ONCE:
                    out += _searched(some)
                    some, size = [], 0
                some.append(words)
                size += len(words)
            out += _searched(some)
            yield pa.RecordBatch.from_arrays([batch.column(rows.ROW), pa.array([r for r, _ in out], kind), pa.array([c for _, c in out], pa.binary()).cast(pa.string())], [rows.ROW, "runs", "collapsed"])

    runs = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    found = whole.mapInArrow(tidied(searched), T.StructType([whole.schema[rows.ROW], T.StructField("runs", runs), T.StructField("collapsed", T.StringType())]))
    return found.select(*[rows.field(c).alias(c) for c in names], "runs", "collapsed")
