"""Repeated passages by hashing lines, paragraphs or sentences, and windows of words.

Every unit is normalised (lower case, white space runs as one space) and hashed to 128 bits; digests are grouped over all
documents; the occurrence that ranks first (doc_id, then position) is kept and the others are marked. Marked units that
follow each other form a span; spans of `min_words` words or more are removed, at offsets of the original text. Units
under `unit_words` words carry no evidence: they neither start nor break a span.

repeated_passages adds to these spans every window of `min_words` words that stood before, wherever units begin and end.
A window is looked at only where its least shingle of half as many words (a function of the window alone) occurs twice or
more, so windows of text that stands once are not shuffled and none that repeats is lost. Windows that share one place of
their least shingle are a run; equal runs hold the same windows, and only where different runs share a least shingle are
single windows compared. A window that overlaps its own kept occurrence is no repeat. Lines (or other units) that repeat as wholes
need fewer words, `span_words`, than windows do.

Defined cases: null and empty texts have no units; null doc_ids rank last and their spans carry null; repeated rows are
occurrences like any other, so all but one lose their text; of equal occurrences in rows of one doc_id the one that stands
first in the table is kept; texts of any length are read whole, and a window or unit of any length has one digest; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.llm import rows as whole
from histoloom.llm.workers import tidied
from histoloom.session import release, scratch, stage

#: Where a unit ends.
ENDS = {"line": r"\n", "paragraph": r"\n\s*\n", "sentence": r"\n|[.!?]+(?=\s)"}
_UNITS = pa.schema([("doc_id", pa.int64()), ("position", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("high", pa.int64()), ("low", pa.int64())])
BATCH_UNITS = 100_000
_PIECES = pa.schema([("doc_id", pa.int64()), ("position", pa.int32()), ("window", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("word", pa.int32()), ("words", pa.int32()), ("high", pa.int64()), ("low", pa.int64()), ("digests", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
_PIECES_SQL = "doc_id long, position int, window boolean, start int, end int, word int, words int, high long, low long, digests array<long>, starts array<int>, ends array<int>"
#: Bits of the filter over repeated shingles: for each shingle, and at most. A full filter lets windows through that the grouping drops.
FILTER_BITS, MOST_BITS = 32, 1 << 28
#: Words that windows are sought in at a time, as far as documents are not longer, and distinct words whose hashes a task keeps.
WINDOW_WORDS, KNOWN_WORDS = 200_000, 300_000


def split_units(text: str, ends: re.Pattern) -> Iterator[tuple[int, int]]:
    """(start, end) of the units of a text; together they cover it."""
    start = 0
    for match in ends.finditer(text):
        yield start, match.end()
        start = match.end()
    if start < len(text):
        yield start, len(text)


def units(docs: DataFrame, unit: str = "sentence", unit_words: int = 4) -> DataFrame:
    """Units with evidence: doc_id, position among them, start, end, words and the digest's halves."""
    ends = ENDS[unit]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, digest = re.compile(ends), xxhash.xxh3_128_digest
        rows: list[tuple] = []
        digests: list[bytes] = []

        def out() -> pa.RecordBatch:
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _UNITS)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(halves[:, 0]), pa.array(halves[:, 1])], schema=_UNITS)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                position, text = 0, text.as_py() or ""
                for start, end in split_units(text, pattern):
                    words = text[start:end].lower().split()
                    if len(words) < unit_words:
                        continue
                    rows.append((doc_id, position, start, end, len(words)))
                    digests.append(digest(" ".join(words).encode()))
                    position += 1
                if len(rows) >= BATCH_UNITS:
                    yield out()
                    rows.clear(), digests.clear()
        if rows:
            yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(cut), "doc_id long, position int, start int, end int, words int, high long, low long")


def repeated_spans(docs: DataFrame, unit: str = "sentence", unit_words: int = 4, min_words: int = 25) -> DataFrame:
    """Spans to remove: doc_id, span_start, span_end (characters of the original text), words, kept_doc_id (holder of the first unit's kept occurrence)."""
    # Rows of one document stand together and in order, so a document's first unit tells documents of one doc_id apart.
    found = stage(units(docs, unit, unit_words).withColumn("at", F.monotonically_increasing_id()), "units").withColumn("row", F.col("at") - F.col("position"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "position")
    repeated = found.groupBy("high", "low").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = stage(repeated, "repeated")  # its own table, so that the join can split a digest that holds many rows
    later = found.join(repeated, ["high", "low"]).where((F.col("row") != F.col("kept.row")) | (F.col("position") != F.col("kept.position")))
    ordered = Window.partitionBy("row").orderBy("position")
    runs = later.withColumn("run", F.col("position") - F.row_number().over(ordered))
    spans = runs.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.sum("words").alias("words"), F.min_by("kept.doc_id", "position").alias("kept_doc_id"))
    return spans.where(F.col("words") >= min_words).drop("row", "run")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word.encode())
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class _Runs:
    """Hashes of any runs of words, from running sums: equal for equal runs, wherever they stand."""

    def __init__(self, words: np.ndarray, factor: int):
        n = len(words)
        size = 1 << max(18, n.bit_length())  # few sizes, so that powers are made once
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * _powers(factor, size)[:n], out=self._sums[1:])
        self._back = _powers(pow(factor, -1, 1 << 64), size)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[end] - self._sums[start]) * self._back[start] + (end - start).astype(np.uint64))


_SHINGLE, _WINDOW, _UNIT_ONE, _UNIT_TWO = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def _least(values: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every `each` neighbouring values and its place, the first of equal ones."""
    place, width = np.arange(len(values)), 1
    while width < each:
        step = min(width, each - width)
        other = values[step:] < values[: len(values) - step]
        place = np.where(other, place[step:], place[: len(place) - step])
        values = np.where(other, values[step:], values[: len(values) - step])
        width += step
    return values, place


def _windows(words: np.ndarray, owner: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window inside one document: its first word, its least shingle and the place of that."""
    width = (min_words + 1) // 2
    each = min_words - width + 1
    n = len(words) - width + 1
    if n < each:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.arange(n)
    least, place = _least(_Runs(words, _SHINGLE).of(starts, starts + width), each)
    at = np.nonzero(owner[: len(words) - min_words + 1] == owner[min_words - 1 :])[0]
    return at, least[at], place[at]


def _gathered(batches: Iterator[pa.RecordBatch], known: _WordHashes) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """(doc_ids, texts, hashes of their words, owner of each word), many words at a time."""
    ids, texts, hashes, sizes = [], [], [], []

    def out() -> tuple[list, list, np.ndarray, np.ndarray]:
        return ids, texts, np.array(hashes, np.uint64), np.repeat(np.arange(len(sizes)), sizes)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            text = text or ""
            before = len(hashes)
            hashes.extend(map(known.__getitem__, text.lower().split()))
            ids.append(doc_id), texts.append(text), sizes.append(len(hashes) - before)
            if len(hashes) >= WINDOW_WORDS:
                yield out()
                ids, texts, hashes, sizes = [], [], [], []
    if ids:
        yield out()


#: Characters that str.split() takes for white space.
_SPACES = np.array([k for k in range(0x3001) if chr(k).isspace()], np.uint32)
_IS_SPACE = np.isin(np.arange(256, dtype=np.uint32), _SPACES)


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of every word."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = np.ones(len(codes) + 2, bool)
    space[1:-1] = _IS_SPACE[np.minimum(codes, 255)]
    large = np.nonzero(codes > 255)[0]
    space[large + 1] = np.isin(codes[large], _SPACES)
    edges = np.nonzero(np.diff(space))[0]
    return edges[::2], edges[1::2]


def repeated_shingles(docs: DataFrame, min_words: int) -> np.ndarray:
    """A filter over the least shingles of windows that occur twice or more: bits by the shingle's low end, of bounded size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, words, owner in _gathered(batches, _WordHashes()):
            _, least, place = _windows(words, owner, min_words)
            yield pa.RecordBatch.from_arrays([pa.array(least[np.nonzero(np.diff(place, prepend=-1))[0]].view(np.int64))], ["shingle"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(cut), "shingle long")
    found = stage(found.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle"), "shingles")
    bits = min(1 << 16, MOST_BITS)
    n = found.count()
    while bits < min(n * FILTER_BITS, MOST_BITS):
        bits *= 2
    place = F.shiftrightunsigned("shingle", 6).bitwiseAND(F.lit(bits // 64 - 1)).alias("place")
    rows = found.groupBy(place).agg(F.bit_or(F.expr("shiftleft(1L, cast(shingle & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def pieces(docs: DataFrame, likely: np.ndarray, unit: str, unit_words: int, min_words: int) -> DataFrame:
    """Units with evidence, then the runs of windows whose least shingle the filter holds: doc_id, position among both, whether a run, start, end, first word, words, the digest's halves (a run's first is its shingle), and of each window of a run digest, start and end."""
    ends = ENDS[unit]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(ends)
        for ids, texts, words, owner in _gathered(batches, _WordHashes()):
            at, least, place = _windows(words, owner, min_words)
            passed = likely[((least >> np.uint64(6)) & np.uint64(len(likely) - 1)).astype(np.int64)] >> (least & np.uint64(63)) & np.uint64(1) == 1
            at, least, place = at[passed], least[passed].view(np.int64), place[passed]
            opens = np.nonzero(np.diff(place, prepend=-1))[0]  # where runs begin
            closes = np.append(opens[1:], len(at))[: len(opens)]
            firsts = np.searchsorted(owner, np.arange(len(ids) + 1))
            begins, finishes, edges = [], [], []
            for k, text in enumerate(texts):
                a, b = word_spans(text)
                begins.append(a), finishes.append(b)
                cuts = [m.end() for m in pattern.finditer(text)]
                if text and (not cuts or cuts[-1] < len(text)):
                    cuts.append(len(text))
                offsets = np.array([0, *cuts])
                edges.append((np.full(len(cuts), k), offsets[:-1], offsets[1:], firsts[k] + np.searchsorted(a, offsets[:-1]), firsts[k] + np.searchsorted(a, offsets[1:])))
            begin, finish = (np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32) for x in (begins, finishes))
            doc, start, end, first, last = (np.concatenate(x) for x in zip(*edges))
            evident = last - first >= unit_words
            doc, start, end, first, last = (x[evident] for x in (doc, start, end, first, last))
            units_of = np.bincount(doc, minlength=len(ids))
            position = np.arange(len(doc)) - np.repeat(np.cumsum(units_of) - units_of, units_of)
            halves = [_Runs(words, f).of(first, last).view(np.int64) for f in (_UNIT_ONE, _UNIT_TWO)]
            run_first, run_last = at[opens], at[closes - 1] + min_words
            run_doc = owner[run_first]
            runs_of = np.bincount(run_doc, minlength=len(ids))
            run_position = np.arange(len(opens)) - np.repeat(np.cumsum(runs_of) - runs_of, runs_of) + units_of[run_doc]
            run_halves = [least[opens], _Runs(words, _WINDOW).of(run_first, run_last).view(np.int64)]
            all_docs = np.concatenate([doc, run_doc])
            order = np.argsort(all_docs, kind="stable")  # a document's units, then its runs
            both = lambda x, y, kind: pa.array(np.concatenate([x, y]).astype(kind)[order])
            columns = [
                pa.array(ids, pa.int64()).take(pa.array(all_docs[order])),
                both(position, run_position, np.int32),
                both(np.zeros(len(doc)), np.ones(len(opens)), bool),
                both(start, begin[run_first], np.int32),
                both(end, finish[run_last - 1], np.int32),
                both(first - firsts[doc], run_first - firsts[run_doc], np.int32),
                both(last - first, run_last - run_first, np.int32),
                *(both(x, y, np.int64) for x, y in zip(halves, run_halves)),
            ]
            # Runs stand in the order of their windows, so the lists' elements do, too.
            sizes = np.concatenate([np.zeros(len(doc), np.int64), closes - opens])[order]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            windows = _Runs(words, _WINDOW).of(at, at + min_words).view(np.int64)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (windows, begin[at], finish[at + min_words - 1])]
            if len(order):
                yield pa.RecordBatch.from_arrays([*columns, *lists], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(cut), _PIECES_SQL)


def _islands(rows: DataFrame, start: str, end: str) -> DataFrame:
    """rows with the number `island` of the stretch of overlapping or touching intervals that each belongs to, by `row`."""
    before = Window.partitionBy("row").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    to_here = Window.partitionBy("row").orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins: Column = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True))
    return rows.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(to_here)).drop("begins")


def _later_pieces(docs: DataFrame, unit: str, unit_words: int, min_words: int) -> DataFrame:
    """Units and windows that stood before, with the holder of their kept occurrence."""
    likely = repeated_shingles(docs, min_words)
    found = stage(pieces(docs, likely, unit, unit_words, min_words).withColumn("at", F.monotonically_increasing_id()), "pieces").withColumn("row", F.col("at") - F.col("position"))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "position", "word")
    runs_of = found.where("window").select("high", "low").distinct()
    grouped = stage(found.groupBy("high", "low").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "grouped")
    # Least shingles of different runs: there the first occurrence of each window is sought among the kept runs.
    mixed = stage(runs_of.groupBy("high").agg(F.count("*").alias("runs")).where("runs > 1").select("high"), "mixed")
    single = found.where("window").join(mixed, "high").groupBy("high", "low").agg(F.min(rank).alias("kept"), F.first("digests").alias("digests"))
    single = single.select("high", "low", "kept", F.posexplode("digests").alias("nth", "digest"))
    single = single.withColumn("kept", F.col("kept").withField("word", F.col("kept.word") + F.col("nth")))
    single = stage(single, "single-windows")
    first = stage(single.groupBy("high", "digest").agg(F.min("kept").alias("first")), "first-windows")
    first = stage(single.select("high", "low", "nth", "digest").join(first, ["high", "digest"]).groupBy("high", "low").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"), F.col("first.word").alias("word")))).alias("firsts")), "firsts-of-runs")
    whole = grouped.join(first.select("high", "low"), ["high", "low"], "left_anti")
    repeated = stage(whole, "repeated")  # its own table, so that the join can split a digest that holds many rows
    plain = found.drop("digests", "starts", "ends").join(repeated, ["high", "low"])
    same_row, apart = F.col("row") == F.col("kept.row"), F.col("word") >= F.col("kept.word") + min_words
    plain = plain.where(~same_row | F.when(F.col("window"), apart).otherwise(F.col("position") != F.col("kept.position")))
    plain = plain.select("doc_id", "row", "position", "window", "start", "end", "word", "words", F.col("kept.doc_id").alias("kept_doc_id"))
    each = found.where("window").join(first, ["high", "low"]).select("doc_id", "row", "position", "window", "word", F.explode(F.arrays_zip("starts", "ends", "firsts")).alias("w"))
    each = each.select("doc_id", "row", "position", "window", F.col("w.starts").alias("start"), F.col("w.ends").alias("end"), (F.col("word") + F.col("w.firsts.nth")).alias("word"), F.lit(min_words).alias("words"), F.col("w.firsts.doc_id").alias("kept_doc_id"), F.col("w.firsts.row").alias("_row"), F.col("w.firsts.word").alias("_word"))
    each = each.where((F.col("row") != F.col("_row")) | (F.col("word") >= F.col("_word") + min_words)).drop("_row", "_word")
    return stage(plain.unionByName(each), "later-pieces", keep=True)


def repeated_passages(docs: DataFrame, unit: str = "line", unit_words: int = 4, min_words: int = 50, span_words: int = 25) -> DataFrame:
    """The spans of repeated_spans (of `span_words` words or more) and every repeated window of `min_words` words, joined where they overlap or touch: doc_id, span_start, span_end, words (all in the span), kept_doc_id (holder of the first piece's kept occurrence)."""
    with scratch() as own:
        later = _later_pieces(docs, unit, unit_words, min_words)
    release(docs.sparkSession, own)
    bounds = [F.first("doc_id").alias("doc_id"), F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.min("word").alias("word"), F.max(F.col("word") + F.col("words")).alias("last"), F.min_by("kept_doc_id", "start").alias("kept_doc_id")]
    runs = later.where("not window").withColumn("run", F.col("position") - F.row_number().over(Window.partitionBy("row").orderBy("position")))
    by_unit = runs.groupBy("row", "run").agg(*bounds, F.sum("words").alias("words")).where(F.col("words") >= span_words).drop("run", "words")
    by_window = _islands(later.where("window"), "start", "end").groupBy("row", "island").agg(*bounds).drop("island")
    joined = _islands(by_unit.unionByName(by_window), "span_start", "span_end").groupBy("row", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), (F.max("last") - F.min("word")).cast("long").alias("words"), F.min_by("kept_doc_id", "span_start").alias("kept_doc_id")
    )
    return joined.drop("row", "island")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans cut out of text, and the kept stretches as (start, end) of the original text in `kept_spans` (which replaces a column of that name). doc_ids are unique here, one of them may be null."""
    docs = docs.drop("kept_spans")
    cuts = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("cuts"))
    text = whole.field("text").cast("string")
    joined = whole.packed(docs).join(cuts, whole.field("doc_id").cast("long").eqNullSafe(F.col("doc_id")), "left")
    edge = lambda c: F.coalesce(c, F.array().cast("array<int>"))
    opens = F.concat(F.array(F.lit(0)), edge(F.transform("cuts", lambda c: c["span_end"])))
    closes = F.concat(edge(F.transform("cuts", lambda c: c["span_start"])), F.array(F.length(text)))
    kept = F.filter(F.arrays_zip(opens.alias("start"), closes.alias("end")), lambda s: s["end"] > s["start"])
    joined = joined.withColumn("kept", kept)
    left = F.array_join(F.transform("kept", lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])), "")
    return whole.unpacked(joined, docs.schema, text=F.when(text.isNotNull(), left), kept_spans=F.col("kept"))
