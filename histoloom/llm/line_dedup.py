"""Near-equal lines by a segment-partition edit join.

Two lines are linked if their edit distance is at most `edits`. A line is split into edits + 1 segments; within that
distance some segment k of the shorter line stands unchanged in the longer one, with at most k edits on its left and
edits - k on its right. Each line is therefore indexed under its segments, keyed by segment number and line length, and
probed with the few substrings that can match at each length. Character-count sketches thin out the pairs inside the join,
and a banded bit-parallel edit distance, many pairs at once, decides.

A segment that more than CROWD lines share makes no pairs. What stands left and right of it is split in turn, with the edits
that are left for it (a side with none left has to be equal), until groups are small or differ in no more characters than
there are edits. Pairs are then those of the groups, so no link is left out.

Lines are compared trimmed. Lines under `min_chars` characters take no part: such lines (brackets, single words) repeat
everywhere without being copies. The first occurrence of a class (by doc_id, then the document's hash, then line number) is
kept. Lines have 64-bit ids; those that would share one get others.

Defined cases: null and empty texts have no lines; null doc_ids rank last; rows equal in doc_id and text count as one
document; lines and texts of any length are compared whole; an empty table gives no rows; all other columns, whatever their
names, are carried by drop_lines and ignored elsewhere.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.llm import rows as whole
from histoloom.llm.components import connected_components
from histoloom.llm.workers import tidied
from histoloom.session import stage

#: Rows up to which a table of line numbers or ids is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Crowded keys up to which they are broadcast; beyond it the join shuffles.
BROADCAST_CROWDS = 200_000
#: Lines of a key that are joined pair by pair; each further split of a group doubles it.
CROWD = 64
#: Bits of a filter over index keys: for each key, and at most. A full filter lets through what the join drops.
FILTER_BITS, MOST_BITS = 8, 1 << 28
#: Bits of a tag that hold a line's length; longer ones count as of the largest.
_LENGTH_BITS = 15


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, doc (hash of doc_id and text), line_no (from 0) and line of the lines that take part."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line")).where(F.length("line") >= min_chars)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of the segments of a line: sizes differ by one at most, longer ones last."""
    size, longer = divmod(length, edits + 1)
    sizes = [size + (k > edits - longer) for k in range(edits + 1)]
    return [(sum(sizes[:k]), n) for k, n in enumerate(sizes)]


def probes(length: int, other: int, edits: int) -> Iterator[tuple[int, int, int]]:
    """(segment, start, size) of the substrings of a line that can equal a segment of a line of `other` <= length characters."""
    shift = length - other
    for k, (at, size) in enumerate(segments(other, edits)):
        # With k edits at most on the left and edits - k on the right, if this is the first segment that stands unchanged.
        low = max(at - k, at + shift - (edits - k), 0)
        high = min(at + k, at + shift + (edits - k), length - size)
        for start in range(low, high + 1):
            yield k, start, size


@functools.lru_cache(maxsize=4096)
def _layout(length: int, edits: int, probing: bool) -> tuple[list[tuple[int, int, int]], list[bool]]:
    """(start, end, salt) of the substrings of a line that are its keys, and which of them are segments of its own: these meet the line itself. The salt holds the indexed line's length and the segment."""
    own = [(at, at + n, length * 64 + k) for k, (at, n) in enumerate(segments(length, edits))]
    if not probing:
        return own, [True] * len(own)
    found = [(at, at + n, other * 64 + k) for other in range(max(0, length - edits), length + 1) for k, at, n in probes(length, other, edits)]
    return found, [x in own for x in found]


#: Class of a character by the first byte of its UTF-8 form; the bytes that follow the first count for nothing.
_CLASSES = np.where((np.arange(256) & 0xC0) == 0x80, 16, np.arange(256) % 31 & 15)


def sketches(lines: pa.Array) -> np.ndarray:
    """Counts of characters in 16 classes, modulo 8, as one number for each line."""
    lines = lines.cast(pa.large_binary())
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    place = np.repeat(np.arange(len(lines)) * 17, np.diff(offsets))
    place += _CLASSES[data]
    return (np.bincount(place, minlength=17 * len(lines)).reshape(-1, 17)[:, :16] & 7) @ (1 << np.arange(0, 48, 3))


def keyed(distinct: DataFrame, edits: int, probing: bool, kept: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(key, id, tag): the index keys or the probe keys of distinct lines; tag: sketch, then length. kept: filters over all index keys and over repeated ones; what they rule out is left away."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            lines = batch.column("line").to_pylist()
            tags = sketches(batch.column("line")) << _LENGTH_BITS
            tags |= np.fromiter((min(len(x), (1 << _LENGTH_BITS) - 1) for x in lines), np.int64, len(lines))
            keys: list[int] = []
            own: list[bool] = []
            counts = []
            for line in lines:
                places, mine = _layout(len(line), edits, probing)
                keys += [digest(line[a:b], salt) for a, b, salt in places]
                own += mine
                counts.append(len(places))
            found, at = np.array(keys, np.uint64), np.repeat(np.arange(len(lines)), counts)
            if kept is not None:
                passed = _passed(kept, found, np.array(own, bool))
                found, at = found[passed], at[passed]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column("id").take(pa.array(at)), pa.array(tags[at])], ["key", "id", "tag"])

    return distinct.select("id", "line").mapInArrow(tidied(make), "key long, id long, tag long")


def _passed(kept: tuple[np.ndarray, np.ndarray], keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    has = lambda bits: bits[((keys >> np.uint64(6)) & np.uint64(len(bits) - 1)).astype(np.int64)] >> (keys & np.uint64(63)) & np.uint64(1) == 1
    return np.where(own, has(kept[1]), has(kept[0]))


def _filter(keys: DataFrame) -> np.ndarray:
    """Bits by the low end of the keys: of bounded size, so it lets more through where keys are many."""
    n, bits = keys.count(), 1 << 16
    while bits < min(n * FILTER_BITS, MOST_BITS):
        bits *= 2
    if n > 2 * MOST_BITS:  # all bits would be set
        return np.full(1, -1, np.int64).view(np.uint64)
    place = F.shiftrightunsigned("key", 6).bitwiseAND(F.lit(bits // 64 - 1)).alias("place")
    rows = keys.groupBy(place).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


# A hit is where a key was found in a line, as one tuple for each part of the line that may still hold edits:
# (start and end of the part, edits, length of the part in indexed lines, segment: start in the part, start in indexed lines, size, number).


def first_hits(line: str, key: int, edits: int) -> Iterator[tuple[bool, tuple]]:
    """(whether as a probe, hit) for every way in which a line has a key of `keyed`."""
    for probing in (False, True):
        for start, end, salt in _layout(len(line), edits, probing)[0]:
            if xxhash.xxh64_intdigest(line[start:end], salt) == key % (1 << 64):
                length, number = divmod(salt, 64)
                at, size = segments(length, edits)[number]
                yield probing, ((0, len(line), edits, length, start, at, size, number),)


#: How lines of one key are dealt with: all pairs as long as they are few; all pairs, as no split is left.
BY_SIZE, ALL = 0, 1


def split_further(line: str, key: int, probing: bool, hit: tuple) -> Iterator[tuple[int, int, tuple]]:
    """(key, how, hit) of a line one split further: sides without edits are equal, one segment of each other side is unchanged."""
    exact, sides = [str(key)], []
    for start, end, edits, length, own, at, size, number in hit:
        left = (start, start + own, number, at)
        right = (start + own + size, end, edits - number, length - at - size)
        for a, b, left_over, other in (left, right):
            if abs(b - a - other) > left_over:
                return
            if not left_over:
                exact.append(line[a:b])
            elif max(b - a, other) > left_over:
                sides.append((a, b, left_over, other))
    digest = lambda *more: xxhash.xxh64_intdigest("\x00".join([*map(str, map(len, exact)), *exact, *more])) - (1 << 63)
    if not sides:
        yield digest(), ALL, ()
        return
    how = ALL if any(other <= edits for _, _, edits, other in sides) else BY_SIZE
    choices = []
    for a, b, edits, other in sides:
        places = [(k, at, at, n) for k, (at, n) in enumerate(segments(other, edits))]
        if probing:
            places = [(k, at, places[k][1], n) for k, at, n in probes(b - a, other, edits)]
        choices.append([((a, b, edits, other, own, at, n, k), f"{k} {line[a + own : a + own + n]}") for k, own, at, n in places])
    for chosen in itertools.product(*choices):
        yield digest(*(text for _, text in chosen)), how, tuple(part for part, _ in chosen)


def _split(members: DataFrame, texts: DataFrame, edits: int, first: bool) -> DataFrame:
    """(key, id, probing, how, hit): the lines of crowded keys one split further. members: key, id and, but for the first split, probing and hit."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                hits = first_hits(row["line"], row["key"], edits) if first else [(row["probing"], tuple(map(tuple, row["hit"])))]
                for probing, hit in hits:
                    out += [(key, row["id"], probing, how, after) for key, how, after in split_further(row["line"], row["key"], probing, hit)]
            if out:
                kinds = pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "id", "probing", "how", "hit"])

    return members.join(texts, "id").mapInArrow(tidied(make), "key long, id long, probing boolean, how int, hit array<array<int>>")


def _met(index: DataFrame, probe: DataFrame, crowds: DataFrame, allowed: Column) -> DataFrame:
    """(a, b, crowded): pairs of indexed and probing lines of a key; for keys in crowds (key, first) no pairs, but each probing line as b with the first indexed one, and the key as crowded."""
    crowds = stage(crowds, "crowds")
    if crowds.count() <= BROADCAST_CROWDS:
        crowds = F.broadcast(crowds)
    index = index.join(crowds, "key", "left").where("first is null or a = first")
    crowded = F.col("first").isNotNull()
    pairs = index.join(probe, (index["key"] == probe["key"]) & (crowded | ((F.col("a") != F.col("b")) & allowed)))
    low, high = (F.when(crowded, x).otherwise(y) for x, y in ((F.col("a"), F.least("a", "b")), (F.col("b"), F.greatest("a", "b"))))
    return pairs.select(low.alias("a"), high.alias("b"), F.when(crowded, index["key"]).alias("crowded")).distinct()


def candidates(distinct: DataFrame, edits: int, crowd: int = CROWD) -> DataFrame:
    """(a, b, crowded): pairs of lines that share a segment and whose sketches allow the distance; lines b of a crowded segment."""
    index = stage(keyed(distinct, edits, False), "line-index")
    counts = stage(index.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")), "line-keys")
    probe = keyed(distinct, edits, True, (_filter(counts), _filter(counts.where("n > 1"))))
    longest = (1 << _LENGTH_BITS) - 1
    length = lambda c: F.col(c).bitwiseAND(F.lit(longest))
    differing = F.shiftrightunsigned(F.col("tag_a").bitwiseXOR(F.col("tag_b")), _LENGTH_BITS)
    differing = differing.bitwiseOR(F.shiftrightunsigned(differing, 1)).bitwiseOR(F.shiftrightunsigned(differing, 2))
    classes = F.bit_count(differing.bitwiseAND(F.lit(sum(1 << k for k in range(0, 48, 3)))))  # an edit changes the counts of two classes at most
    once = (length("tag_a") < length("tag_b")) | (F.col("a") < F.col("b")) | (length("tag_a") == longest)
    crowds = counts.where(F.col("n") > crowd).select("key", "first")
    return _met(index.toDF("key", "a", "tag_a"), probe.toDF("key", "b", "tag_b"), crowds, once & (classes <= 2 * edits))


def _matrix(texts: list[np.ndarray], width: int, before: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), before + width), fill, np.uint32)
    for k, t in enumerate(texts):
        out[k, before : before + len(t)] = t
    return out


def within(lines: list[str], others: list[str], edits: int) -> np.ndarray:
    """Whether each pair's edit distance is at most `edits` (1 to 31): bit-parallel along a band of diagonals, all pairs at once."""
    result = np.zeros(len(lines), bool)
    one, two, at = [], [], []
    for k, (a, b) in enumerate(zip(lines, others)):
        if abs(len(a) - len(b)) > edits:
            continue
        x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in ((a, b) if len(a) >= len(b) else (b, a)))
        n = len(y)
        same = x[:n] == y
        lead = n if same.all() else int(np.argmin(same))
        same = x[len(x) - n + lead :][::-1] == y[lead:][::-1]
        tail = n - lead if same.all() else int(np.argmin(same))
        # What both begin and end with is left out, but for as many characters as the band needs.
        lead, tail = max(0, lead - edits), max(0, tail - edits)
        x, y = x[lead : len(x) - tail], y[lead : n - tail]
        if len(x) <= edits:
            result[k] = True
        else:
            one.append(x), two.append(y), at.append(k)
    order = np.argsort([len(x) for x in one], kind="stable")
    for first in range(0, len(order), 4096):
        some = order[first : first + 4096]
        x, y = [one[k] for k in some], [two[k] for k in some]
        n, m = (np.fromiter(map(len, z), np.int64, len(z)) for z in (x, y))
        left, right = _matrix(x, int(n.max()) + edits + 1, edits, 0xFFFFFFFF), _matrix(y, int(n.max()) + edits + 1, 0, 0xFFFFFFFE)
        band = np.uint64((1 << (2 * edits + 1)) - 1)
        plus = np.full(len(x), band & ~np.uint64((1 << edits) - 1), np.uint64)
        minus, distance, unit = np.zeros(len(x), np.uint64), np.full(len(x), edits, np.int64), np.uint64(1)
        for j in range(int(m.max())):
            equal = np.zeros(len(x), np.uint64)
            for k in range(2 * edits + 1):
                if j + k < left.shape[1]:
                    equal |= (left[:, j + k] == right[:, j]).astype(np.uint64) << np.uint64(k)
            zero = ((((equal & plus) + plus) ^ plus) | equal | minus) & band
            up, down = minus | (band & ~(zero | plus)), zero & plus
            diagonal = j < n - edits
            last = np.clip(edits - 1 + n - j, 0, 63).astype(np.uint64)
            along = ((up >> last) & unit).astype(np.int64) - ((down >> last) & unit).astype(np.int64)
            distance += np.where(diagonal, 1 - ((zero >> np.uint64(2 * edits)) & unit).astype(np.int64), np.where(j < m, along, 0))
            plus, minus = (down | ~((zero >> unit) | up)) & band, (zero >> unit) & up
        result[np.asarray(at)[some]] = distance <= edits
    return result


def _links(pairs: DataFrame, distinct: DataFrame, edits: int) -> DataFrame:
    """Those of staged pairs (a, b) whose lines are within the distance."""
    few = pairs.count() <= BROADCAST_ROWS
    sides = pairs.join(_texts(distinct, pairs.select("a"), few, "a", "line_a"), "a").join(_texts(distinct, pairs.select("b"), few, "b", "line_b"), "b")

    @F.pandas_udf("boolean")
    def close(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(within(one.tolist(), two.tolist(), edits))

    return stage(sides.where(close("line_a", "line_b")).select("a", "b"), "line-checks")


def _texts(distinct: DataFrame, ids: DataFrame, few: bool, name: str, line: str = "line") -> DataFrame:
    """(id, line) of the lines that are asked for, by these names. few: ids are broadcast."""
    needed = ids.toDF("id")
    return distinct.select("id", "line").join(F.broadcast(needed) if few else needed, "id", "left_semi").toDF(name, line)


def linked_lines(distinct: DataFrame, edits: int, crowd: int = CROWD) -> DataFrame:
    """(a, b) of the ids of all distinct lines within the edit distance; segments that more than `crowd` lines share are split further."""
    met, split, links = stage(candidates(distinct, edits, crowd), "line-pairs"), None, None
    while True:
        found = _links(met.where("crowded is null").select("a", "b"), distinct, edits)
        links = found if links is None else links.union(found)
        crowded = met.where("crowded is not null").select(F.col("crowded").alias("key"), F.col("b").alias("id"))
        if not crowded.take(1):
            return links.distinct()
        members = crowded if split is None else split.select("key", "id", "probing", "hit").join(crowded.select("key").distinct(), "key")
        members = stage(members, "crowd-members")
        crowd *= 2
        split = stage(_split(members, _texts(distinct, members.select("id"), members.count() <= BROADCAST_ROWS, "id"), edits, split is None), "split-lines")
        index, probe = split.where("not probing").select("key", F.col("id").alias("a"), "how").distinct(), split.where("probing").select("key", F.col("id").alias("b")).distinct()
        counts = index.groupBy("key", "how").agg(F.count("*").alias("n"), F.min("a").alias("first"))
        crowds = counts.where((F.col("how") == BY_SIZE) & (F.col("n") > crowd)).select("key", "first")
        met = stage(_met(index.drop("how"), probe, crowds, F.lit(True)), "line-pairs")


def _clashing(distinct: DataFrame) -> list[int]:
    """Hashes that several lines share: n * n / 2^65 of n lines."""
    return [r[0] for r in distinct.groupBy("hash").count().where("count > 1").select("hash").collect()]


def _hash() -> Column:
    return F.xxhash64("line")


def line_classes(docs: DataFrame, edits: int = 2, min_chars: int = 20, crowd: int = CROWD, short_lines: bool = False) -> DataFrame:
    """short_lines: lines of under `min_chars` characters (but for empty ones) take part, too, as copies of equal ones.

    One row for each line that takes part: doc_id, doc, line_no, kept, n_links (different lines within the distance) and its class, named by doc_id and line number of the kept line."""
    lines = lines_of(docs, 1 if short_lines else min_chars)
    distinct = stage(lines.groupBy("line").agg(F.count("*").alias("n")).select(_hash().alias("hash"), "line"), "distinct-lines")
    clashing = _clashing(distinct)
    number = F.when(_hash().isin(clashing), F.xxhash64(F.lit(1), "line")).otherwise(_hash()).alias("id") if clashing else _hash().alias("id")
    distinct = distinct.select(number, "line")
    occurrences = stage(lines.select("doc_id", "doc", "line_no", number), "line-occurrences")
    edges = stage(linked_lines(distinct.where(F.length("line") >= min_chars), edits, crowd), "line-links")
    counts = edges.select(F.col("a").alias("id")).union(edges.select("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    roots = connected_components(edges).select(F.col("node").alias("id"), "root")
    known = stage(roots.join(counts, "id"), "line-classes")
    rows = occurrences.join(known, "id", "left").withColumns({"root": F.coalesce("root", "id"), "n_links": F.coalesce("n_links", F.lit(0).cast("long"))})
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc", "line_no")
    # Only classes of several lines need a first one: the others' single line is kept.
    several = stage(rows.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-firsts")
    marked = rows.join(several, "root", "left")
    kept = F.col("first").isNull() | ((F.col("doc") == F.col("first.doc")) & (F.col("line_no") == F.col("first.line_no")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    mine = F.when(F.col("first").isNull(), F.struct("doc_id", "line_no")).otherwise(F.struct("first.doc_id", "first.line_no"))
    return marked.select("doc_id", "doc", "line_no", kept.alias("kept"), "n_links", mine["doc_id"].alias("class_doc_id"), mine["line_no"].alias("class_line_no"))


def drop_lines(docs: DataFrame, edits: int = 2, min_chars: int = 20, short_lines: bool = False) -> DataFrame:
    """docs with all lines but the kept one of each class taken out of text; every row stays. short_lines: repeated lines of under `min_chars` characters go, too."""
    gone = stage(line_classes(docs, edits, min_chars, short_lines=short_lines).where("not kept").groupBy("doc_id", "doc").agg(F.collect_set("line_no").alias("gone")), "gone-lines")
    if (gone.agg(F.sum(F.size("gone") + 2)).first()[0] or 0) <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    doc_id, text = whole.field("doc_id").cast("long"), whole.field("text").cast("string")
    joined = whole.packed(docs).join(gone, (F.xxhash64(doc_id, text) == F.col("doc")) & doc_id.eqNullSafe(F.col("doc_id")), "left")
    # between one line that goes and the next, slices of the lines stay
    lines, out = F.split(text, "\n"), F.array_sort("gone")
    spans = F.arrays_zip(F.concat(F.array(F.lit(-1)), out).alias("after"), F.concat(out, F.array(F.size(lines))).alias("upto"))
    left = F.flatten(F.transform(spans, lambda s: F.slice(F.col("_lines"), s["after"] + 2, s["upto"] - s["after"] - 1)))
    joined = joined.withColumn("_lines", F.when(F.col("gone").isNotNull(), lines))
    return whole.unpacked(joined, docs.schema, text=F.when(F.col("gone").isNull(), whole.field("text")).otherwise(F.array_join(left, "\n")))
