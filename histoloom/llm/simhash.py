"""SimHash near-duplicates by vantage-point trees over Hamming distance, exact at any threshold.

Distances of unrelated 64-bit fingerprints gather at 32 +- 4, so one tree over whole fingerprints could prune little at a
radius of 4. The fingerprint is therefore cut into blocks, with trees over blocks: two fingerprints within t bits are within
t // blocks bits in some block, and with more than t blocks, blocks - t of them are equal. Each tree splits the values of
its block (or set of blocks) at median distances from vantage points; a fingerprint goes to its own leaf and to those
leaves that the triangle bound at the tree's radius cannot rule out (none at radius 0). Inside a leaf, a vantage-point tree
over whole fingerprints finds the exact pairs, of which a spanning forest is kept.

near_duplicates links fingerprints alone. similar_texts links texts by the Jaccard similarity of their five-word shingle
sets, exactly: texts meet where they share one of their first shingles (a prefix filter, in an order that puts common
shingles last), which misses no pair of the similarity whatever the order, and the sets themselves confirm each link.

Defined cases: null and empty texts have fingerprint zero, linked like any other; null doc_ids take part, and a component
of nothing else has a null component_id; repeated rows share a fingerprint, and drop_similar keeps one of them; texts of any length are read whole; an empty
table gives no rows; other columns, whatever their names, are carried by drop_similar and ignored elsewhere.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.llm import rows as whole
from histoloom.llm.components import connected_components
from histoloom.llm.superminhash import _MIX, PAIRED_SETS, Words, _mixed, likely, links_in_buckets, shingle_sets, sketch
from histoloom.llm.workers import tidied, tidied_group
from histoloom.session import stage

SEED = 42
#: Fingerprints that a leaf holds on average, as far as a block has values enough.
LEAF_ROWS = 1024
#: Fingerprints of one leaf that a task compares with as many others; larger leaves are dealt out as pairs of chunks.
CHUNK_ROWS = 8192
#: Points below which the exact search compares all.
SCAN_ROWS = 512
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, words_each: int = 4) -> int:
    """SimHash of a text over its word shingles, repeats included."""
    return fingerprint_of(text.encode().lower().split(), words_each)  # both touch ASCII only


def _hashes(words: list[bytes], words_each: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a word sequence; of the whole sequence, if it is shorter; nothing of no words."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_each, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], "<u8")


def fingerprint_of(words: list[bytes], words_each: int) -> int:
    """SimHash of a word sequence."""
    hashes = _hashes(words, words_each, SEED)
    if not len(hashes):
        return 0
    columns = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_each: int = 4) -> DataFrame:
    """(doc_id, bits): the fingerprint of every whole text as a signed 64-bit number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py() or "", words_each) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(hashed), "doc_id long, bits long")


@functools.lru_cache(maxsize=64)
def block_tree(width: int, leaves: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A vantage-point tree over all values of a block of `width` bits with about `leaves` leaves.

    Returns the leaf of each value, and as (ends, leaves) the other leaves that may hold values within the radius of it.
    """
    everything = np.arange(1 << width, dtype=np.uint32)
    home, visits = np.zeros(1 << width, np.int32), []
    least = max(1, (1 << width) // max(1, leaves))
    stack, leaf = [(everything, everything)], 0
    while stack:
        values, queries = stack.pop()
        if len(values) > least:
            vantage = values[0]
            far = np.bitwise_count(values ^ vantage)
            median = np.sort(far)[(len(far) - 1) // 2]
            if far.max() == median:
                median -= 1
            near = np.bitwise_count(queries ^ vantage).astype(np.int16)
            stack.append((values[far > median], queries[near + radius > median]))
            stack.append((values[far <= median], queries[near - radius <= median]))
            continue
        home[values] = leaf
        visits.append(np.stack([queries, np.full(len(queries), leaf)]))
        leaf += 1
    visited = np.concatenate(visits, axis=1)
    visited = visited[:, home[visited[0]] != visited[1]]
    visited = visited[:, np.argsort(visited[0], kind="stable")]
    return home, np.cumsum(np.bincount(visited[0], minlength=1 << width)), visited[1].astype(np.int32)


def route(distinct: DataFrame, n: int, threshold: int, blocks: int) -> DataFrame:
    """(tree, leaf, home, bits): every fingerprint in its leaf of each tree and, with home false, in the leaves it has to visit."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    sets = list(itertools.combinations(spans, max(1, blocks - threshold)))
    leaves, radius = n // LEAF_ROWS + 1, threshold // blocks

    def values_of(bits: np.ndarray, spans: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, int]:
        """The blocks side by side, 16 bits at most: the bound holds for any part of them."""
        out, width = np.zeros(len(bits), np.int64), 0
        for shift, size in spans:
            size = min(size, 16 - width)
            out |= ((bits >> np.uint64(shift)) & np.uint64((1 << size) - 1)).astype(np.int64) << width
            width += size
        return out, width

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.asarray(batch.column("bits")).view(np.uint64)
            for tree, blocks_of in enumerate(sets):
                values, width = values_of(bits, blocks_of)
                home, ends, others = block_tree(width, leaves, radius)
                more = ends[values] - np.where(values > 0, ends[values - 1], 0)
                at = np.repeat(ends[values] - np.cumsum(more), more) + np.arange(more.sum())
                leaf = np.concatenate([home[values], others[at]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(leaf), tree, np.int32)), pa.array(leaf), pa.array(np.arange(len(leaf)) < len(bits)), pa.array(np.concatenate([bits, np.repeat(bits, more)]).view(np.int64))],
                    ["tree", "leaf", "home", "bits"],
                )

    return distinct.select("bits").mapInArrow(tidied(dealt), "tree int, leaf int, home boolean, bits long")


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the sets of a[k] and b[k] have become one each."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        least = np.minimum(la, lb)
        np.minimum.at(labels, la, least)
        np.minimum.at(labels, lb, least)
        while (labels != labels[labels]).any():
            labels = labels[labels]


def linked(bits: np.ndarray, threshold: int, points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """A label for each fingerprint, equal where links between points and queries connect them; found by a vantage-point tree."""
    labels = np.arange(len(bits))
    stack = [(points, queries)]
    while stack:
        points, queries = stack.pop()
        if not len(points) or not len(queries):
            continue
        if len(points) > SCAN_ROWS:
            vantage = bits[points[len(points) // 2]]
            far = np.bitwise_count(bits[points] ^ vantage).astype(np.int16)
            median = np.sort(far)[(len(far) - 1) // 2]
            if far.max() == median:
                median -= 1
            near = np.bitwise_count(bits[queries] ^ vantage).astype(np.int16)
            if far.min() <= median:
                stack.append((points[far > median], queries[near + threshold > median]))
                stack.append((points[far <= median], queries[near - threshold <= median]))
                continue
        for k in range(0, len(queries), 2048):
            some = queries[k : k + 2048]
            row, column = np.nonzero(np.bitwise_count(bits[some][:, None] ^ bits[points][None, :]) <= threshold)
            labels = _joined(labels, some[row], points[column])
    return labels


def links(distinct: DataFrame, threshold: int = 4, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within the threshold."""
    distinct = stage(distinct.select("bits").distinct(), "fingerprints")
    routed = route(distinct, distinct.count(), threshold, blocks or threshold + 1)
    sizes = routed.groupBy("tree", "leaf").agg((F.floor(F.count("*") / CHUNK_ROWS) + 1).cast("int").alias("chunks")).where("chunks > 1")
    dealt = routed.join(sizes, ["tree", "leaf"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("bits"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("tree", "leaf", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "home", "bits")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bits")  # so that the same few stand for a group in every leaf
        bits, chunk, home = rows["bits"].to_numpy().view(np.uint64), rows["chunk"].to_numpy(), rows["home"].to_numpy()
        labels = np.arange(len(bits))
        for a, b in {(rows["one"].iloc[0], rows["two"].iloc[0]), (rows["two"].iloc[0], rows["one"].iloc[0])}:
            found = linked(bits, threshold, np.nonzero((chunk == a) & home)[0], np.nonzero(chunk == b)[0])
            labels = _joined(labels, np.arange(len(bits)), found)
        linked_rows = np.nonzero(labels != np.arange(len(bits)))[0]
        return pd.DataFrame({"a": bits[linked_rows].view(np.int64), "b": bits[labels[linked_rows]].view(np.int64)})

    return dealt.groupBy("tree", "leaf", "one", "two").applyInPandas(tidied_group(search), "a long, b long").where("a != b").distinct()


def near_duplicates(docs: DataFrame, threshold: int = 4, words_each: int = 4, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach) of every document."""
    hashed = stage(fingerprints(docs, words_each), "simhash")
    least = hashed.groupBy("bits").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(hashed, threshold, blocks)).select(F.col("node").alias("bits"), "root")
    by_bits = least.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    of_root = by_bits.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = by_bits.select("bits", "root").join(of_root, "root").select("bits", "component_id")
    return hashed.join(classes, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


#: Texts that share a shingle and stand in one task, and as many that ask for others.
CHUNK_TEXTS = 512
#: Chunks of PAIRED_SETS texts of a key whose sketches are compared two by two; the texts of a key of more chunks all count as likely.
MOST_CHUNKS = 16
#: Rows up to which a table of ids is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def shingles(text: str, words_each: int = 5) -> np.ndarray:
    """Hashes of the distinct word shingles of a text; a shorter text is one shingle, an empty one none."""
    return shingle_sets([text], words_each)[0].view(np.int64)


#: Words of 64 bits of a wide fingerprint; differing bits up to which two are linked, in all and in the first word (0.8 of
#: the shingles in common make 39 and 10 on average, with deviations of 6 and 3; unrelated texts 128 and 32, with 8 and 4).
WIDE_WORDS, WIDE_BITS, FIRST_BITS = 4, 58, 20
#: Pairs of bytes; two wide fingerprints are worth a comparison where they agree in one of the pairs.
BYTE_PAIRS = [(k, (k + step) % (8 * WIDE_WORDS)) for step in (1, 5, 11) for k in range(8 * WIDE_WORDS)]


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of (sorted) shingle hashes as WIDE_WORDS numbers. Where as many hashes are for a bit as against it, the least hash decides."""
    if not len(hashes):
        return np.zeros(WIDE_WORDS, np.uint64)
    x = (hashes.view(np.uint64)[:, None] + np.arange(1, WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    bits = np.unpackbits((x ^ (x >> np.uint64(32))).view(np.uint8), axis=1, bitorder="little")
    ones = sum(bits[k : k + 255].sum(0, dtype=np.uint8).astype(np.int64) for k in range(0, len(bits), 255))  # sums of bytes are fast
    ahead = 2 * ones - len(bits)
    return np.packbits(np.where(ahead == 0, bits[0], ahead > 0), bitorder="little").view("<u8")


#: Texts (about as many, by hash) that show which shingles are common; times there from which one is; common ones that are told apart.
SAMPLE_TEXTS, OFTEN, COMMON = 16_384, 3, 100_000
#: Words that a worker keeps the hashes of.
KEPT_WORDS = 1 << 17
#: The key of texts without words, which are alike.
NO_WORDS = 0
#: Texts that a task knows to have given keys.
KEPT_TEXTS = 1 << 18


def _sets(texts: pa.Array, words_each: int, known: Words) -> list[np.ndarray]:
    """The shingles of each text."""
    if len(known) > KEPT_WORDS:
        known.clear()
    return [s.view(np.int64) for s in shingle_sets(texts.to_pylist(), words_each, known)]


def common_shingles(rows: DataFrame, words_each: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, times in the sample) of common shingles. Any others would do: they only decide which keys a text gets, never which pairs meet."""
    share = rows.count() // SAMPLE_TEXTS + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            found = np.concatenate([*_sets(batch.column("text"), words_each, known), np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["shingle"])

    some = rows.where(F.pmod(F.xxhash64("doc_id", "second"), F.lit(share)) == 0).select("text")
    often = some.mapInArrow(tidied(cut), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = sorted((r.shingle, r.n) for r in often.orderBy(F.desc("n"), "shingle").limit(COMMON).collect())
    return np.array([s for s, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def _ordered(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A text's shingles in one order for all texts: the rarer ones first, as far as known, then by hash."""
    hashes, times = common
    often = np.zeros(len(found), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        often = np.where(hashes[at] == found, times[at], 0)
    return found[np.lexsort((found, often))]


def prefix(found: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of a text's n shingles: the rarer ones first, as far as known, then by hash; NO_WORDS of none.

    Two texts have ceil(similarity * n) shingles in common or more, so the first of these, in one order for all texts, is among
    the first of both.
    """
    if not len(found):
        return np.array([NO_WORDS], np.int64)
    return _ordered(found, common)[: len(found) - math.ceil(len(found) * similarity - 1e-9) + 1]


def neighbours(found: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A key for each of a text's first shingles and the one before it (in the order of `prefix`); NO_WORDS of none.

    Of two texts of the similarity, A shingles are in the first alone, B in the second alone, and o in both, with A + B < o for
    similarities over a half. What both have begins at most A + B + 1 gaps (the first one before all shingles), and a shingle of
    one text alone lies in one gap, so one of the first A + B + 1 is empty: its ends are neighbours in both. Its upper end is among
    the first 2A + B + 1 shingles of the first text, which is no more than 2 (1 - similarity) n + 1.

    Texts that merely share some shingles rarely have two of them side by side among all their own.
    """
    if similarity <= 0.5 or not len(found):
        return prefix(found, similarity, common)
    order = _ordered(found, common)[: int(2 * (1 - similarity) * len(found) + 1e-9) + 1].view(np.uint64)
    before = np.concatenate([np.zeros(1, np.uint64), order[:-1]])
    return _mixed(_mixed(before + _MIX) ^ order).view(np.int64)


def _classes(docs: DataFrame, similarity: float, words_each: int) -> tuple[DataFrame, list[int]]:
    """(doc_id, text_id, class) of every document, and the hashes that several texts share (see _text_id)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("second"))
    common = common_shingles(rows, words_each)
    shared = [r[0] for r in rows.groupBy("hash").agg(F.min("second").alias("a"), F.max("second").alias("b")).where("a != b").select("hash").collect()]
    rows = rows.select("doc_id", _text_id(shared).alias("text_id"), "text")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Words(), set()
        for batch in batches:
            if len(seen) > KEPT_TEXTS:
                seen.clear()
            ids = batch.column("text_id").to_pylist()
            new = [k for k, i in enumerate(ids) if not (i in seen or seen.add(i))]  # copies of a text have its keys
            some = batch.take(pa.array(new, pa.int32()))
            keys = [neighbours(s, similarity, common) for s in _sets(some.column("text"), words_each, known)]
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), some.column("text_id").take(pa.array(at))], ["key", "sid"])

    each = rows.select("text_id", "text").mapInArrow(tidied(keyed), "key long, sid long").repartition("key")
    of_key = Window.partitionBy("key")
    several = each.withColumns({"least": F.min("sid").over(of_key), "most": F.max("sid").over(of_key)}).where("least < most").select("key", "sid", "least").distinct()
    mark = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "sid")).over(of_key)
    buckets = stage(several.withColumns({"texts": F.count("*").over(of_key), "x": mark(0), "y": mark(1)}), "buckets")  # those of several texts
    met = stage(buckets.select("sid").distinct(), "met")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            sets = _sets(batch.column("text"), words_each, known)
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), *columns], ["sid", "n", "sketch"])

    sketches = _of_texts(rows, met).mapInArrow(tidied(sketched), "sid long, n long, sketch binary")
    sketches = stage(sketches.groupBy("sid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    chunks = F.floor((F.col("texts") - 1) / PAIRED_SETS) + 1
    paired = buckets.where(chunks <= MOST_CHUNKS).select("x", "y", "sid", chunks.cast("int").alias("chunks")).distinct()  # buckets of the same texts once
    chunk, two = F.pmod(F.xxhash64("sid"), "chunks").cast("int"), F.col("chunks") > 1
    paired = paired.select("x", "y", "sid", two.alias("two"), chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    part = lambda a, b: F.when(F.col("two"), F.xxhash64(a, b, F.least("chunk", "other"), F.greatest("chunk", "other"))).otherwise(F.col(a)).alias(a)
    near = likely(paired.select(part("x", "y"), part("y", "x"), "sid").distinct().join(sketches, "sid"), 100 * similarity)
    whole = buckets.where(chunks > MOST_CHUNKS).select("x", "y", "sid")
    near = near.union(whole).select(F.xxhash64("x", "y").alias("key"), "sid").distinct()
    buckets = stage(near.withColumns({"least": F.min("sid").over(of_key), "most": F.max("sid").over(of_key)}).where("least < most").drop("most"), "likely-buckets")
    members = stage(buckets.select("sid").distinct(), "candidates")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), _lists(_sets(batch.column("text"), words_each, words))], ["sid", "shingles"])

    sets = _of_texts(rows, members).mapInArrow(tidied(cut), "sid long, shingles array<long>").dropDuplicates(["sid"])
    sets = stage(sets.select("sid", F.col("sid").alias("set_id"), "shingles"), "shingle-sets")
    edges = links_in_buckets(buckets, sets, round(100 * similarity, 6), CHUNK_TEXTS)
    classes = connected_components(edges).select(F.col("node").alias("text_id"), "root")
    return rows.select("doc_id", "text_id").join(classes, "text_id", "left").select("doc_id", "text_id", F.coalesce("root", "text_id").alias("class")), shared


def _of_texts(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(text_id, text) of the rows whose text_id is among the staged ids."""
    ids = ids.toDF("text_id")
    return rows.select("text_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "text_id", "left_semi")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """A column of lists of numbers."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _text_id(shared: list[int]) -> Column:
    """A text's hash, or where several texts share that (n * n / 2^65 of n texts) its second one."""
    return F.when(F.col("hash").isin(shared), F.col("second")).otherwise(F.col("hash")) if shared else F.col("hash")


def similar_texts(docs: DataFrame, similarity: float = 0.8, words_each: int = 5) -> DataFrame:
    """doc_id, text_id and class of every document; a class joins texts whose shingle sets have at least the similarity, through any chain of links. Texts without words are alike."""
    return _classes(docs, similarity, words_each)[0]


def drop_similar(docs: DataFrame, similarity: float = 0.8, words_each: int = 5) -> DataFrame:
    """The rows of docs but for those that a document of less doc_id (nulls last) stands for. Of rows equal in doc_id (null or not) and text one stays, the same one in every run."""
    classes, shared = _classes(docs, similarity, words_each)
    classes = stage(classes, "text-classes")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_id")
    first = stage(classes.groupBy("class").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1"), "text-firsts")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_id") == F.col("first.text_id"))
    gone = stage(classes.join(first, "class").where(~stays).select("doc_id", "text_id").distinct(), "gone-documents")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    text = F.coalesce(whole.field("text").cast("string"), F.lit(""))
    rows = whole.packed(docs).select(whole.ROW, F.xxhash64(text).alias("hash"), F.xxhash64(F.lit(1), text).alias("second"))
    rows = rows.select(whole.ROW, _text_id(shared).alias("own"))
    same = (F.col("own") == F.col("text_id")) & whole.field("doc_id").cast("long").eqNullSafe(F.col("doc_id"))
    rows = rows.join(gone, same, "left_anti")
    again = stage(classes.groupBy("doc_id", "text_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_id"), "repeated-rows")
    if n := again.count():
        again = F.broadcast(again) if n <= BROADCAST_ROWS else again
        once = rows.join(again, same, "left_semi").groupBy(whole.field("doc_id").alias("doc_id"), "own").agg(F.min_by(whole.ROW, F.xxhash64(F.to_json(whole.ROW))).alias(whole.ROW))
        rows = rows.join(again, same, "left_anti").select(whole.ROW).union(once.select(whole.ROW))
    return whole.unpacked(rows, docs.schema)
