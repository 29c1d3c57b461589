"""Near duplicates by SuperMinHash: signatures of correlated ranks with early stopping, banding, exact checks, union-find.

Every shingle of a text draws a random permutation of the registers, seeded by its hash, and in step j offers j plus a
random fraction to the j-th register of its permutation. Registers keep the least offer, so two texts agree in a register
with the probability of their Jaccard similarity, at a lower variance than with independent hashes, because one shingle's
ranks are all different. Offers of step j are j at least: a text is done as soon as all its registers lie under the
next step, after two or three steps for a text of some hundred shingles.

Registers are hashed in BANDS bands of ROWS; texts that agree in a band are candidates. At a similarity of 0.8 a pair has
no band in common with probability (1 - 0.8^5)^40 = 1.3e-7. Candidates are confirmed on their full sets, in two rounds that
never spell out the pairs of a bucket:

1. each set with the least one of each of its buckets; the links found join sets to components;
2. buckets in which several components are left (equal ones once) go to tasks with the sets themselves, large ones in
   chunks; every set outside the bucket's largest component is compared with all others in each chunk, and union-find
   joins what is similar, so that no link between two components of a bucket is left out.

Defined cases: texts of fewer than `words_each` words are one shingle; null and empty texts and those without words have
none, are linked with nothing and stay; texts of equal sets are one class, whatever their number; null doc_ids take part,
and a component of nothing else has a null component_id; repeated rows are one text; texts of any length are read
whole; an empty table gives no rows; other columns, whatever their names, are ignored. Kept are the rows of the
component's least doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoloom.llm.components import connected_components
from histoloom.llm.workers import tidied, tidied_group
from histoloom.session import stage

#: Bands, and registers in each of them. Registers are numbered in bytes.
BANDS, ROWS = 40, 5
#: Shingles whose permutations are held together.
SHINGLES_AT_ONCE = 1 << 14
#: Words that a worker keeps the hashes of.
KEPT_WORDS = 1 << 19
#: Sets of one bucket that stand in a task, and as many that ask for others.
CHUNK_SETS = 512
#: Rows up to which a table of ids is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Counts of a sketch, at least and at most, and sets of a bucket whose sketches stand in one task.
BINS, MOST_BINS, PAIRED_SETS = 128, 8192, 4096
#: Pairs whose sketches a task compares at once.
PAIRS_AT_ONCE = 1 << 14
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, 11)
        return found


def shingle_sets(texts: list[str | None], words_each: int, known: Words | None = None) -> list[np.ndarray]:
    """Sorted hashes of the distinct word shingles of each text."""
    known = Words() if known is None else known
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()  # both touch ASCII only
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(words_each, len(words))
        joined = np.zeros(max(0, len(words) - k + 1) if k else 0, np.uint64)
        for j in range(k):
            joined = _mixed((joined + _MIX) ^ hashes[j : j + len(joined)])
        out.append(np.unique(joined))
        if len(known) > KEPT_WORDS:
            known.clear()
    return out


def signatures(sets: list[np.ndarray], registers: int = BANDS * ROWS) -> np.ndarray:
    """The SuperMinHash signature of each set (none of them empty): step in the high byte, random fraction in the others."""
    most = np.uint32(0xFFFFFFFF)
    out = np.full((len(sets), registers), most, np.uint32)
    if not sets:
        return out
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    registers_of = out.reshape(-1)
    for begin in range(0, len(flat), SHINGLES_AT_ONCE):
        seeds, own = flat[begin : begin + SHINGLES_AT_ONCE], owner[begin : begin + SHINGLES_AT_ONCE]
        places = np.tile(np.arange(registers, dtype=np.uint8), (len(seeds), 1))
        for step in range(registers):
            if step:
                worst = out[own[0] : own[-1] + 1].max(1)
                active = worst[own - own[0]] >= step << 24
                if not active.any():
                    break
                if active.sum() < 0.7 * len(own):
                    seeds, own, places = seeds[active], own[active], places[active]
            drawn = _mixed(seeds + np.uint64((step + 1) * int(_MIX) % (1 << 64)))
            swap = step + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(registers - step) >> np.uint64(32)).astype(np.int64)
            row = np.arange(len(own))
            register = places[row, swap]
            places[row, swap] = places[:, step]
            offer = (drawn >> np.uint64(40)).astype(np.uint32) | np.uint32(step << 24)
            at = own * registers + register
            better = offer < registers_of[at]
            np.minimum.at(registers_of, at[better], offer[better])
    return out


def band_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = found.reshape(len(found), bands, rows).astype(np.uint64)
    keys = np.tile(np.arange(bands, dtype=np.uint64) * _MIX, (len(found), 1))
    for k in range(rows):
        keys = _mixed(keys + _MIX ^ parts[:, :, k])
    return keys.view(np.int64)


def _sketched(docs: DataFrame, words_each: int) -> DataFrame:
    """(doc_id, d1, d2, n, set_id, bands): digests of the text, shingles, 128-bit digest of the set (null if empty) and its band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), words_each, known)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = dict(zip(full, band_keys(signatures([sets[k] for k in full]))))
            ids = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            columns = [*(batch.column(c) for c in ("doc_id", "d1", "d2")), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array([keys.get(k) for k in range(len(sets))], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "d1", "d2", "n", "set_id", "bands"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"))
    return rows.mapInArrow(tidied(sketch), "doc_id long, d1 long, d2 long, n long, set_id binary, bands array<long>")


def compared(one: np.ndarray, two: np.ndarray, percent: float) -> bool:
    """Whether two sorted sets have at least `percent` of a hundred of their union in common."""
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def joined(sets: list[np.ndarray], labels: np.ndarray, percent: float, asking: np.ndarray) -> np.ndarray:
    """Labels of the sets after every asking set has got one label with all that are similar to it.

    A set is compared with all of other labels at once, through the places of its shingles.
    """
    labels = labels.copy()
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    for k in np.nonzero(asking)[0].tolist():
        others = labels != labels[k]
        if not others.any():
            continue
        low, high = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
        more = high - low
        shared = np.bincount(owner[np.repeat(high - np.cumsum(more), more) + np.arange(more.sum())], minlength=len(sets))
        for label in np.unique(labels[others & (100 * shared >= percent * (sizes + sizes[k] - shared))]):
            labels[labels == label] = labels[k]
    return labels


def sketch(found: np.ndarray) -> bytes:
    """How many shingles fall into each part of all hashes, in bytes: BINS parts, or a power of two of about half the shingles."""
    bits = int(np.clip(len(found).bit_length() - 1, BINS.bit_length() - 1, MOST_BINS.bit_length() - 1))
    return np.minimum(np.bincount((found.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_apart(one: bytes, two: bytes) -> int:
    """Shingles that two sets of these sketches differ by at least."""
    counts = [np.frombuffer(x, np.uint8).astype(np.int32) for x in (one, two)]
    bins = min(map(len, counts))
    a, b = (np.minimum(x.reshape(bins, -1).sum(1), 255) for x in counts)
    return int(np.abs(a - b).sum())


def likely_rows(group: np.ndarray, sizes: np.ndarray, sketches: list[bytes], percent: float) -> np.ndarray:
    """Which sets (rows with the number of their group, group after group) may have the similarity with another one of their group, by sizes and sketches."""
    near = np.zeros(len(group), bool)
    order = np.lexsort((sizes, group))
    by, size = group[order].astype(np.int64), sizes[order].astype(np.int64)
    span = int(size.max(initial=0)) + 1
    most = np.minimum((100 * size + 1e-6) // percent, span - 1).astype(np.int64)
    more = np.searchsorted(by * span + size, by * span + most, "right") - np.arange(len(order)) - 1  # partners that are as large or larger
    round_of = (np.cumsum(more) - more) // PAIRS_AT_ONCE
    coarse = np.stack([np.minimum(np.frombuffer(s, np.uint8).reshape(BINS, -1).sum(1, dtype=np.int64), 255) for s in sketches]).astype(np.int16)
    for k in np.unique(round_of[more > 0]):
        low, high = np.searchsorted(round_of, k, "left"), np.searchsorted(round_of, k, "right")
        n = more[low:high]
        first = np.repeat(np.arange(low, high), n)
        a, b = order[first], order[first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)]
        unknown = ~(near[a] & near[b])
        a, b = a[unknown], b[unknown]
        left = (100 + percent) * np.abs(coarse[a] - coarse[b]).sum(1, dtype=np.int64) <= (100 - percent) * (sizes[a] + sizes[b]) + 1e-6
        for i, j in zip(a[left].tolist(), b[left].tolist()):
            if not (near[i] and near[j]) and (100 + percent) * least_apart(sketches[i], sketches[j]) <= (100 - percent) * (sizes[i] + sizes[j]) + 1e-6:
                near[i] = near[j] = True
    return near


def likely(groups: DataFrame, percent: float) -> DataFrame:
    """(x, y, sid) of the sets in those groups where sizes and sketches differ from another one's by no more shingles than sets of the similarity can.

    groups: (x, y, sid, n, sketch), a group's name being x and y. Pairs are formed inside tasks, from a batch at a time: none is ever a row.
    """

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(rows: pa.RecordBatch, changes: np.ndarray) -> pa.RecordBatch:
            near = likely_rows(np.cumsum(changes), rows.column("n").to_numpy(), rows.column("sketch").to_pylist(), percent)
            return rows.select(["x", "y", "sid"]).filter(pa.array(near))

        for batch in batches:
            rows = pa.concat_batches([*held, batch])
            if not rows.num_rows:
                continue
            x, y = (rows.column(c).to_numpy() for c in ("x", "y"))
            changes = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            last = int(np.nonzero(changes)[0][-1])  # where the group begins that the next batch may go on with
            if last:
                yield told(rows.slice(0, last), changes[:last])
            held = [rows.slice(last)]
        if held:
            yield told(held[0], np.arange(held[0].num_rows) == 0)

    ordered = groups.select("x", "y", "sid", "n", "sketch").repartition("x", "y").sortWithinPartitions("x", "y")
    return ordered.mapInArrow(tidied(kept), "x long, y long, sid long")


def links_in_buckets(buckets: DataFrame, full: DataFrame, percent: float, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """(a, b): links between sets of enough similarity whose components are those of all such pairs that share a bucket.

    buckets: (key, sid, least) of sets in buckets of several, `least` being the least sid of the bucket; full: (sid, set_id,
    shingles). Links are between set_ids.
    """
    kind = full.schema["set_id"].dataType.simpleString()

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos = batch.column("shingles"), batch.column("other_shingles")
            near = [compared(np.asarray(one.values), np.asarray(two.values), percent) for one, two in zip(ones, twos)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    # with two sets of one sid (64 bits of their digest) both are compared: links are between the digests themselves
    pairs = buckets.where("sid != least").select("sid", "least").distinct()
    of_least = full.select(F.col("sid").alias("least"), F.col("set_id").alias("b"), F.col("shingles").alias("other_shingles"))
    pairs = pairs.join(full, "sid").join(of_least, "least").select(F.col("set_id").alias("a"), "b", "shingles", "other_shingles")
    links = stage(pairs.mapInArrow(tidied(confirmed), f"a {kind}, b {kind}"), "links")
    first = stage(connected_components(links), "first-components")

    of_set = full.select("sid", "set_id").join(first.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    held = stage(buckets.select("key", "sid").join(of_set, "sid"), "held")
    mark = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "set_id"))
    parts = held.groupBy("key", "root").agg(F.count("*").alias("n"), mark(0).alias("x"), mark(1).alias("y"))
    whole = F.struct("n", "root")
    left = parts.groupBy("key").agg(F.max(whole).alias("main"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    left = left.where("main.n < n and n > 2")  # two sets have met
    left = left.groupBy("n", "x", "y").agg(F.min(F.struct("key", "main")).alias("first")).select("first.*", "n")  # buckets of the same sets once
    chunks = lambda n: F.floor((n - 1) / chunk_sets).cast("int") + 1
    left = left.select("key", F.col("main.root").alias("main"), chunks(F.col("n")).alias("chunks"), chunks(F.col("n") - F.col("main.n")).alias("rounds"))
    # every set stands in a chunk; sets outside the main component stand in a round, too, and ask in every chunk
    rows = held.join(left, "key").select("key", "set_id", "root", "main", "chunks", "rounds", F.pmod(F.xxhash64("set_id"), "chunks").cast("int").alias("chunk"), F.pmod(F.xxhash64(F.lit(1), "set_id"), "rounds").cast("int").alias("round"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = rows.select("key", "chunk", every("rounds").alias("round"), F.lit(False).alias("asks"), "set_id", "root")
    asking = rows.where("root != main").select("key", every("chunks").alias("chunk"), "round", F.lit(True).alias("asks"), "set_id", "root")
    dealt = stage(asked.unionByName(asking), "unsettled")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("set_id")  # so that the same few stand for a component in every bucket
        labels, _ = pd.factorize(rows["root"])
        after = joined([np.asarray(s).view(np.uint64) for s in rows["shingles"]], labels, percent, rows["asks"].to_numpy())
        ids = rows["set_id"].to_numpy()
        firsts = pd.Series(ids).groupby(after).transform("first").to_numpy()
        kept = np.nonzero(firsts != ids)[0]
        return pd.DataFrame({"a": ids[kept], "b": firsts[kept]})

    again = dealt.join(full.select("set_id", "shingles"), "set_id").groupBy("key", "chunk", "round").applyInPandas(tidied_group(search), f"a {kind}, b {kind}")
    return links.union(again)


def similar_sets(docs: DataFrame, percent: int = 80, words_each: int = 2) -> DataFrame:
    """(doc_id, d1, d2, n, set_id, root) of every document: root is one set of the component, null without words."""
    known = stage(_sketched(docs, words_each), "superminhash")
    sets = known.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct("d1", "d2")).alias("text"), F.first("bands").alias("bands"))
    sets = stage(sets.select("set_id", "text.*", F.xxhash64("set_id").alias("sid"), "bands"), "distinct-sets")
    keyed = sets.select("sid", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("sid").alias("least"), F.max("sid").alias("most")).where("least < most").select("key", "least")
    buckets = stage(keyed.join(shared, "key"), "buckets")  # those of several sets
    wanted = stage(buckets.select("sid").distinct(), "candidates")
    few = wanted.count() <= BROADCAST_ROWS

    sought = sets.select("sid", "set_id", "d1", "d2").join(F.broadcast(wanted) if few else wanted, "sid")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text")).select("text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2"))
    found = rows.join(F.broadcast(sought) if few else sought, ["d1", "d2"]).select("sid", "set_id", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            own = shingle_sets(batch.column("text").to_pylist(), words_each, words)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("set_id"), column], ["sid", "set_id", "shingles"])

    full = stage(found.mapInArrow(tidied(cut), "sid long, set_id binary, shingles array<long>").dropDuplicates(["set_id"]), "shingle-sets")

    roots = connected_components(links_in_buckets(buckets, full, percent)).select(F.col("node").alias("set_id"), "root")
    return known.join(roots, "set_id", "left").select("doc_id", "d1", "d2", "n", "set_id", F.coalesce("root", "set_id").alias("root"))


def near_duplicates(docs: DataFrame, percent: int = 80, words_each: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept (doc_id is that one) of every document."""
    found = stage(similar_sets(docs, percent, words_each), "similar-sets")
    least = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = found.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
