"""Benchmark decontamination by latent semantic retrieval and sequence checks.

Documents are cut into blocks of 32 words; two neighbouring blocks are a passage. TF-IDF weights of the benchmark's words
come from counts over the blocks of all documents. A randomised SVD of the TF-IDF matrix gives a latent basis: one pass over
all documents multiplies their blocks with a random matrix and back (tasks add up a row for each word, Spark adds up the
tasks'), the benchmark's own items are stacked on them with equal weight, and a Nystrom decomposition of the sketch, which is
wider than the rank, yields singular values and vectors; small ones are cut off. Every passage of every document is
compared with all items of a block of the benchmark in that space, by cosine and by how much of the item's vector its
projection covers (a short item leaves most of a passage to other words); what comes near is checked on the words: the
longest common subsequence, the item's rare words, and its answer (the last sentence).

Words are stretches between white space, in lower case, without punctuation at their ends. Items of more than 48 words are
looked for in parts of at most 48. Items under 5 words leave no room for a paraphrase: they are found where their words
follow each other in a text.

Defined cases: null and empty texts hold nothing; null doc_ids are reported as null; repeated rows, and rows of one doc_id,
are reported once by item and all dropped; null, empty and wordless items are ignored; repeated items are items like any
other; texts of any length are searched whole; with an empty benchmark or table nothing is found; other columns, whatever
their names, are carried by clean_documents and ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histoloom.llm.workers import tidied

BLOCK_WORDS = 32
PART_WORDS = 48
LEAST_WORDS = 5
#: Parts of items that one pass over the documents looks for; a larger benchmark takes several passes.
ITEMS_A_PASS = 4096
#: Columns of the sketch beyond the rank, and the share of the largest singular value under which directions are cut off.
OVERSAMPLING, LEAST_VALUE = 16, 1e-3
TEXT_BYTES = 1 << 20
#: Passages times items that are compared at once.
COMPARED_AT_ONCE = 1 << 21
_ENDS = ".,;:!?\"'()[]{}|<>«»*-_"


def words_of(text: str) -> list[str]:
    """The words of an item, as those of documents are read."""
    return [w for w in (x.strip(_ENDS) for x in pc.utf8_split_whitespace(pc.utf8_lower(pa.scalar(text))).as_py()) if w]


@dataclass
class Item:
    """A part of a benchmark item (or a short one) as columns of the vocabulary; `answer` is empty but for the last part."""

    item_id: int
    words: list[int]
    answer: list[int]


@dataclass
class Probe:
    """What a pass looks for: vocabulary, latent basis of its words and latent vectors of the items."""

    vocabulary: pa.Array
    idf: np.ndarray
    basis: np.ndarray
    items: list[Item]
    latent: np.ndarray
    rare: list[frozenset[int]]
    short: dict[int, list[Item]]


def parts_of(item_id: int, text: str | None) -> Iterator[Part]:
    """(item_id, words, words of the answer) of each part of an item; the answer goes with the last part, a short item is one part without."""
    words = words_of(text or "")
    if len(words) < LEAST_WORDS:
        if words:
            yield item_id, words, []
        return
    sentences = [s for s in (words_of(x) for x in re.split(r"(?<=[.!?])\s", text)) if s]
    answer = sentences[-1] if len(sentences[-1]) >= 3 else words[-3:]
    parts = -(-len(words) // PART_WORDS)
    for k in range(parts):
        part = words[len(words) * k // parts : len(words) * (k + 1) // parts]
        yield item_id, part, answer[-len(part) :] if k == parts - 1 else []


Part = tuple[int, list[str], list[str]]


def read_items(rows: list) -> tuple[list[str], list[Item]]:
    """Vocabulary, and parts and short items of benchmark rows (item_id, text)."""
    return _coded([part for row in rows for part in parts_of(*row)])


def _coded(parts: list[Part]) -> tuple[list[str], list[Item]]:
    vocabulary: dict[str, int] = {}
    code = lambda words: [vocabulary.setdefault(w, len(vocabulary)) for w in words]
    items = [Item(item_id, code(words), code(answer)) for item_id, words, answer in parts]
    return list(vocabulary), items


def blocks(texts: pa.Array, vocabulary: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For bounded runs of texts: (first text, end text, the first block of each text and the end, block of each word, column of each word or -1)."""
    sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + TEXT_BYTES, side="right")))
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts.slice(start, end - start)))
        words = pc.utf8_trim(split.flatten(), characters=_ENDS)
        column = pc.fill_null(pc.index_in(words, vocabulary), -1).to_numpy()
        counts = np.asarray(pc.list_value_length(split)).astype(np.int64)
        real = np.asarray(pc.binary_length(words)) > 0  # stretches of punctuation are no words
        owner = np.repeat(np.arange(end - start), counts)[real]
        column, counts = column[real], np.bincount(owner, minlength=end - start)
        firsts = np.concatenate([[0], np.cumsum(-(-counts // BLOCK_WORDS))])
        position = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield start, end, firsts, firsts[owner] + position // BLOCK_WORDS, column
        start = end


def _sums(rows: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their (ascending) block."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(rows):
        first = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1])
        out[of[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def corpus_sketch(docs: DataFrame, vocabulary: list[str], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the vocabulary the blocks of all documents that hold it (all blocks at the end), and T' T start for the matrix T of word counts by block."""
    table, n = pa.array(vocabulary, pa.string()), len(vocabulary)
    width = start.shape[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(n + 1, np.int64), np.zeros((n + 1, width), np.float32)
        for batch in batches:
            for _, _, firsts, block, column in blocks(batch.column("text").fill_null(""), table):
                held[-1] += firsts[-1]
                known = np.nonzero(column >= 0)[0]
                for at in range(0, len(known), 1 << 14):  # a block that is cut here counts as two
                    c, b = column[known[at : at + (1 << 14)]], block[known[at : at + (1 << 14)]]
                    b = b - b[0]
                    held[:-1] += np.bincount(np.unique(b * n + c) % n, minlength=n)
                    sums = _sums(start[c], b, int(b[-1]) + 1)
                    order = np.argsort(c, kind="stable")
                    edge = np.concatenate([[0], np.nonzero(np.diff(c[order]))[0] + 1])
                    total[c[order][edge]] += np.add.reduceat(sums[b[order]], edge, axis=0)
        some = np.nonzero(held)[0]
        for at in range(0, len(some), 4096):
            part = some[at : at + 4096]
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[part]), pa.ListArray.from_arrays(offsets, pa.array(total[part].astype(np.float64).ravel()))], ["column", "held", "sums"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(tidied(count), "column long, held long, sums array<double>")
    added = rows.groupBy("column").agg(F.sum("held").alias("held"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    held, product = np.zeros(n + 1), np.zeros((n, width))
    for row in added.toLocalIterator():  # a row for each word of a bounded block of items
        held[row["column"]] = row["held"]
        if row["column"] < n:
            product[row["column"]] = row["sums"]
    return held, product


def latent_basis(product: np.ndarray, start: np.ndarray, idf: np.ndarray, items: list[Item], rank: int) -> np.ndarray:
    """Leading right singular vectors, as columns, of the TF-IDF matrix of all blocks with the items stacked on it.

    With weights W the sketch of its Gram matrix W T' T W at W^-1 start is W (T' T start), so weights need not be known before the pass.
    """
    seen, test = idf[:, None] * product, start / idf[:, None]
    wanted = np.zeros_like(test)
    for item in items:
        words, counts = np.unique(item.words, return_counts=True)
        weights = counts * idf[words]
        wanted[words] += np.outer(weights, weights @ test[words])
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    return _nystrom(unit(seen) + unit(wanted), test, rank)


def _nystrom(sketch: np.ndarray, test: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive semi-definite matrix G from sketch = G test."""
    shift = 1e-7 * np.linalg.norm(sketch) / max(np.linalg.norm(test), 1e-12)
    core = test.T @ (sketch + shift * test)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    kept = values > max(1e-10 * values.max(initial=0.0), 0.0)
    if not kept.any():  # no block holds any of the words
        return np.zeros((len(test), 0), np.float32)
    half = (sketch + shift * test) @ (vectors[:, kept] / np.sqrt(values[kept]))
    left, singular, _ = np.linalg.svd(half, full_matrices=False)
    singular = np.sqrt(np.maximum(0, singular**2 - shift))  # G's eigenvalues are the TF-IDF matrix's singular values squared
    kept = singular[:rank] > LEAST_VALUE * singular[0]
    return left[:, :rank][:, kept].astype(np.float32)


def make_probe(docs: DataFrame, rows: list, rank: int, seed: int) -> Probe | None:
    """What a pass looks for, for benchmark rows (item_id, text)."""
    return _probe(docs, [part for row in rows for part in parts_of(*row)], rank, seed)


def _probe(docs: DataFrame, parts: list[Part], rank: int, seed: int) -> Probe | None:
    """Vocabulary, weights and latent vectors for a block of the benchmark, by one pass over docs; without a pass if all items are short."""
    vocabulary, items = _coded(parts)
    if not items:
        return None
    if all(len(item.words) < LEAST_WORDS for item in items):
        n = len(vocabulary)
        return Probe(pa.array(vocabulary, pa.string()), np.zeros(n, np.float32), np.zeros((n, 0), np.float32), [], np.zeros((0, 0), np.float32), [], _by_first_word(items))
    start = np.random.default_rng(seed).normal(size=(len(vocabulary), min(rank + OVERSAMPLING, len(vocabulary)))).astype(np.float32)
    held, product = corpus_sketch(docs, vocabulary, start)
    idf = np.log((held[-1] + 1) / (held[:-1] + 1)).astype(np.float32) + np.float32(0.1)
    short = _by_first_word([item for item in items if len(item.words) < LEAST_WORDS])
    items = [item for item in items if len(item.words) >= LEAST_WORDS]
    basis = idf[:, None] * latent_basis(product, start.astype(np.float64), idf.astype(np.float64), items, rank)
    latent = np.stack([basis[item.words].sum(0) for item in items]) if items else np.zeros((0, basis.shape[1]), np.float32)
    return Probe(pa.array(vocabulary, pa.string()), idf, basis, items, latent, [rare_words(item, idf) for item in items], short)


def _by_first_word(items: list[Item]) -> dict[int, list[Item]]:
    found: dict[int, list[Item]] = {}
    for item in items:
        found.setdefault(item.words[0], []).append(item)
    return found


def common(words: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over `words`."""
    masks: dict[int, int] = {}
    for k, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(words)) - 1
    rows = full
    for w in text:
        if (mask := masks.get(w)) is not None:
            hit = rows & mask
            rows = ((rows + hit) | (rows - hit)) & full
    return len(words) - rows.bit_count()


def rare_words(item: Item, idf: np.ndarray) -> frozenset[int]:
    """The rarer half of an item's words."""
    own = sorted(set(item.words), key=lambda w: (-idf[w], w))
    return frozenset(own[: -(-len(own) // 2)])


def check(item: Item, rare: frozenset[int], region: list[int], ratio: float) -> float:
    """Share of the item's words that the region holds in order, or 0 if the region is no copy or paraphrase of it."""
    if len(rare.intersection(region)) < ratio * len(rare):
        return 0.0
    share = common(item.words, region) / len(item.words)
    if share < ratio or item.answer and common(item.answer, region) < len(item.answer) / 2:
        return 0.0
    return share


def found_in(texts: pa.Array, probe: Probe, cosine: float, cover: float, ratio: float) -> Iterator[tuple[int, int, float, float, int]]:
    """(text, item_id, share of words in order, cosine, first word of the region) for every text and item that it holds."""
    for first, end, firsts, block, column in blocks(texts, probe.vocabulary):
        n = int(firsts[-1])
        known = np.nonzero(column >= 0)[0]
        latent = np.zeros((n, probe.basis.shape[1]), np.float32)
        for at in range(0, len(known), 1 << 15):
            c, b = column[known[at : at + (1 << 15)]], block[known[at : at + (1 << 15)]]
            latent[b[0] : b[-1] + 1] += _sums(probe.basis[c], b - b[0], int(b[-1] - b[0]) + 1)
        owner = np.repeat(np.arange(end - first), np.diff(firsts))
        passage = latent
        if n > 1:
            passage = latent.copy()
            together = owner[:-1] == owner[1:]
            passage[:-1][together] += latent[1:][together]
        norms, own = np.maximum(np.linalg.norm(passage, axis=1), 1e-12), np.maximum(np.linalg.norm(probe.latent, axis=1), 1e-12)
        edges = np.searchsorted(block, np.arange(n + 1))
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        for text, item, at in _verbatim(probe, column, owner[block], block - firsts[owner[block]]):
            best[text, item.item_id] = (1.0, 1.0, at)
        directions, step = (probe.latent / own[:, None]).T, max(64, COMPARED_AT_ONCE // max(1, len(probe.items)))
        for at in range(0, n if probe.items else 0, step):
            near = passage[at : at + step] @ directions
            covered = near >= cover * own
            near /= norms[at : at + step, None]
            region, last = [], -1
            for row, k in zip(*(x.tolist() for x in np.nonzero(covered & (near >= cosine)))):
                item, b = probe.items[k], at + row
                text = int(owner[b])
                low, high = max(int(firsts[text]), b - 1), min(int(firsts[text + 1]), b + 3)
                if row != last:
                    region, last = column[edges[low] : edges[high]].tolist(), row
                share = check(item, probe.rare[k], region, ratio)
                if share and (text, item.item_id) not in best or share > best.get((text, item.item_id), (0.0,))[0]:
                    best[text, item.item_id] = (share, float(near[row, k]), (low - int(firsts[text])) * BLOCK_WORDS)
        for (text, item_id), values in best.items():
            yield first + text, item_id, *values


def _verbatim(probe: Probe, column: np.ndarray, owner: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, Item, int]]:
    """(text, item, first word of its block) for every short item whose words follow each other in a text."""
    if not probe.short:
        return
    for at in np.nonzero(np.isin(column, list(probe.short)))[0].tolist():
        for item in probe.short[int(column[at])]:
            end = at + len(item.words)
            if end <= len(column) and owner[end - 1] == owner[at] and column[at:end].tolist() == item.words:
                yield int(owner[at]), item, int(block[at]) * BLOCK_WORDS


def probes(docs: DataFrame, benchmark: DataFrame, rank: int = 128, seed: int = 11) -> Iterator[Probe]:
    """The benchmark in blocks of ITEMS_A_PASS parts, by item_id; a long item's parts may stand in several."""
    ordered = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").orderBy("item_id", "text").toLocalIterator()
    parts: list[Part] = []
    for row in ordered:
        for part in parts_of(*row):
            parts.append(part)
            if len(parts) == ITEMS_A_PASS:
                yield from filter(None, [_probe(docs, parts, rank, seed)])
                parts = []
    yield from filter(None, [_probe(docs, parts, rank, seed)])


def contaminations(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, cover: float = 0.5, ratio: float = 0.6) -> DataFrame:
    """doc_id, item_id, share (of the item's words, in order), cosine and first_word of the region, for every document that holds an item."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, share double, cosine double, first_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for probe in probes(docs, benchmark):

        def find(batches: Iterator[pa.RecordBatch], probe: Probe = probe) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(zip(*found_in(batch.column("text").fill_null(""), probe, cosine, cover, ratio)))
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(found[0], pa.int64())), *(pa.array(x, t) for x, t in zip(found[1:], (pa.int64(), pa.float64(), pa.float64(), pa.int64())))], ["doc_id", "item_id", "share", "cosine", "first_word"])

        out = out.union(rows.mapInArrow(tidied(find), schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("cosine").alias("cosine"), F.min("first_word").alias("first_word"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.3, cover: float = 0.5, ratio: float = 0.6) -> DataFrame:
    """The rows of docs that hold no benchmark item, unchanged."""
    for probe in probes(docs, benchmark):

        def keep(batches: Iterator[pa.RecordBatch], probe: Probe = probe) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                kept[[x[0] for x in found_in(batch.column("text").cast(pa.string()).fill_null(""), probe, cosine, cover, ratio)]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(tidied(keep), docs.schema)
    return docs
