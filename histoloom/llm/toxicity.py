"""Toxicity scores of texts after noisy-channel deobfuscation.

Stretches that look disguised (digits or symbols inside words, letters set apart, letters drawn out) become character
lattices: each written sign may stand for itself or for letters it imitates, a run for one or two of its letters, a gap for
nothing or a word's end. Viterbi decoding under a character trigram model, counted over all documents, picks the restored
stretch. A logistic model over word beginnings of the restored text then scores it.

Defined cases: null and empty texts have no features and get the score of the intercept; null doc_ids are scored and held
in; labels with null doc_id or null toxic teach nothing, and of repeated labels the larger counts; without any labelled
rows, or with one class only, every score is the smoothed share of toxic labels; repeated rows are scored alike; texts of
any length are scored whole; an empty table gives no rows; with_scores carries all other columns and replaces one of the
score's name.
"""

from __future__ import annotations

import functools
import math
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histoloom.session import stage
from histoloom.llm.workers import tidied, tidy

#: Labelled rows that the classifier is fitted on at most, taken in hash order.
SAMPLE_ROWS = 20_000
#: Word beginnings that the classifier looks at, by their lengths, and how many it keeps.
BEGINNINGS, FEATURES = (5, 6, 7, 8), 1024
#: Distinct stretches that a worker keeps its findings of.
KNOWN_STRETCHES = 80_000
#: Times as many that it chooses from.
CANDIDATES = 8
#: Signs of a stretch beyond which its restoration is not kept for the next time, and letters mixed with digits may be a key or a hash (see Decoder.plausible).
LONGEST = 40
#: Places of a stretch after which what all its readings begin with is put aside.
SETTLED_EVERY = 64

# What each sign can stand for.
IMITATED = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}
# End of fixed values.
_SIGN = "013457890@$!|+€"
_ONE = r"(?:[^\W\d_]|[" + re.escape(_SIGN) + "])"
#: Letters set apart by spaces; a cheap look that tells whether a text has any; and what is disguised inside a stretch without spaces.
APART = re.compile(rf"(?<![^\W_])(?:{_ONE}[ .\-_*]){{2,}}{_ONE}(?![^\W_])")
_ANY_APART = re.compile(rf"(?<!\S){_ONE}(?: {_ONE}){{2}}(?!\S)")
DISGUISED = re.compile(
    rf"(?<![^\W_])(?:{_ONE}[.\-_*]){{2,}}{_ONE}(?![^\W_])"
    r"|[^\W\d_]+(?:[" + re.escape(_SIGN) + r"]+[^\W\d_]+)+|[" + re.escape("0134579@$") + r"]+[^\W\d_]+(?:[" + re.escape(_SIGN) + r"]+[^\W\d_]+)*"
    r"|[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*"
)
#: Without any of these signs nothing inside a stretch is disguised; signs at its ends alone never are, but for those that imitate a letter there.
_SUSPECT = re.compile(r"([^\W\d_])\1\1|[.\-_*" + re.escape(_SIGN) + "]")
_ENDS = ".,;:?\"'()"
_WORD = re.compile(r"[^\W\d_]+")
#: The trigrams hold all other letters as one, so a stretch without any of these gives no evidence where its gaps are.
_EVIDENCE = re.compile("[a-zA-Z" + re.escape(_SIGN) + "]")
_RUN = re.compile(r"(.)\1+", re.DOTALL)
_MIXED = re.compile(r"(?=.*\d).*[^\W\d_]", re.DOTALL)
_GAPS = " .-_*"
_N = 28
_CLASS = np.zeros(256, np.int32)
_CLASS[128:] = 27
for _k in range(26):
    _CLASS[65 + _k] = _CLASS[97 + _k] = _k + 1


def _class(character: str) -> int:
    """0 no letter, 1 to 26 a to z, 27 any other letter."""
    return int(_CLASS[ord(character)]) if ord(character) < 128 else 27


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character-class trigrams over the UTF-8 bytes of all texts; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3 + 1, np.int64)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            for at in range(0, max(0, len(data) - 2), 1 << 20):
                c = _CLASS[data[at : at + (1 << 20) + 2]]
                code = (c[:-2] * _N + c[1:-1]) * _N + c[2:]
                last = offsets[1:] - offsets[0] - at
                for back in (1, 2):  # no trigram reaches over a text's end
                    cut = last[(last >= back) & (last - back < len(code))] - back
                    code[cut] = _N**3
                total += np.bincount(code, minlength=_N**3 + 1)
        some = np.nonzero(total[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["code", "n"])

    rows = docs.select(F.col("text").cast("string")).where("text is not null").mapInArrow(tidied(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_N**3, np.int64)
    for row in rows:
        out[row["code"]] = row["n"]
    return out


class Decoder:
    """Viterbi decoding of disguised stretches under a character trigram model."""

    #: Costs (negative logarithms) of a sign standing for a letter or for itself, of two signs for one letter, of a longer
    #: run for one letter or two, and of a gap inside a word or between words.
    IMITATION, KEPT_SIGN, PAIR_AS_ONE, SINGLE, DOUBLE, NO_GAP, GAP = 0.5, 4.0, 1.0, 0.2, 1.7, 0.2, 4.0

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(_N, _N, _N).astype(float)
        pairs, singles = cube.sum(2), cube.sum((0, 1)) + 1
        uni = singles / singles.sum()
        bi = (cube.sum(0) + 20 * uni) / (cube.sum(0).sum(1, keepdims=True) + 20)
        tri = (cube + 20 * bi[None]) / (pairs[:, :, None] + 20)
        self._cost = -np.log(tri)
        # what a letter costs in the corpus, and a quarter of the way from there to what one costs that is drawn at random
        usual = float((cube * self._cost).sum() / max(cube.sum(), 1))
        self.plausible = usual + (float(self._cost[1:27, 1:27, 1:27].mean()) - usual) / 4
        self.restore = functools.lru_cache(maxsize=20_000)(self._restore)

    def lattice(self, stretch: str) -> list[list[tuple[str, float]]]:
        """Options (letters, cost) at each place of a stretch."""
        places: list[list[tuple[str, float]]] = []
        apart = any(g in _GAPS for g in stretch)
        for run in re.finditer(r"(.)\1*", stretch.lower(), re.DOTALL):
            sign, n = run[1], len(run[0])
            if sign in _GAPS:
                places.append([("", self.NO_GAP), (" ", self.GAP)] if apart else [(sign * n, 0.0)])
            elif sign in IMITATED:
                one, two = (0.0, None) if n == 1 else (self.PAIR_AS_ONE, 0.0) if n == 2 else (self.SINGLE, self.DOUBLE)
                letters = [(x, self.IMITATION + one) for x in IMITATED[sign]]
                doubled = [(x + x, self.IMITATION + two) for x in IMITATED[sign]] if two is not None else []
                places.append([*letters, *doubled, (sign * n, self.KEPT_SIGN * n)])
            elif n >= 3:
                places.append([(sign, self.SINGLE), (sign * 2, self.DOUBLE)])
            else:
                places.append([(sign * n, 0.0)])
        return places

    def _restore(self, stretch: str) -> str:
        return self._decoded(stretch)[0]

    def _decoded(self, stretch: str) -> tuple[str, float]:
        """The restored stretch and the cost of its path."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        settled: list[str] = []
        for place, options in enumerate([*self.lattice(stretch), [(" ", 0.0)]]):
            if place % SETTLED_EVERY == SETTLED_EVERY - 1:
                shared = os.path.commonprefix([text for _, text in states.values()])
                settled.append(shared)
                states = {at: (cost, text[len(shared) :]) for at, (cost, text) in states.items()}
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (cost, text) in states.items():
                for letters, extra in options:
                    x, y, total = a, b, cost + extra
                    for letter in letters:
                        z = _class(letter)
                        total += self._cost[x, y, z]
                        x, y = y, z
                    found = (total, text + letters)
                    if (x, y) not in after or found < after[x, y]:
                        after[x, y] = found
            states = after
        cost, text = min(states.values())
        return "".join(settled) + text[:-1], cost

    def _put(self, match: re.Match) -> str:
        stretch = match[0]
        if not _EVIDENCE.search(stretch) and APART.fullmatch(stretch):
            return stretch
        if len(stretch) <= LONGEST:
            return self.restore(stretch)
        restored, cost = self._decoded(stretch)
        if not APART.fullmatch(stretch) and _MIXED.match(stretch) and cost > self.plausible * len(_RUN.sub(r"\1", stretch)):
            return stretch  # no words under the language model, however long: a key or a hash
        return restored

    def joined(self, text: str) -> str:
        """The text with letters that stood apart put together."""
        return APART.sub(self._put, text) if _ANY_APART.search(text) else text

    def restored(self, text: str) -> str:
        """The text in lower case with its disguised stretches restored."""
        return DISGUISED.sub(self._put, self.joined(text)).lower()


class Reader:
    """Counts of the beginnings of a restored text's words (a word's end is a sign of its own); each stretch between white space is looked into once."""

    def __init__(self, decoder: Decoder, wanted: dict | None = None):
        self._decoder, self._wanted = decoder, wanted
        self._known: dict[str, tuple[int, tuple[str, ...]]] = {}

    def _look(self, stretch: str) -> tuple[int, tuple[str, ...]]:
        if len(self._known) > KNOWN_STRETCHES:
            self._known.clear()
        bare = stretch.strip(_ENDS)
        if not _SUSPECT.search(bare):
            words = [bare.lower()] if bare.isalpha() else _WORD.findall(bare.lower())
        else:
            words = _WORD.findall(DISGUISED.sub(self._decoder._put, stretch).lower())
        found = []
        for word in words:
            ended = word + "$"
            found += [ended[:k] for k in BEGINNINGS if k <= len(ended)] or [ended]
        if self._wanted is not None:
            found = [b for b in found if b in self._wanted]
        self._known[stretch] = entry = (len(words), tuple(found))
        return entry

    def read(self, text: str) -> tuple[Counter, int]:
        """(counts of beginnings, number of words)."""
        found: Counter = Counter()
        total, known = 0, self._known
        for stretch, n in Counter(self._decoder.joined(text).split()).items():
            words, names = known.get(stretch) or self._look(stretch)
            total += words * n
            for b in names:
                found[b] += n
        return found, total


@dataclass
class Model:
    """A logistic model: for each beginning, the weights of its presence and of its rate."""

    trigrams: np.ndarray
    weights: dict[str, tuple[float, float]]
    intercept: float

    def scorer(self) -> Callable[[str], float]:
        reader, weights = Reader(Decoder(self.trigrams), self.weights), self.weights

        def score(text: str) -> float:
            counts, words = reader.read(text)
            z = self.intercept
            for b, n in counts.items():
                presence, rate = weights[b]
                z += presence + rate * _rate(n, words)
            return 1 / (1 + math.exp(-min(60, max(-60, z))))

        return score


def _rate(n: int, words: int) -> float:
    return min(1.0, n * 60 / (words + 10))


def _fit(table: pa.Table) -> tuple[dict[str, tuple[float, float]], float]:
    """Weights and intercept by full-batch gradient steps with adapted sizes; features by their likelihood ratio. table: names, rates (of each name) and toxic of every row."""
    y = table.column("toxic").to_numpy().astype(float)
    n, positive = len(y), y.sum()
    if not 0 < positive < n:
        return {}, math.log((positive + 1) / (n - positive + 19))
    lists = table.column("names").combine_chunks()
    owner = np.repeat(np.arange(n, dtype=np.int32), np.asarray(pc.list_value_length(lists)))
    coded = lists.flatten().dictionary_encode()
    code, every = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    rate_of = table.column("rates").combine_chunks().flatten().to_numpy()
    del table, lists, coded
    with_it, toxic_with_it = np.bincount(code, minlength=len(every)), np.bincount(code, y[owner], len(every))
    useful = np.nonzero((toxic_with_it >= 3) & (toxic_with_it * n > with_it * positive))[0]
    names, a, c = [every[k] for k in useful], toxic_with_it[useful], with_it[useful].astype(float)
    expected = lambda o, rows_, share: np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / (rows_ * share)), 0)
    ratio = sum(expected(o, r, s) for o, r, s in ((a, c, positive / n), (c - a, c, 1 - positive / n), (positive - a, n - c + 1e-9, positive / n), (n - c - positive + a, n - c + 1e-9, 1 - positive / n)))
    chosen = [names[k] for k in np.lexsort((names, -ratio))[:FEATURES]] if names else []
    index, k = {b: i for i, b in enumerate(chosen)}, len(chosen)
    place = np.array([index.get(b, -1) for b in every], np.int64)[code]
    known = place >= 0
    at = np.concatenate([owner[known], owner[known]])
    column = np.concatenate([place[known], place[known] + k])
    value = np.concatenate([np.ones(known.sum()), rate_of[known]])
    del owner, code, rate_of, place, known
    w = np.append(np.zeros(2 * k), math.log(positive / (n - positive)))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for _ in range(400):
        z = np.bincount(at, value * w[column], n) + w[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        gradient = np.append(np.bincount(column, value * off[at], 2 * k) + 1e-4 * w[:-1], off.sum())
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w -= 0.05 * mean / (np.sqrt(square) + 1e-8)
    return {b: (float(w[i]), float(w[i + k])) for b, i in index.items()}, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, may_teach: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Count the character model over all docs and fit the classifier on at most sample_rows labelled ones. may_teach: a condition on doc_id."""
    counts = trigram_counts(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if may_teach is not None:
        known = known.where(may_teach)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "_labelled")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Decoder(counts))
        for batch in batches:
            found = [reader.read(t.as_py() or "") for t in batch.column("text")]
            names, rates = [list(c) for c, _ in found], [[_rate(n, words) for n in c.values()] for c, words in found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.list_(pa.string())), pa.array(rates, pa.list_(pa.float64())), batch.column("toxic")], ["names", "rates", "toxic"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = text.join(F.broadcast(sample), F.col("doc_id") == F.col("_labelled")).select("doc_id", "toxic", "text", F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("second"))
    # a doc_id may stand on any number of rows: each of its texts teaches once, and of those sample_rows at most, in hash order
    once = named.select("doc_id", "hash", "second").distinct().orderBy(F.xxhash64("doc_id", "hash"), "doc_id", "hash", "second").limit(sample_rows)
    once = F.broadcast(once.toDF("_d", "_h", "_s"))
    named = named.join(once, (F.col("doc_id") == F.col("_d")) & F.col("hash").eqNullSafe(F.col("_h")) & F.col("second").eqNullSafe(F.col("_s"))).dropDuplicates(["doc_id", "hash", "second"])
    rows = named.select("text", "toxic").mapInArrow(tidied(extract), "names array<string>, rates array<double>, toxic int")
    rows = stage(rows, "toxicity-sample")
    # The driver sees the bounded sample's features only; those of a single row in it teach nothing.
    frequent = rows.select(F.explode(F.col("names")).alias("name")).groupBy("name").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "name")
    toxic = rows.where("toxic = 1").select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("a")).where("a >= 3")
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    useful = frequent.join(toxic, "name").where(F.col("a") * totals["n"] > F.col("n") * totals["p"]).select("name", (F.col("a") / F.col("n")).alias("share"), "a")
    useful = {r["name"] for r in useful.orderBy(F.desc(F.col("share") * F.sqrt("a")), "name").limit(CANDIDATES * FEATURES).collect()}
    kept = F.filter(F.arrays_zip("names", "rates"), lambda z: z["names"].isin(sorted(useful)) if useful else F.lit(False))
    narrow = rows.select(kept.alias("z"), "toxic").select(F.col("z.names").alias("names"), F.col("z.rates").alias("rates"), "toxic")
    weights, intercept = _fit(narrow.toArrow())
    tidy()  # the driver's own memory
    return Model(counts, weights, intercept)


def with_scores(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with a column of scores from 0 to 1; every text is scored whole."""
    docs = docs.drop(name)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            scores = [score(t.as_py() or "") for t in batch.column("text").cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(tidied(add), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
