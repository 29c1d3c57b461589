"""SuperMinHash groups, periodic runs and the divergence of sources against plain versions, with their edge cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from histoloom.llm import periodic_runs, source_audit, superminhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NOISE = "runs string, collapsed string, root int, n int, row int, sid int, bands int"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=2):
    words = WORDS.findall(lowered(text))
    return {tuple(words[j : j + min(k, len(words))]) for j in range(len(words) - min(k, len(words)) + 1)} if words else set()


def plain_components(ids, sets, percent):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            root[find(a)] = find(b)
    least = {}
    for k, d in enumerate(ids):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [least.get(find(k)) for k in range(len(ids))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("chunk", [512, 8])
def test_superminhash_components(spark, monkeypatch, chunk):
    """Chains, exact copies, short texts and groups near the threshold; small chunks deal a bucket out to several tasks."""
    monkeypatch.setattr(superminhash, "CHUNK_SETS", chunk)
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "ONE", "ÀÉ ß", "a b", "A  b\tc", "a b c d e f", "a b c d e f g", "x y " * 40]
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(2, 160))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(5)):  # copies of copies: a chain whose ends are no pair
            words = edited(rng, words, rng.randrange(0, 1 + len(words) // 12))
            texts.append(" ".join(words))
    base = [f"v{rng.randrange(300)}" for _ in range(120)]
    texts += [" ".join(edited(rng, base, rng.randrange(2, 9))) for _ in range(40)]  # one bucket of several components
    ids = [3 * k for k in range(len(texts))]
    rows = [*zip(ids, texts), (ids[-1], texts[-1]), (None, texts[-2]), (None, "nobody else has this"), (None, "")]
    df = spark.createDataFrame([(*r, *[None] * 7) for r in rows], f"doc_id long, text string, {NOISE}").repartition(3)
    got = superminhash.near_duplicates(df).collect()
    sets = [shingles(t) for _, t in rows]
    want = plain_components([d for d, _ in rows], sets, 80)
    want = [(d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, want)]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_superminhash_signatures():
    """Agreement estimates similarity, at no more variance than independent hashes; long sets in parts give the same registers."""
    rng = np.random.default_rng(7)
    seen = []
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 120, dtype=np.int64).view(np.uint64)
        one, two = np.sort(pool[:90]), np.sort(pool[30:])
        a, b = superminhash.signatures([one, two])
        seen.append((a == b).mean())
    assert abs(np.mean(seen) - 0.5) < 0.01 and np.var(seen) < 0.5 * 0.5 / 200
    long = np.sort(rng.integers(0, 1 << 63, 3 * superminhash.SHINGLES_AT_ONCE, dtype=np.int64).view(np.uint64))
    parts = superminhash.signatures([long[k :: 7] for k in range(7)])
    assert (superminhash.signatures([long])[0] == parts.min(0)).all()
    assert (superminhash.signatures([one, long, two])[[0, 2]] == superminhash.signatures([one, two])).all()


def test_superminhash_empty_table(spark):
    assert superminhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    alone = superminhash.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, alone)) == [(1, 0, 1, True), (2, 0, 2, True)]


def plain_runs(words):
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and all(any(words[i + x] != words[i + x + d] for x in range(length - d)) for d in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out)


def plain_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def test_periodic_runs(spark):
    rng = random.Random(11)
    texts = [None, "", " \n ", "a", "a " * 5, "a " * 6, "b a a a a a a c", "ab cd " * 4, "ab cd ef " * 4 + "ab cd", "é é é é é é"]
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(6)):
            part = [rng.choice("abc") for _ in range(rng.randrange(1, 10))]
            words += part * rng.randrange(1, 7) + part[: rng.randrange(len(part) + 1)]
        texts.append((" ", "\t", " \x0b\n")[rng.randrange(3)].join(words))
    texts.append("long " + " ".join(f"u{k % 5003}" for k in range(4 * 5003)) + " tail")  # one run of 20,012 words
    df = spark.createDataFrame([(k, t, *[None] * 7) for k, t in enumerate(texts)] + [(1, "x x x x x x", *[None] * 7)] * 2, f"doc_id long, text string, {NOISE}").repartition(3)
    got = periodic_runs.with_runs(df)
    assert [c for c in got.columns if c not in ("runs", "collapsed")] == [c for c in df.columns if c not in ("runs", "collapsed")]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        words = WORDS.findall(r.text or "")
        runs = plain_runs(words) if len(words) < 5000 else [(1, 20012, 5003)]
        assert [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == plain_collapsed(words, runs)
    assert periodic_runs.with_runs(df.limit(0)).collect() == []


def test_range_successor():
    rng = np.random.default_rng(1)
    for n in (1, 2, 63, 64, 65, 1000):
        order = rng.permutation(n)
        tree = periodic_runs.WaveletTree(order)
        low = rng.integers(0, n, 200)
        high = np.minimum(n, low + rng.integers(1, n + 1, 200))
        bound = rng.integers(0, n + 1, 200)
        below = tree.count_below(low, high, bound)
        assert below.tolist() == [int((order[a:b] < c).sum()) for a, b, c in zip(low, high, bound)]
        there = below < high - low
        assert tree.select(low[there], high[there], below[there]).tolist() == [min(x for x in order[a:b] if x >= c) for a, b, c in zip(low[there], high[there], bound[there])]


def plain_audit(rows, least, top):
    rows = [[x or "" for x in r] for r in rows]
    cut = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for lang, source, text in rows]
    frequency, counts, out = Counter(), defaultdict(Counter), []
    for lang, source, found in cut:
        frequency.update((lang, t) for t in set(found))
        counts[lang, source].update(found)
    for lang in {r[0] for r in cut}:
        kept = [t for (x, t), n in frequency.items() if x == lang and n >= least]
        groups = sorted(s for x, s in counts if x == lang)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(counts[lang, s]) for s in groups}, share(sum((counts[lang, s] for s in groups), Counter()))
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            over = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(3, 50), (2, 4), (10**6, 50)])
def test_source_divergence(spark, least, top, monkeypatch):
    monkeypatch.setattr(source_audit, "KEPT_TERMS", 40)
    rng = random.Random(2)
    words = ["the", "The", "of", "and", "Straße", "ÀB", "àb", "x1y", "don't", "日本"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(None, None, None), ("en", "z", ""), ("en", "é", "123 ..."), ("", "a", "the the"), ("fr", None, "seul")]
    for _ in range(120):
        row = (rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", "Z"]), " ".join(rng.choices(words, k=rng.randrange(1, 25))))
        rows += [row] * rng.choice([1, 1, 1, 4]) + [(row[0], "c", row[2])] * rng.randrange(2)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, source string, text string, n int, term int, held string").repartition(4)
    got = source_audit.divergence(df, least, top)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, least, top)


def test_source_divergence_counts(spark):
    """Counts beyond what 64 bits hold once multiplied; and an empty table."""
    n, total, kept = 5 * 10**15, 10**16, 10**9
    share = spark.createDataFrame([(n, total, kept)], "n long, t long, k long").select(source_audit._share("n", "t", "k").alias("p"))
    assert share.first().p == 1 + 10**9 * (n + 5) // (total + 5 * kept)
    assert source_audit.divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    assert source_audit.terms("Ab-c ÄÖ\x00d") == ["ab", "c", "ÄÖ", "d"]

