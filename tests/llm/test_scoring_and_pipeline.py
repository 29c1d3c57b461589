"""Toxicity, decontamination, confirmed near duplicates and the pipeline."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from histoloom.llm import decontamination, simhash, toxicity

SMALL = "/root/testdata/sf0.001"
SYLLABLES = ["ba", "lo", "mi", "ter", "un", "sa", "qui", "dor", "en", "val"]


def vocabulary(n=400, seed=1):
    rng = random.Random(seed)
    return list(dict.fromkeys("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(n)))


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def decoder():
    text = ("the idiot was a stupid clown and a loser " * 50 + " ".join(vocabulary()) + " good week hello book") * 3
    counts = np.zeros(28**3, np.int64)
    codes = [toxicity._class(c) for c in text]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        counts[(a * 28 + b) * 28 + c] += 1
    return toxicity.Decoder(counts)


@pytest.mark.parametrize(("written", "meant"), [("1d10t", "idiot"), ("stup1d", "stupid"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("idiooooot", "idiot"), ("cl0wn", "clown"), ("$tupid", "stupid"), ("l0s3r", "loser")])
def test_restores(decoder, written, meant):
    assert decoder.restored(f"You {written} there") == f"you {meant} there"


def test_plain_text_stays(decoder):
    for text in ("A plain book, seen in 1984; 42 good weeks.", "", "É ü ñ", "a3f9" * 30):
        assert decoder.restored(text) == text.lower()


def test_restores_long_and_accented(decoder):
    apart = " ".join("youareastupididiotandaloser")
    assert len(apart) > toxicity.LONGEST and "stupid" in decoder.restored(apart) and "idiot" in decoder.restored(apart)
    assert decoder.restored("You st" + "u" * 90 + "pid clown") == "you stupid clown"
    assert "".join(decoder.joined("ein d é b i l da").split()) == "eindébilda" and " b i l" not in decoder.joined("ein d é b i l da")
    assert decoder.restored("key " + "a3f9" * 30) == "key " + "a3f9" * 30


def test_settled_beginnings_change_nothing(decoder, monkeypatch):
    apart = ".".join("stupididiotclown" * 3) + ".1.d.1.0.t"
    monkeypatch.setattr(toxicity, "SETTLED_EVERY", 10**9)
    whole = decoder._restore(apart)
    monkeypatch.setattr(toxicity, "SETTLED_EVERY", 3)
    assert decoder._restore(apart) == whole and decoder.restored(apart) == whole


def test_viterbi_is_least_cost(decoder):
    for written in ("1d10t", "l 0 s e r", "cl00wnn", "b00k"):
        best = None
        paths = [("", 0.0)]
        for options in decoder.lattice(written):
            paths = [(t + o, c + e) for t, c in paths for o, e in options]
        for text, cost in paths:
            codes = [0, 0, *map(toxicity._class, text + " ")]
            total = cost + sum(decoder._cost[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))
            best = min(best or (total, text), (total, text))
        assert decoder.restore(written) == best[1]


def test_trigram_counts(spark):
    texts = ["Hello you", None, "", "ab", "zé z", "x" * 10]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    expected = np.zeros(28**3, np.int64)
    for t in texts:
        codes = [int(toxicity._CLASS[b]) for b in (t or "").encode()]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            expected[(a * 28 + b) * 28 + c] += 1
    assert toxicity.trigram_counts(df).tolist() == expected.tolist()


def toxic_rows(n=700, seed=2):
    rng, words = random.Random(seed), vocabulary()
    forms = ["idiot", "1d10t", "i d i o t", "idiooot", "stupid", "$tup1d", "clown", "cl0wn"]
    rows = []
    for k in range(n):
        text, toxic = sentence(rng, words, rng.randint(5, 120)), rng.random() < 0.2
        if toxic:
            at = rng.randrange(len(text))
            text = f"{text[:at]} {rng.choice(forms)} {text[at:]} {rng.choice(forms)}"
        rows.append((k, text, int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(None, "idiot", "x"), (9000, None, "x"), (9001, "", "x")], "doc_id long, text string, toxicity string").repartition(4)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 0)
    scored = {r.doc_id: r.toxicity for r in toxicity.with_scores(docs, model).collect()}
    assert len(scored) == len(rows) + 3 and all(0 <= s <= 1 for s in scored.values())
    held = [(scored[k] >= 0.3) == bool(y) for k, _, y in rows if k % 3 == 0]
    assert sum(held) / len(held) > 0.97
    assert scored[9000] == scored[9001] < 0.3


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert 0 < toxicity.with_scores(docs, toxicity.train(docs, labels)).first().toxicity < 0.3
    assert toxicity.with_scores(docs.where("false"), toxicity.train(docs.where("false"), labels)).count() == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert decontamination.common(a, b) == lcs(a, b)


def leaked(seed=4):
    rng, words = random.Random(seed), vocabulary(900)
    common = words[:12]
    mixed = words + common * 30
    bench = [(k, sentence(rng, mixed, rng.choice([8, 15, 30])) + "\n" + sentence(rng, mixed, rng.choice([5, 9, 20]))) for k in range(30)] + [(90, None), (91, "too short")]
    docs, planted = [], set()
    for k in range(150):
        text = " ".join(sentence(rng, mixed, rng.randint(5, 40)) for _ in range(rng.randint(1, 8)))
        if k % 3 == 0:
            item, passage = bench[k % 30]
            said = passage.split(" ")
            if k % 2:  # a paraphrase: some words are others
                for at in rng.sample(range(len(said)), len(said) // 6):
                    said[at] = rng.choice(mixed)
            at = rng.randrange(len(text))
            text = text[: text.rfind(" ", 0, at) + 1] + " ".join(said) + " " + text[text.rfind(" ", 0, at) + 1 :]
            planted.add((k, item))
        docs.append((k, text))
    return bench, docs, planted


def test_leaks_are_found_and_clean_texts_stay(spark):
    bench, docs, planted = leaked()
    df = spark.createDataFrame([(k, t, "x") for k, t in docs] + [(None, bench[0][1], "x"), (700, None, "x"), (701, "", "x")], "doc_id long, text string, item_id string").repartition(4)
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(df, items).collect()}
    assert got == planted | {(None, 0)}
    kept = decontamination.clean_documents(df, items)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({k for k, _ in docs} - {k for k, _ in planted} | {700, 701})
    assert decontamination.contaminations(df, items.where("false")).count() == 0
    assert decontamination.contaminations(df.where("false"), items).count() == 0


def test_block_frequencies_and_singular_values(spark):
    """The pass over the corpus against plain counts and numpy's own decomposition."""
    bench, docs, _ = leaked(5)
    df = spark.createDataFrame([*docs, (None, None), (1, "")], "doc_id long, text string").repartition(3)
    words, items = decontamination.read_items([b for b in bench if b[1]])
    index = {w: k for k, w in enumerate(words)}
    blocks = []
    for _, text in docs:
        code = [index.get(w, -1) for w in decontamination.words_of(text)]
        blocks += [[c for c in code[a : a + 32] if c >= 0] for a in range(0, len(code), 32)]
    counts = np.zeros((len(blocks), len(words)))
    for k, block in enumerate(blocks):
        np.add.at(counts[k], block, 1)
    start = np.random.default_rng(1).normal(size=(len(words), 60)).astype(np.float32)
    held, product = decontamination.corpus_sketch(df, words, start)
    assert held.tolist() == [*(counts > 0).sum(0).tolist(), len(blocks)]
    assert np.allclose(product, counts.T @ (counts @ start), rtol=1e-3, atol=1e-2)
    matrix = np.random.default_rng(2).normal(size=(200, 40)) * 0.5 ** np.arange(40)
    gram = matrix.T @ matrix
    test = np.random.default_rng(3).normal(size=(40, 16))
    found = decontamination._nystrom(gram @ test, test, 6)
    _, _, right = np.linalg.svd(matrix, full_matrices=False)
    assert np.allclose(np.abs((found.T @ right[:6].T).diagonal()), 1, atol=1e-3)


def test_benchmarks_of_short_items_and_of_one_long_item(spark, monkeypatch):
    """Short items alone, known to no document or to some; an item whose parts stand in several blocks; words that no block holds."""
    docs = spark.createDataFrame([(1, "nothing here at all"), (2, "so one, two three!"), (3, None)], "doc_id long, text string")
    bench = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    found = lambda items, rows=docs: {(r.doc_id, r.item_id) for r in decontamination.contaminations(rows, items).collect()}
    assert found(bench("one two three", "x")) == {(2, 0)} and found(bench("four five")) == set()
    assert decontamination.clean_documents(docs, bench("one two three")).count() == 2
    assert found(bench("none of these six words known")) == set()
    monkeypatch.setattr(decontamination, "ITEMS_A_PASS", 3)
    rng, words = random.Random(3), vocabulary(400)
    long = [rng.choice(words) for _ in range(10 * decontamination.PART_WORDS)]
    rows = [(k, " ".join(rng.choices(words, k=60) + long[48 * k : 48 * k + 48] * (k % 2) + rng.choices(words, k=60))) for k in range(10)]
    assert found(bench(" ".join(long)), spark.createDataFrame(rows, "doc_id long, text string")) == {(k, 0) for k in range(1, 10, 2)}


def test_labels_of_a_doc_id_on_many_rows_teach_once(spark):
    """What reaches the classifier is bounded, however many rows a labelled doc_id has."""
    rows = [(1, f"text {k} here") for k in range(300)] + [(1, "text 0 here")] * 200 + [(2, "other words"), (3, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    seen, kept = [], toxicity.stage
    try:
        toxicity.stage = lambda df, label: (seen.append(kept(df, label)), seen[-1])[1]
        toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample_rows=5)
    finally:
        toxicity.stage = kept
    assert seen[0].count() == 5


def test_long_disguised_stretches_are_told_from_keys(spark):
    rng, words = random.Random(5), ["stupid", "idiot", "clown", "garbage", "morning", "river", "window", "letter"]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=40))) for k in range(60)], "doc_id long, text string")
    decoder = toxicity.Decoder(toxicity.trigram_counts(docs))
    hidden = "".join(rng.choices(words[:4], k=12))
    written = hidden.replace("i", "1").replace("o", "0").replace("a", "4")
    assert len(written) > toxicity.LONGEST and decoder.restored(f"the {written} end") == f"the {hidden} end"
    keys = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0134578", k=64)) for _ in range(20)]
    assert all(decoder.restored(key) == key for key in keys)


def test_more_items_than_the_rank_and_short_ones_in_long_texts(spark):
    rng, words = random.Random(12), vocabulary(3000)
    mixed = words + words[:12] * 30
    bench = [(k, sentence(rng, mixed, rng.choice([8, 12, 30])) + " " + sentence(rng, mixed, 5)) for k in range(500)] + [(900, "quolomi terqui"), (901, "Zzun badoren valun.")]
    docs = []
    for k in range(400):
        text = [rng.choice(mixed) for _ in range(rng.choice([30, 120, 600]))]
        if k % 2 == 0:
            text[len(text) // 2 : len(text) // 2] = bench[k // 2][1].split()
        docs.append((k, " ".join(text)))
    docs += [(1000, "so said zzun badoren, valun and more"), (1001, "zzun badoren and valun")]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(df, items).collect()}
    planted = {(k, k // 2) for k in range(0, 400, 2)} | {(1000, 901)}
    assert len(planted - got) <= 2 and (1000, 901) in got
    assert len({d for d, _ in got} - {d for d, _ in planted}) <= 2


def test_candidates_miss_no_checked_pair(spark):
    """Every block region against every item by the word checks alone finds the same documents."""
    bench, docs, _ = leaked(8)
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    words, parts = decontamination.read_items([b for b in bench if b[1]])
    parts = [p for p in parts if len(p.words) >= decontamination.LEAST_WORDS]
    idf = decontamination.make_probe(df, [b for b in bench if b[1]], 128, 11).idf
    index = {w: k for k, w in enumerate(words)}
    expected = set()
    for k, text in docs:
        code = [index.get(w, -1) for w in decontamination.words_of(text)]
        for low in range(-32, len(code), 32):
            region = code[max(0, low) : low + 128]
            expected |= {(k, p.item_id) for p in parts if region and decontamination.check(p, decontamination.rare_words(p, idf), region, 0.6)}
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminations(df, items).collect()}
    assert len(expected - got) <= 0.02 * len(expected) and got <= expected


def test_similar_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_TEXTS", 6)
    rng, words = random.Random(6), vocabulary()
    texts = [None, "", " ", "one two", "one two"]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, bits int").repartition(3)
    sets = [frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    same = lambda a, b: (texts[a] or "") == (texts[b] or "") or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if same(a, b):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    kept = sorted(r.doc_id for r in simhash.drop_similar(df).collect())
    assert kept == sorted(set(root))
    assert simhash.drop_similar(df.where("false")).count() == 0


def test_wide_fingerprints_find_cut_and_edited_copies():
    """Pairs at a similarity of 0.80 to 0.90, cut short or edited in places: nearly all share two bytes and stay within the bits."""
    rng, found, total = np.random.default_rng(3), 0, 0
    for n in (60, 150, 400):
        for similarity in (0.8, 0.85, 0.9):
            for k in range(120):
                one = rng.integers(0, 1 << 62, n)
                shared = int(np.ceil(similarity * n if k % 2 else 2 * n * similarity / (1 + similarity)))
                two = one[:shared] if k % 2 else np.concatenate([one[:shared], rng.integers(0, 1 << 62, n - shared)])
                a, b = (simhash.wide_fingerprint(np.sort(x)) for x in (one, two))
                x, y = a.view(np.uint8), b.view(np.uint8)
                met = any(x[i] == y[i] and x[j] == y[j] for i, j in simhash.BYTE_PAIRS)
                found += met and np.bitwise_count(a ^ b).sum() <= simhash.WIDE_BITS and np.bitwise_count(a[0] ^ b[0]) <= simhash.FIRST_BITS
                total += 1
    assert found >= 0.98 * total


def test_clashing_column_names_pass_through(spark):
    names = ["_id", "_hash", "hash", "second", "own", "text_id", "_row"]
    words = " ".join(vocabulary()[:40])
    df = spark.createDataFrame([(1, words, *names), (2, words, *names), (3, None, *names)], "doc_id int, text string, " + ", ".join(f"{c} string" for c in names))
    kept = simhash.drop_similar(df)
    assert kept.dtypes == df.dtypes
    assert [tuple(r) for r in kept.orderBy("doc_id").collect()] == [(1, words, *names), (3, None, *names)]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, SMALL), name, keep=True)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and (name != "line_dedup" or after == before)
        if name == "toxicity":  # 66 labels teach little, but the dropped documents are toxic ones
            toxic = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 1").collect()}
            clean = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("toxic = 0").collect()}
            assert len(after & toxic) <= len(toxic) / 2 and len(clean - after) <= len(clean) / 10
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == before


def test_pipeline_takes_nulls_and_nothing(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 60000, "en", "s", 120000)], schema)
    for docs, least in ((odd, 1), (odd.where("false"), 0)):
        for name, function in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(function(spark, docs, SMALL), name, keep=True)
        assert docs.count() >= least
