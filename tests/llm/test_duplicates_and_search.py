"""Near duplicates, repeated passages, conversation collapse and vector search against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from histoloom.llm import ann, chat, simhash, substring_dedup
from histoloom.llm.components import connected_components

WORDS = [f"word{k}" for k in range(300)]


def classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(seed=3):
    rng = np.random.default_rng(seed)
    texts = [None, "", " \n", "One two", "ÀÉ Σ x y\tz\x0b q", "a a a a a a a"]
    for _ in range(40):
        words = rng.choice(WORDS, rng.integers(3, 400)).tolist()
        texts.append(" ".join(words))
        for _ in range(rng.integers(0, 4)):
            copy = list(words)
            for _ in range(rng.integers(0, 3)):
                copy[rng.integers(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize(("threshold", "blocks"), [(4, None), (4, 4), (8, 2), (10, 5)])
def test_simhash_components(spark, threshold, blocks):
    texts = near_texts()
    df = spark.createDataFrame([(k * 3, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, bits int, root int").repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(df, threshold, blocks=blocks).collect()}
    prints = [plain_fingerprint(t or "") for t in texts]
    assert [got[3 * k].fingerprint for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    linked = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= threshold]
    assert [got[3 * k].component_id // 3 for k in range(len(texts))] == classes(len(texts), linked)


def test_simhash_nulls_and_empty(spark):
    schema = "doc_id long, text string"
    rows = simhash.near_duplicates(spark.createDataFrame([(None, "x y z w"), (5, None), (5, None), (2, "")], schema)).collect()
    assert sorted((r.component_id if r.component_id is not None else -1) for r in rows) == [-1, 2, 2, 2]
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_exact_search_in_large_leaves(monkeypatch):
    monkeypatch.setattr(simhash, "SCAN_ROWS", 16)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    bits = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for c in centres]))
    labels = simhash.linked(bits, 3, np.arange(len(bits)), np.arange(len(bits)))
    pairs = zip(*np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3))
    assert labels.tolist() == classes(len(bits), pairs)


def test_chunked_leaves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 7)
    rng = np.random.default_rng(2)
    bits = np.unique(np.cumsum(rng.integers(0, 2, 200)) ^ (1 << rng.integers(0, 20, 200)))
    edges = simhash.links(spark.createDataFrame([(int(b),) for b in bits], "bits long"), 2)
    got = {r.node: r.root for r in connected_components(edges).collect()}
    labels = classes(len(bits), [(a, b) for a in range(len(bits)) for b in range(a) if int(bits[a] ^ bits[b]).bit_count() <= 2])
    assert [got.get(int(b), int(b)) for b in bits] == [int(bits[k]) for k in labels]


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (None, 3), (160, 100)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 161)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


PASSAGE = "Here stands a sentence of eight words. Then comes another one with seven words.\nA third line ends the passage with twelve words in all here. Yes."


def test_repeated_spans(spark):
    own = [f"Document {k} starts with its own sentence {k} about nothing. " for k in range(6)]
    texts = [own[0] + PASSAGE, own[1] + "mixed in " + PASSAGE + " tail of one", own[2], None, "", own[0] + PASSAGE, "Short one. Short one. Short one.", PASSAGE + " " + PASSAGE]
    df = spark.createDataFrame([(k, t, "clash", 0) for k, t in enumerate(texts)], "doc_id long, text string, row string, at int").repartition(3)
    spans = substring_dedup.repeated_spans(df, min_words=15)
    got = defaultdict(list)
    for r in spans.collect():
        got[r.doc_id].append((texts[r.doc_id][r.span_start : r.span_end], r.kept_doc_id))
    assert set(got) == {1, 5, 7}
    assert got[5] == [(texts[5].removesuffix(" Yes."), 0)]  # a unit without evidence ends no span
    assert all(kept == 0 for found in got.values() for _, kept in found)
    assert "Then comes another one with seven words.\nA third line" in got[1][0][0]
    cleaned = {r.doc_id: (r.text, r.kept_spans) for r in substring_dedup.remove_spans(df, spans).collect()}
    assert cleaned[0][0] == texts[0] and cleaned[3][0] is None and cleaned[5][0] == " Yes."
    for k in (0, 1, 2, 7):
        assert "".join(texts[k][s.start : s.end] for s in cleaned[k][1]) == cleaned[k][0]
    assert substring_dedup.repeated_spans(df.where("false")).count() == 0


def plain_spans(docs, unit_words, min_words):
    """Spans by one pass over the rows in order: a dictionary of first occurrences, then runs."""
    first, rows = {}, []
    for d, t in sorted(docs, key=lambda r: r[0]):
        units, start = [], 0
        for m in re.finditer(r"\n|[.!?]+(?=\s)", t or ""):
            units.append((start, m.end()))
            start = m.end()
        if t and start < len(t):
            units.append((start, len(t)))
        marked = []
        for a, b in units:
            words = t[a:b].lower().split()
            if len(words) >= unit_words:
                key = " ".join(words)
                marked.append((a, b, len(words), key in first, first.setdefault(key, d)))
        run = []
        for unit in [*marked, (0, 0, 0, False, None)]:
            if unit[3]:
                run.append(unit)
            elif run:
                if sum(u[2] for u in run) >= min_words:
                    rows.append((d, run[0][0], run[-1][1], sum(u[2] for u in run), run[0][4]))
                run = []
    return sorted(rows)


def test_spans_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    stock = [" ".join(rng.choice(WORDS, rng.integers(1, 14)).tolist()).capitalize() + rng.choice([".", "!", "?", "..."]) for _ in range(60)]
    docs = []
    for k in range(120):
        parts = rng.choice(stock, rng.integers(0, 12)).tolist()
        docs.append((k, "".join(p + rng.choice([" ", "\n", " \n "]) for p in parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.span_start, r.span_end, r.words, r.kept_doc_id) for r in substring_dedup.repeated_spans(df, min_words=9).collect())
    assert got == plain_spans(docs, 4, 9) and len(got) > 50


def plain_passages(docs, unit_words, min_words):
    """Characters that unit spans or repeated windows cover, by document; windows by a dictionary of first occurrences."""
    covered = {d: set() for d, _ in docs}
    for d, a, b, *_ in plain_spans(docs, unit_words, min_words):
        covered[d].update(range(a, b))
    first = {}
    for d, t in sorted(docs, key=lambda r: r[0]):
        found = list(re.finditer(r"\S+", t))
        for k in range(len(found) - min_words + 1):
            key = " ".join(m[0].lower() for m in found[k : k + min_words])
            kept = first.setdefault(key, (d, k))
            if kept[0] != d or kept[1] + min_words <= k:
                covered[d].update(range(found[k].start(), found[k + min_words - 1].end()))
    return covered


@pytest.mark.parametrize("filter_bits", [16, 0])
def test_passages_across_sentences_equal_brute_force(spark, monkeypatch, filter_bits):
    monkeypatch.setattr(substring_dedup, "WINDOW_WORDS", 150)
    if not filter_bits:
        monkeypatch.setattr(substring_dedup, "MOST_BITS", 64)  # a full filter loses nothing
    rng = np.random.default_rng(11)
    stock = rng.choice(WORDS, 60).tolist()
    docs = [(0, "a b " * 40), (1, "The Same text " * 3), (2, "")]
    for k in range(3, 60):
        words = rng.choice(WORDS, rng.integers(0, 60)).tolist()
        for _ in range(rng.integers(0, 3)):
            a, at = rng.integers(0, 40), rng.integers(0, len(words) + 1)
            words[at:at] = stock[a : a + rng.integers(5, 20)]
        docs.append((k, "".join(w + rng.choice([" ", " ", " ", ". ", "\n", " \n "]) for w in words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {d: set() for d, _ in docs}
    for r in substring_dedup.repeated_passages(df, "sentence", min_words=9).collect():
        assert not got[r.doc_id] & set(range(r.span_start, r.span_end)) and r.kept_doc_id <= r.doc_id
        assert r.words == len(dict(docs)[r.doc_id][r.span_start : r.span_end].split())
        got[r.doc_id].update(range(r.span_start, r.span_end))
    assert got == plain_passages(docs, 4, 9) and sum(map(bool, got.values())) > 10


def test_passage_that_begins_and_ends_inside_sentences(spark):
    own = [[f"own{d}x{k}" for k in range(10)] for d in range(2)]
    shared = [f"shared{k}" + ("." if k % 20 == 10 else "") for k in range(51)]
    texts = [" ".join([*o[:5], *shared, *o[5:]]) + "." for o in own]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    assert [(r.doc_id, r.words, r.kept_doc_id, texts[1][r.span_start : r.span_end]) for r in rows] == [(1, 51, 0, " ".join(shared))]
    assert substring_dedup.repeated_passages(df.where("false")).count() == 0


def test_spans_leave_null_ids_and_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(1, text, "c", "k"), (None, "own " + text + " end", "c", "k"), (2, None, "c", "k")], "doc_id int, text string, cuts string, kept string")
    spans = substring_dedup.repeated_passages(df)
    assert [(r.doc_id, r.words) for r in spans.collect()] == [(None, 60)]
    cleaned = substring_dedup.remove_spans(df, spans)
    assert cleaned.columns == [*df.columns, "kept_spans"]
    assert {(r.doc_id, r.text, r.cuts, r.kept) for r in cleaned.collect()} == {(1, text, "c", "k"), (None, "own  end", "c", "k"), (2, None, "c", "k")}


def test_very_long_and_repeated_texts(spark):
    text = " ".join(f"w{k % 5000}" for k in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text), (2, text), (3, "")], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    assert {r.doc_id for r in rows if r.span_end - r.span_start == len(text)} == {2} and all(r.kept_doc_id == 1 for r in rows)
    prints = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in prints) == [(1, 1), (2, 1), (2, 1), (3, 3)]


def test_runs_without_any_likely_window(spark):
    docs = [(k, " ".join(f"w{k}x{j}" for j in range(60))) for k in range(3)] + [(3, ""), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = substring_dedup.pieces(df, np.zeros(1, np.uint64), "line", 4, 50).collect()
    assert sorted((r.doc_id, r.start, r.end, r.words, r.window) for r in rows) == [(k, 0, len(docs[k][1]), 60, False) for k in range(3)]


@pytest.mark.parametrize("text", ["", " ", "a", " a\u3000b\xa0c\x1fd\n", "é 日本 x", "a\u200bb c"])
def test_word_spans(text):
    start, end = substring_dedup.word_spans(text)
    assert [text[a:b] for a, b in zip(start, end)] == text.split()


def test_sentence_offsets_cover_the_text():
    for kind in substring_dedup.ENDS.values():
        for text in ("a. b! c\n\nd?", "...", "\n", "x", "é. 日本. "):
            spans = list(substring_dedup.split_units(text, re.compile(kind)))
            assert "".join(text[a:b] for a, b in spans) == text


def snapshots():
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", None)]
    rows = []
    for conv, length in ((1, 2), (2, 4), (3, 4), (4, 1)):
        rows += [(conv, k, *talk[k]) for k in range(length)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 7, "user", "hi"), (6, 9, "assistant", "hello"), (7, None, None, None)]
    return rows + [rows[0], rows[3]]


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_snapshot_collapse(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # conversations lie in one range or several
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check_snapshots(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def check_snapshots(spark):
    df = spark.createDataFrame([(*r, "x") for r in snapshots()], "conv_id long, turn long, role string, text string, number string")
    kept = chat.maximal_conversations(df)
    assert sorted({r.conv_id for r in kept.collect()}) == [2, 5, 7]
    rendered = {r.conv_id: r.rendered for r in chat.render_conversations(kept).collect()}
    assert rendered[2] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    for r in chat.render_turns(kept).collect():
        assert rendered[r.conv_id][r.start : r.start + len(r.segment)] == r.segment
    assert chat.render_turns(chat.maximal_conversations(df.where("false"))).count() == 0
    assert sorted((r.number, r.turn) for r in kept.where("conv_id = 2").collect()) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_many_turns_without_a_conversation(spark):
    """Rows of null conv_id with null and equal turn numbers are one conversation in order."""
    rows = [(None, None if k % 3 else 5, "user", f"text {k}") for k in range(300)]
    df = spark.createDataFrame(rows + rows[:50], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kept = sorted((r.number, r.start, r.text) for r in chat.maximal_conversations(df).collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted((t is not None, hashlib.md5(x.encode()).hexdigest(), x) for _, t, _, x in rows)
    assert [x for *_, x in kept] == [x for *_, x in order] and [n for n, *_ in kept] == list(range(1, 301))
    lengths = [len(f"<|im_start|>user\n{x}<|im_end|>\n") for *_, x in kept]
    assert [s for _, s, _ in kept] == [sum(lengths[:k]) for k in range(300)]


def test_nearest_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    vectors[100:200] = vectors[100]  # more copies than neighbours asked for
    rows = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    narrow = [(6000 + k, [1.0 + k, 2.0], "x") for k in range(25)]  # of another length: a space of their own
    rows += narrow + [(5000, None, "x"), (5020, [0.0] * 16, "x"), (5040, [float("nan")] * 16, "x"), (5060, [1.0, None] * 8, "x"), (5080, [3.0], "x"), (None, [1.0] * 16, "x"), (5100, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf string").repartition(3)
    found = defaultdict(list)
    for r in ann.nearest(df, F.col("id") % 20 == 0, sample_rows=1024, leaf_rows=32).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert [v for v, _ in found.pop(6000)] == list(range(6024, 6004, -1)) and len(found.pop(6020)) == 20
    assert set(found) == set(range(0, 3000, 20))
    hits = 0
    for q, got in found.items():
        scores = vectors @ vectors[q]
        best = sorted((-s, k) for k, s in enumerate(scores) if k != q)[:20]
        hits += len({k for k, _ in got} & {k for _, k in best})
        assert len(got) == 20 and [(-s, k) for k, s in got] == sorted((-s, k) for k, s in got)
        assert all(abs(scores[k] - s) < 1e-9 for k, s in got)
    assert hits / (20 * len(found)) >= 0.9
    best = sorted((-round(float(s), 9), k) for k, s in enumerate(vectors @ vectors[100]) if k != 100)[:20]
    assert [k for k, _ in found[100]] == [k for _, k in best]


def test_nearest_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], schema), F.col("id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few)] == [(1, 2), (2, 1)]
    assert ann.nearest(spark.createDataFrame([], schema), F.col("id") == 0).count() == 0


def test_short_texts_are_linked_exactly(spark):
    """Texts of under SHORT_SHINGLES shingles: every pair of similarity 0.8 or more is found, in common lines and chains, too."""
    rng = np.random.default_rng(21)
    texts = ["", "one", "one two three four five six"]
    for _ in range(150):
        words = rng.choice(WORDS[:60], rng.integers(5, 40)).tolist()
        texts.append(" ".join(words))
        for _ in range(rng.integers(0, 4)):
            words = words + [f"more{rng.integers(9)}"] if rng.random() < 0.6 else words[: max(5, len(words) - 1)]
            texts.append(" ".join(words))
    common = "this very line stands in many of them".split()
    texts += [" ".join([*common, *rng.choice(WORDS[:5], rng.integers(0, 4)).tolist()]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r["class"] for r in simhash.similar_texts(df).collect()}
    sets = [frozenset(simhash.shingles(t).tolist()) for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if texts[a] == texts[b] or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes(len(texts), linked)
    assert len(set(zip(want, (got[k] for k in range(len(texts)))))) == len(set(want)) == len(set(got.values()))


def test_clustered_vectors_need_few_leaves(spark):
    """A sixteenth of the leaves is enough on vectors that have clusters; no vector is an entry of fewer leaves than trees."""
    rng = np.random.default_rng(31)
    centres = rng.normal(0, 1, (150, 16))
    vectors = centres[rng.integers(150, size=9000)] + rng.normal(0, 0.15, (9000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = ann.nearest(df, F.col("id") % 60 == 0, k=10, leaf_rows=32, visits=64).collect()  # 4 trees of 256 leaves
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = []
    for q, ids in got.items():
        near = vectors @ vectors[q]
        near[q] = -np.inf
        found.append(len(ids & set(np.argsort(-near)[:10].tolist())) / 10)
    assert len(got) == 150 and np.mean(found) >= 0.9
