"""Packing, sharding and token files against plain single-machine versions."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from histoloom.llm import packing, sharding, token_files
from histoloom.llm.tokens import Encoder
from histoloom.session import shared_path

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = " \n\t abcAß'sé1.<|endoftext|> ́Σ日本😀 "
SCHEMA = "doc_id long, text string, window_id string, row_number int"


def texts(n, seed=5):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "über", "it's", "42", "x", "naïve."]
    some = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 900, 2500]))) for _ in range(n)]
    odd = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return [None, "", " ", "\n", "a\n", "same", "same", *some, *odd]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "clash", 7) for k, t in rows], SCHEMA)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    values = [t or "" for t in texts(400)]
    flat, counts = Encoder(path).encode(pa.array(values))
    expected = [x.ids for x in Tokenizer.from_file(path).encode_batch(values, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in expected]
    assert flat.tolist() == [i for x in expected for i in x]


def test_packing_covers_every_id_once(spark):
    rows = [*enumerate(texts(60)), (None, "no id"), (3, "a second row of three")]
    pieces = packing.pack_documents(frame(spark, rows).repartition(5), BYTE, capacity=64, windows=4).collect()
    tokenizer = Tokenizer.from_file(BYTE)
    expected = sorted(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,) for k, t in rows if k not in (3, None))
    docs = defaultdict(dict)
    for p in pieces:
        if p.doc_id not in (3, None):
            docs[p.doc_id][p.start] = np.frombuffer(p.ids, "<u4").tolist()
            assert len(docs[p.doc_id][p.start]) == p.length
    got = sorted(tuple(i for at in sorted(d) for i in d[at]) for d in docs.values())
    assert got == expected
    for p in pieces:
        if p.doc_id in docs:
            assert p.doc_tokens == sum(map(len, docs[p.doc_id].values()))
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(p.length for p in pieces)
    assert total / (64 * len(by_sequence)) > 0.85


def test_packing_empty_table(spark):
    assert packing.pack_documents(frame(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1023, 4097])
def test_permutation(n):
    places = sharding.permute(np.arange(n), n, seed=3)
    assert sorted(places.tolist()) == list(range(n))
    assert sharding.permute(places, n, seed=3, inverse=True).tolist() == list(range(n))
    if n > 60:
        assert places.tolist() != sharding.permute(np.arange(n), n, seed=4).tolist()


def test_sharding(spark):
    rows = [(k % 90, t) for k, t in enumerate(texts(60))] + [(None, "x"), (None, None)]
    docs = sharding.with_digests(frame(spark, rows))
    first = sharding.shard_rows(docs, 24, 9, ["doc_id", "text_crc32", "size"]).collect()
    again = sharding.shard_rows(docs.repartition(7), 24, 9, ["doc_id", "text_crc32", "size"]).collect()
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, first)) == sorted(map(key, again))
    assert sorted((r.size, r.text_crc32) for r in first) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    slots = defaultdict(list)
    for r in first:
        slots[r.shard].append(r.slot)
        assert sharding.row_at(r.shard, r.slot, len(rows), 24, 9) == r.row_number
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_rows(docs.where("false"), 24, 9, ["doc_id"]).count() == 0


def test_token_files_round_trip(spark):
    rows = [*enumerate(texts(50)), (None, "no id"), (7, "again")]
    folder = shared_path(spark, "test-store")
    token_files.write_token_files(frame(spark, rows).repartition(6), folder, WORD)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(WORD)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert [r.doc_id for r in got] == [None, *sorted(k for k, _ in rows if k is not None)]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    by_id = dict(rows)
    for r in got:
        if r.doc_id not in (None, 7):
            assert np.frombuffer(r.ids, "<u4").tolist() == ids(by_id[r.doc_id])
    empty = shared_path(spark, "test-store")
    token_files.write_token_files(frame(spark, []), empty, WORD)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_packing_keeps_a_digest(spark):
    placed = packing.place_documents(frame(spark, [(1, "one two three")]), BYTE).withColumn("crc", F.crc32("ids")).drop("ids")
    row = packing.merge_leftovers(placed).first()
    expected = np.array([*Tokenizer.from_file(BYTE).encode("one two three").ids, 0], "<u4")
    assert row.crc == zlib.crc32(expected.tobytes())


def test_texts_longer_than_a_batch(spark):
    """One text of five megabytes: every id stands in one piece, and the token file holds what the library gives."""
    rng = random.Random(8)
    words = ["alpha", "Beta", "it's", "42", "naïve.", "longer\n", "tokens"]
    long = " ".join(rng.choices(words, k=900_000))
    assert len(long.encode()) > 5 << 20
    rows = [(1, "before"), (2, long), (3, "after"), (4, None)]
    ids = {d: Tokenizer.from_file(BYTE).encode(t or "", add_special_tokens=False).ids + [0] for d, t in rows}
    held = defaultdict(list)
    for p in packing.pack_documents(frame(spark, rows).coalesce(1), BYTE).select("doc_id", "start", F.crc32("ids").alias("crc"), "length").collect():
        held[p.doc_id].append((p.start, p.length, p.crc))
    for d, own in ids.items():
        at = 0
        for start, length, crc in sorted(held[d]):
            assert start == at and crc == zlib.crc32(np.asarray(own[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(own)
    folder = shared_path(spark, "long-text")
    token_files.write_token_files(frame(spark, rows), folder, WORD)
    expected = {d: len(Tokenizer.from_file(WORD).encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_files.read_token_files(spark, folder).select("doc_id", "n_tokens").collect()} == expected
