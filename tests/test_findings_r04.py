"""What the findings of round 4 asked for."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest

from histoloom.llm import simhash
from histoloom.operators import metrics


@pytest.mark.parametrize("similarity", [0.8, 0.6, 0.5])
def test_similar_sets_share_a_key_of_neighbours(similarity):
    """Whatever lies in which set alone, and however the shingles are ordered."""
    rng = np.random.default_rng(8)
    for k in range(3000):
        union = rng.integers(-(1 << 63), (1 << 63) - 1, int(rng.integers(1, 60 if k % 2 else 8)))
        apart = int((1 - similarity) * len(union) + 1e-9)
        often = (np.sort(union), rng.integers(0, 3, len(union)))
        order = simhash._ordered(union, often)
        # the shingles of one set alone: anywhere, at the beginning, or every second one of the first
        alone = [rng.permutation(len(union))[:apart], np.arange(apart), np.arange(0, 2 * apart, 2) % max(len(union), 1)][k % 3]
        in_one = rng.random(len(alone)) < [0.5, 0, 1][int(rng.integers(3))]
        one, two = np.sort(np.delete(order, alone[~in_one])), np.sort(np.delete(order, alone[in_one]))
        if len(one) and len(two):
            assert set(simhash.neighbours(one, similarity, often).tolist()) & set(simhash.neighbours(two, similarity, often).tolist())


def test_crowds_of_texts_that_differ_are_told_apart_by_sketches(spark, monkeypatch):
    """150 texts around one passage, five of them with a near copy: whole sets of the ten alone, and the links of all pairs; with crowds in chunks, too."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(490)]
    docs = []
    for k in range(150):
        words = [word() for _ in range(45)] + passage + [word() for _ in range(55 + k % 3)]
        docs.append((k, " ".join(words)))
        if k < 5:
            docs.append((1000 + k, " ".join([*words, word(), word()])))
    df, sets = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), {d: set(simhash.shingles(t).tolist()) for d, t in docs}
    linked = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert linked == {(k, 1000 + k) for k in range(5)}
    staged, kept = {}, simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda frame, label: staged.setdefault(label, kept(frame, label)))
    for at_once, whole in ((4096, 12), (64, 12), (5, len(docs))):
        monkeypatch.setattr(simhash, "PAIRED_SETS", at_once)
        staged.clear()
        got = {r.doc_id: r["class"] for r in simhash.similar_texts(df).collect()}
        assert {(a, b) for a, b in itertools.combinations(sorted(got), 2) if got[a] == got[b]} == linked
        assert 10 <= staged["shingle-sets"].count() <= whole


def test_pairs_are_made_from_one_sample_at_a_time(spark, monkeypatch):
    """In one piece of generated code both explodes would hold all pairs of two blocks (a million) as rows before the first one is passed on."""
    monkeypatch.setattr(metrics, "BLOCK_SAMPLES", 8)
    pairs = metrics.all_pairs(spark.range(30).withColumnRenamed("id", "sample_id"))
    assert sorted(map(tuple, pairs.collect())) == list(itertools.combinations(range(30), 2))
    parts = dict(re.findall(r"\*\((\d+)\) Generate explode\((\w+)", pairs._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]))
    assert {"_ids", "_ones"} <= set(parts.values())


def test_one_row_stays_of_rows_equal_in_doc_id_and_text(spark):
    """Also where doc_ids are null, other columns differ, or the text has near copies; a doc_id on different texts keeps each."""
    words = [f"w{k}" for k in range(60)]
    text, near, other = " ".join(words), " ".join([*words, "more"]), " ".join(words[::-1])
    rows = [(None, text, "b"), (None, text, "a"), (None, text, "a"), (7, other, "x"), (7, other, "x"), (7, other, "y"), (8, near, "z"), (None, None, "n"), (None, "", "n"), (3, "alone", "k"), (3, "lonely", "k")]
    df = spark.createDataFrame(rows, "doc_id int, text string, `a.b` string")
    found = []
    for parts in (1, 3):
        kept = simhash.drop_similar(df.repartition(parts))
        assert kept.dtypes == df.dtypes
        found.append(sorted(map(tuple, kept.collect()), key=str))
    assert found[0] == found[1]
    assert sorted((d or -1, t) for d, t, _ in found[0] if t) == sorted([(3, "alone"), (3, "lonely"), (7, other), (8, near)])
    assert len(found[0]) == 5 and len([t for _, t, _ in found[0] if not t]) == 1
    nameless = simhash.drop_similar(df.where("doc_id is null and text != ''")).collect()
    assert [r.text for r in nameless] == [text]
