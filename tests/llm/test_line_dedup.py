"""The edit join against plain edit distances."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from histoloom.llm import line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, times):
    chars = list(line)
    for _ in range(times):
        at = rng.randrange(len(chars) + 1)
        kind = rng.choice("isd")
        if kind == "i":
            chars.insert(at, rng.choice("abcxyzé"))
        elif at < len(chars):
            if kind == "s":
                chars[at] = rng.choice("abcxyzé")
            else:
                del chars[at]
    return "".join(chars)


def some_lines(seed, n=25):
    rng = random.Random(seed)
    lines = []
    for _ in range(n):
        base = "".join(rng.choice("abc dé") for _ in range(rng.choice([18, 20, 21, 25, 40, 90])))
        lines += [base, *(edited(rng, base, rng.randrange(5)) for _ in range(4))]
    return lines


@given(st.text("abé", max_size=14), st.text("abé", max_size=14), st.integers(1, 4))
@settings(max_examples=400, deadline=None)
def test_banded_distance(a, b, edits):
    assert line_dedup.within([a], [b], edits).tolist() == [distance(a, b) <= edits]


def test_banded_distance_many_at_once():
    rng = random.Random(1)
    pairs = [(a, edited(rng, a, rng.randrange(6))) for a in some_lines(2, 60)]
    assert line_dedup.within(*map(list, zip(*pairs)), 3).tolist() == [distance(a, b) <= 3 for a, b in pairs]


def test_segments_meet_for_every_close_pair():
    rng = random.Random(7)
    for edits in (1, 2, 3):
        for _ in range(1500):
            a = "".join(rng.choice("abé日") for _ in range(rng.randrange(8, 30)))
            b = edited(rng, a, rng.randrange(edits + 1))
            short, long = sorted((a, b), key=len)
            index = {(k, short[s : s + n]) for k, (s, n) in enumerate(line_dedup.segments(len(short), edits))}
            assert any((k, long[s : s + n]) in index for k, s, n in line_dedup.probes(len(long), len(short), edits))
            one, two = line_dedup.sketches(pa.array([a, b])).tolist()
            assert sum(one >> s & 7 != two >> s & 7 for s in range(0, 48, 3)) <= 2 * edits


def expected_rows(docs, edits, min_chars):
    lines = [(d, k, x.strip(" ")) for d, t in docs if t is not None for k, x in enumerate(t.split("\n")) if len(x.strip(" ")) >= min_chars]
    lines = sorted(set(lines))
    texts = sorted({x for _, _, x in lines})
    links = {x: {y for y in texts if y != x and distance(x, y) <= edits} for x in texts}
    root = {}
    for x in texts:
        stack = [x]
        while stack:
            y = stack.pop()
            if y not in root:
                root[y] = x
                stack += links[y]
    first = {}
    for d, k, x in lines:
        first.setdefault(root[x], (d, k))
    return sorted((d, k, first[root[x]] == (d, k), len(links[x]), *first[root[x]]) for d, k, x in lines)


def test_classes_equal_brute_force(spark):
    lines = some_lines(4)
    rng = random.Random(9)
    rng.shuffle(lines)
    docs = [(k, "\n".join([*lines[k * 5 : k * 5 + 5], "short", ""])) for k in range(len(lines) // 5)] + [(900, None), (901, ""), (902, lines[3]), (902, lines[3])]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in docs], "doc_id long, text string, line_no int, line string").repartition(4)
    got = sorted((r.doc_id, r.line_no, r.kept, r.n_links, r.class_doc_id, r.class_line_no) for r in line_dedup.line_classes(df).distinct().collect())
    assert got == expected_rows(docs, 2, 20)
    cleaned = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    gone = {(d, k) for d, k, kept, *_ in got if not kept}
    for d, t in docs:
        assert cleaned[d] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone))
    assert line_dedup.drop_lines(df).columns == df.columns


def test_no_rows_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert line_dedup.line_classes(spark.createDataFrame([], schema)).count() == 0
    line = "a line of more than twenty characters"
    df = spark.createDataFrame([(None, line), (3, line + "!"), (None, "x" * 70_000)], schema)
    assert sorted((r.doc_id or -1, r.kept) for r in line_dedup.line_classes(df).collect()) == [(-1, False), (-1, True), (3, True)]
    assert np.array_equal(sorted(len(r.text) for r in line_dedup.drop_lines(df).collect()), [0, len(line) + 1, 70_000])


def classes_of(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return [find(x) for x in range(n)]


def test_a_common_segment_makes_no_square(spark):
    counts = {}
    for n in (500, 2000):
        rng = random.Random(5)
        lines = ["a common beginning that all these lines have, " + "".join(rng.choice("abcdefgh ijklmnop") for _ in range(30)) for _ in range(n)]
        lines += [edited(rng, x, 1 + k % 2) for k, x in enumerate(lines[:40])]
        df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
        counts[n] = line_dedup.candidates(df, 2).count()
        assert counts[n] < 2 * len(lines)
        if n == 500:
            want = {(i, j) for i in range(n, len(lines)) for j in range(n) if abs(len(lines[i]) - len(lines[j])) <= 2 and distance(lines[i], lines[j]) <= 2}
            assert {(max(r.a, r.b), min(r.a, r.b)) for r in line_dedup.linked_lines(df, 2).collect()} == want
    assert counts[2000] < 5 * counts[500]


def test_crowds_keep_the_classes(spark):
    rng = random.Random(3)
    template = "some words and more words " * 4
    lines = sorted({*some_lines(5, 8), *("page %d of 20 pages in all" % k for k in range(90)), *(edited(rng, template, 2) for _ in range(60)), *(edited(rng, template, 4) for _ in range(40))})
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    want = [(i, j) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= 2 and distance(lines[i], lines[j]) <= 2]
    for crowd in (2, 64):
        got = [(r.a, r.b) for r in line_dedup.linked_lines(df, 2, crowd).collect()]
        assert {(max(p), min(p)) for p in got} <= set(want)
        assert classes_of(len(lines), got) == classes_of(len(lines), want)


def test_lines_that_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_hash", lambda: line_dedup.F.length("line").cast("long"))
    docs = [(0, "a line of more than twenty characters\nsome other line of the same len.."), (1, "some other line of the same len..\na line of more than twenty characters")]
    got = sorted((r.doc_id, r.line_no, r.kept) for r in line_dedup.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(0, 0, True), (0, 1, True), (1, 0, False), (1, 1, False)]


def test_clashing_column_names_are_carried(spark):
    line = "a line of more than twenty characters"
    names = ["_id", "_doc", "_gone", "gone", "doc", "_row", "id"]
    df = spark.createDataFrame([(1, line, *names), (2, line + "\nx", *names)], "doc_id int, text string, " + ", ".join(f"{c} string" for c in names))
    rows = line_dedup.drop_lines(df).orderBy("doc_id").collect()
    assert [(r.text, *r[2:]) for r in rows] == [(line, *names), ("x", *names)]
    assert line_dedup.drop_lines(df).dtypes == df.dtypes


def test_short_lines_where_asked_for(spark):
    """Lines under min_chars go as copies of equal ones only; empty ones stay, texts of many lines that go keep their order."""
    long = [f"line number {k} of a long enough text" for k in range(4)]
    docs = [(1, "short one\n\nTwo\n" + long[0]), (2, "Two\n\nshort one\nshort onf\n" + long[0] + "\nend"), (3, "\n".join([*long, "Two", "last"] * 3)), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(df, short_lines=True).collect()}
    alike = {r.doc_id: r.text for r in line_dedup.drop_lines(df).collect()}
    assert got[1] == docs[0][1] and got[2] == "\nshort onf\nend" and got[4] is None and got[3] == "last"
    assert alike[2] == "Two\n\nshort one\nshort onf\nend" and alike[3] == "Two\nlast\nTwo\nlast\nTwo\nlast"
