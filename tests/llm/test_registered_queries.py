"""The registered queries on the smallest tables: contract columns and types, and rows against plain single-machine versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from histoloom.llm import decontamination, line_dedup, queries
from histoloom.session import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text or "") for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]


def rows_of(spark, name, **types):
    df = queries.queries()[name](spark, SMALL)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in types} == types
    return df.collect()


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def encoded(docs, file, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    return {d: [*tokenizer.encode(t, add_special_tokens=False).ids, end] for d, t in docs}


def test_op1(spark, docs):
    rows = rows_of(spark, "op1_packing", doc_id="bigint", start="bigint", length="bigint", ids_crc32="bigint", doc_tokens="bigint", sequence_id="bigint", offset="bigint")
    ids, pieces, places = encoded(docs, "byte_bpe_50k.json", 0), defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length])
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for d, own in ids.items():
        assert [s for s, _ in sorted(pieces[d])] == np.cumsum([0, *(n for _, n in sorted(pieces[d]))])[:-1].tolist() and sum(n for _, n in pieces[d]) == len(own)
    for own in places.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist() and sum(n for _, n in own) <= 1024
    assert sum(map(len, ids.values())) > 0.9 * 1024 * (len(places) - 1)


def test_op2(spark, docs):
    rows = rows_of(spark, "op2_line_dedup", doc_id="bigint", line_no="int", kept="boolean", n_links="bigint", class_doc_id="bigint", class_line_no="int")
    lines = defaultdict(list)
    for d, t in sorted(docs):
        for k, x in enumerate(t.split("\n")):
            if len(x.strip(" ")) >= 20:
                lines[x.strip(" ")].append((d, k))
    texts = sorted(lines, key=lambda x: (len(x), x))
    root, links = {x: x for x in texts}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs, sizes = [], np.array(list(map(len, texts)))
    for k, x in enumerate(texts):
        pairs += [(x, texts[j]) for j in range(k + 1, int(np.searchsorted(sizes, len(x) + 2, "right")))]
    for (x, y), close in zip(pairs, line_dedup.within(*map(list, zip(*pairs)), 2)):
        if close:
            root[find(x)] = find(y)
            links[x] += 1
            links[y] += 1
    firsts = {}
    for x in texts:
        firsts[find(x)] = min(firsts.get(find(x), lines[x][0]), lines[x][0])
    want = sorted((*at, firsts[find(x)] == at, links[x], *firsts[find(x)]) for x in texts for at in lines[x])
    assert sorted((r.doc_id, r.line_no, r.kept, r.n_links, r.class_doc_id, r.class_line_no) for r in rows) == want


def test_op3(spark, docs):
    rows = rows_of(spark, "op3_sharding", doc_id="bigint", size="bigint", text_crc32="bigint", law="string", shard="int", slot="bigint", grown_shard="int")
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == sorted((d, len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", None) for d, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(len(slots[k]) for k in range(24)) <= 1


def test_op4(spark, docs):
    rows = rows_of(spark, "op4_decontamination", doc_id="bigint", item_id="bigint", share="double", cosine="double", first_word="bigint")
    bench = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").select("item_id", "text").collect()]
    words, parts = decontamination.read_items(bench)
    index = {w: k for k, w in enumerate(words)}
    coded = {d: [index.get(w, -1) for w in decontamination.words_of(t)] for d, t in docs}
    held, n = np.zeros(len(words)), 0
    for code in coded.values():
        for a in range(0, len(code), 32):
            held[sorted({c for c in code[a : a + 32] if c >= 0})] += 1
            n += 1
    idf = np.log((n + 1) / (held + 1)) + 0.1
    rare = [decontamination.rare_words(p, idf) for p in parts]
    want = {(d, p.item_id) for d, code in coded.items() for low in range(-32, len(code), 32) for p, r in zip(parts, rare) if decontamination.check(p, r, code[max(0, low) : low + 96], 0.6)}
    assert {(r.doc_id, r.item_id) for r in rows} == want and want


def test_op5(spark):
    df = queries.queries()["op5_chat"](spark, SMALL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SMALL}/conversations.parquet')")
    found = con.execute(queries.oracle_sql()["op5_chat"])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(names).collect()))) == sorted(map(str, found.fetchall()))


def test_op6(spark, docs):
    rows = rows_of(spark, "op6_toxicity", doc_id="bigint", held_out="boolean", score="double", predicted="int")
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs)
    labels = {r.doc_id: r.toxic for r in table(spark, SMALL, "labels").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    learned = [r.predicted == labels[r.doc_id] for r in rows if not r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean(learned) > 0.9


def test_op7(spark, docs):
    rows = rows_of(spark, "op7_token_files", doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")
    start, want = 0, []
    for d, ids in sorted(encoded(docs, "word_bpe_49k.json", 1).items()):
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_op8(spark):
    rows = rows_of(spark, "op8_ann", query_id="bigint", rank="int", vec_id="bigint", score="double")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table(spark, SMALL, "embeddings").collect()}
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r.vec_id)
        assert abs(vectors[r.query_id] @ vectors[r.vec_id] - r.score) < 1e-12
    assert set(found) == {v for v in vectors if v % 20 == 0}
    best = {q: sorted((-float((vectors[q] * x).sum()), v) for v, x in vectors.items() if v != q)[:20] for q in found}
    assert np.mean([len({v for _, v in best[q]} & set(found[q])) / len(best[q]) for q in found]) >= 0.9


def test_op9(spark, docs):
    rows = rows_of(spark, "op9_substring_dedup", doc_id="bigint", span_start="int", span_end="int", words="bigint", kept_doc_id="bigint")
    covered, want, first, seen = defaultdict(set), defaultdict(set), {}, {}
    for r in rows:
        covered[r.doc_id].update(range(r.span_start, r.span_end))
    for d, t in sorted(docs):
        run: list = []
        for m in [*re.finditer(r"[^\n]*\n|[^\n]+$", t), None]:  # whole lines that stood before, in a row
            words = m[0].lower().split() if m else []
            if m and len(words) < 4:
                continue
            if m and seen.setdefault(" ".join(words), (d, m.start())) != (d, m.start()):
                run.append((m.start(), m.end(), len(words)))
                continue
            if sum(n for *_, n in run) >= 25:
                want[d].update(range(run[0][0], run[-1][1]))
            run = []
        spans = [m.span() for m in re.finditer(r"\S+", t)]
        words = t.lower().split()
        for k in range(len(words) - 49):
            kept = first.setdefault(" ".join(words[k : k + 50]), (d, k))
            if kept[0] != d or kept[1] + 50 <= k:
                want[d].update(range(spans[k][0], spans[k + 49][1]))
    assert dict(covered) == dict(want) and want


def test_op10(spark, docs):
    rows = rows_of(spark, "op10_simhash", doc_id="bigint", fingerprint="string", component_id="bigint")
    prints = {}
    for d, t in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    got = {r.doc_id: r for r in rows}
    assert {d: got[d].fingerprint for d in prints} == {d: f"{p:016x}" for d, p in prints.items()}
    component = {}
    for d in sorted(prints):
        stack = [d]
        while stack:
            x = stack.pop()
            if component.setdefault(x, d) == d and x not in component.get("done", ()):
                component.setdefault("done", set()).add(x)
                stack += [y for y in prints if y not in component["done"] and (prints[x] ^ prints[y]).bit_count() <= 4]
    assert {d: got[d].component_id for d in prints} == {d: component[d] for d in prints}


def test_pipeline(spark, docs):
    rows = rows_of(spark, "pipeline", doc_id="bigint", start="bigint", length="bigint", doc_tokens="bigint", sequence_id="bigint", offset="bigint")
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id] += r.length
    assert whole == {r.doc_id: r.doc_tokens for r in rows} and set(whole) < {d for d, _ in docs}


def test_op11(spark, docs):
    rows = rows_of(spark, "op11_superminhash", doc_id="bigint", n_shingles="bigint", component_id="bigint", kept="boolean")
    sets = {}
    for d, t in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        k = min(2, len(words))
        sets[d] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    component: dict = {}
    for d in sorted(sets):
        stack = [d] if d not in component else []
        while stack:
            x = stack.pop()
            component[x] = d
            near = [y for y in sets if y not in component and sets[x] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
            stack += near
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows} == {(d, len(s), component[d], component[d] == d) for d, s in sets.items()} and len(rows) == len(docs)


def test_op12(spark, docs):
    rows = rows_of(spark, "op12_periodic_runs", doc_id="bigint", n_runs="bigint", start="bigint", length="bigint", period="bigint", exponent_milli="bigint", runs_sha256="string", collapsed_sha256="string")
    got, made = {r.doc_id: r for r in rows}, 0
    for d, t in docs:
        words, h = re.findall(r"[^\x20\x09-\x0D]+", t), zlib.crc32(str(d).encode())
        if h % 10 == 0 and words:
            g, n, made = h // 10, len(words), made + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = []
        for q in range(1, len(words) // 4 + 1):
            same = np.array([x == y for x, y in zip(words, words[q:])] + [False])
            starts = np.nonzero(same & ~np.concatenate([[False], same[:-1]]))[0]
            for s in starts.tolist():
                length = int(np.argmin(same[s:])) + q
                if length >= max(6, 4 * q) and not any(p < q and b <= s and s + length <= b + n for b, n, p in runs):
                    runs.append((s, length, q))
        runs.sort(key=lambda r: (r[0], r[2]))
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        r = got[d]
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(runs), digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(w for k, w in enumerate(words) if k not in gone)))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert made and len(rows) == len(docs)


def test_op13(spark):
    rows = rows_of(spark, "op13_source_audit", lang="string", source="string", part="string", item="string", value="bigint", rank="int")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    want = con.execute(queries.oracle_sql()["op13_source_audit"]).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want) and want
