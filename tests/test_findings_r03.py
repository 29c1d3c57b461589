"""Cases of the findings of round 3."""

import glob
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from histoloom.llm import line_dedup, simhash, superminhash
from histoloom.operators import graphs, metrics, partials, reduce, spatial
from histoloom.sources import readers, writers
from histoloom.streaming import incremental


def test_sinks_of_many_small_slides_have_few_folders(spark, tmp_path):
    """Slides lie in buckets: files do not grow with slides, and lost or broken buckets are mended, whole, without a slide lost beside."""
    source, sink, checkpoint, schema = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", "cell_id bigint, slide bigint, x double"
    rows = spark.range(900).select(F.col("id").alias("cell_id"), (F.col("id") % 300).alias("slide"), F.rand(1).alias("x"))
    rows.where("cell_id < 600").repartition(2).write.parquet(source)
    incremental.ingest(spark, source, sink, checkpoint, schema, buckets=4)
    assert len(glob.glob(f"{sink}/*=*/*=*/*.parquet")) == 8
    for file in glob.glob(f"{sink}/{incremental.BUCKET}=1/*/*.parquet"):
        with open(file, "r+b") as f:
            f.truncate(20)
        os.remove(f"{os.path.dirname(file)}/.{os.path.basename(file)}.crc")
    for file in glob.glob(f"{sink}/{incremental.BUCKET}=2/*/*.parquet")[:1]:
        os.remove(file)
    hurt = {r.slide for r in incremental.damaged_files(spark, sink, schema, buckets=4).select("slide").distinct().collect()}
    assert 0 < len(hurt) < 300
    rows.where("cell_id >= 600").write.mode("append").parquet(source)
    status = incremental.ingest(spark, source, sink, checkpoint, schema, files_at_once=1, check_all=True, buckets=4)
    assert {(r.rows, r.status) for r in status.collect()} == {(3, "completed")}
    held = spark.read.parquet(sink)
    assert sorted(r.cell_id for r in held.collect()) == list(range(900)) and held.groupBy(incremental.BUCKET, "slide").count().count() == 300
    for file in glob.glob(f"{sink}/{incremental.BUCKET}=3/*/*.parquet"):
        os.remove(file)
    assert incremental.slides_to_redo(spark, source, sink, schema, buckets=4).count() > 0
    assert incremental.redo_slides(spark, source, sink, schema, buckets=4) == 0
    assert sorted(r.cell_id for r in spark.read.parquet(sink).collect()) == list(range(900))


def test_pairs_of_blocks_are_dealt_over_tasks(spark, monkeypatch):
    """Few bytes and many results: adaptive execution would put all blocks into one task."""
    monkeypatch.setattr(metrics, "BLOCK_SAMPLES", 8)
    pairs = metrics.all_pairs(spark.range(64).withColumnRenamed("id", "sample_id"))
    assert pairs.count() == 64 * 63 // 2 and pairs.distinct().count() == 64 * 63 // 2
    assert pairs.select(F.spark_partition_id()).distinct().count() > 8


def test_wide_matrices_are_put_together_from_blocks(spark, tmp_path, monkeypatch):
    """Fields stand in the order of their columns, absent ones are null, and the gene of a line is read once, not for each field."""
    monkeypatch.setattr(writers, "BLOCK_COLUMNS", 4)
    values = spark.createDataFrame([("g,1" if k % 2 else "g2", k * 3, k / 4) for k in range(30)], "gene string, sample long, value double")
    writers.write_expression_wide(values.withColumn("gene", F.regexp_replace("gene", ",", "-")), f"{tmp_path}/m", "gene", "sample", "value", "c")
    read = readers.read_expression_wide(spark, f"{tmp_path}/m", cut_ids=False)
    want = {(g, f"c{k * 3}", k / 4 if (g == "g-1") == (k % 2 == 1) else None) for g in ("g-1", "g2") for k in range(30)}
    got = [tuple(r) for r in read.collect()]
    assert len(got) == 60 and set(got) == want
    above = read._jdf.queryExecution().optimizedPlan().toString().split("Generate posexplode(fields")[0]
    assert "regexp_extract" not in above


def test_clusters_settle_whatever_the_rounds(spark, monkeypatch):
    """With rounds None no cell is nearer to another cluster's mean, in groups fitted in a task and in those beyond the sample."""
    x = np.random.default_rng(3).normal(size=(1500, 8))
    df = spark.createDataFrame([(k, 0, v.tolist()) for k, v in enumerate(x)], "cell_id long, slide long, features array<double>")
    for size in (reduce.SAMPLE_BYTES, 1400 * 64):
        monkeypatch.setattr(reduce, "SAMPLE_BYTES", size)
        label = np.array([r.label for r in reduce.kmeans(df, 4, rounds=None, starts=2).orderBy("cell_id").collect()])
        means = np.stack([x[label == k].mean(0) for k in range(4)])
        assert (((x[:, None] - means) ** 2).sum(2).argmin(1) == label).all()


def test_neighbours_in_small_groups_make_no_rows_of_pairs(spark):
    """Queries meet their group as one array: no window over pairs, and the nearest are those of brute force, ties to the lower id."""
    rng = np.random.default_rng(1)
    rows = [(f"g{k % 3}", k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 6, (90, 2)))] + [("one", 99, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "slide string, cell_id long, x double, y double")
    for exclude in (True, False):
        near = spatial.k_nearest(df, df, 4, exclude_self=exclude)
        assert "Window [row_number" not in near._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        want = set()
        for g, a, x, y in rows:
            d = sorted(((x - u) ** 2 + (y - v) ** 2, b) for h, b, u, v in rows if h == g and (b != a or not exclude))[:4]
            want |= {(g, a, b, d2, n + 1) for n, (d2, b) in enumerate(d)}
        assert {(r.slide, r.src, r.dst, r.d2, r.rank) for r in near.collect()} == want


def test_stores_of_many_small_slides_have_few_files(spark, tmp_path):
    """Slides share the files of their bucket; only those at hand are replaced, null ones too; the first ones are told by name."""
    folder = f"{tmp_path}/store"
    rows = spark.range(600).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 200 > 0, F.col("id") % 200).alias("slide"), F.lit(1).alias("x"))
    writers.write_cell_features(rows, folder, buckets=4)
    writers.write_cell_features(rows.where("slide in (7, 8) or slide is null").withColumn("x", F.lit(2)), folder, buckets=4)
    assert len(glob.glob(f"{folder}/*/*.parquet")) == 4
    held = readers.read_cell_features(spark, folder)
    assert sorted((r.cell_id, r.slide, r.x) for r in held.where("slide is not null").collect()) == [(k, k % 200, 2 if k % 200 in (7, 8) else 1) for k in range(600) if k % 200]
    assert [r.x for r in held.where("slide is null").collect()] == [2, 2, 2]
    assert {r.slide for r in readers.read_cell_features(spark, folder, limit=3).where("slide is not null").collect()} <= {1, 10, 100}


def test_crowded_segments_lose_no_link(spark):
    """All pairs within the distance, also where every line of a crowd is near its first one, and with lines of several texts edited."""
    rng = random.Random(5)
    base = "the same words stand in all of these lines but for a few"
    lines = {f"page {a}{b} of the book that has no end" for a in "0123456789" for b in "abcdefghij"} | {base}
    while len(lines) < 200:
        at = sorted(rng.sample(range(len(base)), rng.randint(1, 3)))
        lines.add("".join(rng.choice(["", "x", "yz", c.upper()]) if k in at else c for k, c in enumerate(base)))
    lines = sorted(lines)
    one, two = zip(*itertools.combinations(lines, 2))
    near = line_dedup.within(list(one), list(two), 2)
    want = {p for p, close in zip(itertools.combinations(range(len(lines)), 2), near) if close}
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    got = [(r.a, r.b) for r in line_dedup.linked_lines(df, 2, 32).collect()]
    assert len(got) == len(want) and set(got) == want


def test_divergences_of_blocks_are_those_of_their_rows(spark, monkeypatch):
    """Absent genes, zeros and equal samples; pairs without a gene in common are none; the summary is that of the pairs."""
    rng = np.random.default_rng(2)
    ones, twos = rng.random((70, 9)), rng.random((50, 9))
    ones[rng.random(ones.shape) < 0.4], twos[rng.random(twos.shape) < 0.4] = np.nan, np.nan
    twos[3], ones[5], twos[7, ~np.isnan(twos[7])] = ones[3], np.nan, 0.0
    got = metrics._js_matrix(ones, twos)
    shared = (~np.isnan(ones)).astype(int) @ (~np.isnan(twos)).T.astype(int) > 0
    assert (np.isnan(got) == ~shared).all() and got[3, 3] == 0
    assert all(np.allclose(got[k][shared[k]], metrics._js_rows(ones[k], twos)[shared[k]], rtol=0, atol=1e-13) for k in range(70))
    monkeypatch.setattr(metrics, "BLOCK_SAMPLES", 4)
    rows = [(k, f"g{g}", float((k % 7 + 1) * g % 5)) for k in range(14) for g in range(6) if (k + g) % 4] + [(14, "x", 1.0)]
    df = spark.createDataFrame(rows, "sample_id long, gene string, value double")
    pairs = metrics.pairwise_js(df).collect()
    assert len(pairs) == 14 * 13 // 2
    near = {(r.one, r["rank"]): (r.js, r.two) for r in metrics.pairwise_js(df, top=3).collect()}
    both = [(r.one, r.js, r.two) for r in pairs] + [(r.two, r.js, r.one) for r in pairs]
    want = {(k, n + 1): js for k in range(14) for n, js in enumerate(sorted(js for one, js, _ in both if one == k)[:3])}
    assert set(near) == set(want) and all(abs(near[k][0] - want[k]) < 1e-12 for k in want)
    row, js = metrics.js_summary(df).first(), [r.js for r in pairs]
    assert row.pairs == len(js) and np.allclose([row.mean_js, row.min_js, row.max_js], [np.mean(js), min(js), max(js)], rtol=0, atol=1e-12)


def test_stores_of_many_small_states_have_few_files(spark, tmp_path):
    """States of parts share the files of their bucket; a part taken up again replaces its own states only."""
    rows = spark.range(1200).select((F.col("id") % 300).alias("slide"), F.lit("g").alias("gene"), F.col("id").cast("double").alias("value"))
    for some in (rows, rows.where("slide < 10").withColumn("value", F.lit(1.0))):
        partials.store_stats(partials.partial_stats(some, "slide", "gene"), f"{tmp_path}/s", "slide", buckets=4)
    assert len(glob.glob(f"{tmp_path}/s/*/*.parquet")) == 4
    held = {r.slide: (r.n, r.mean) for r in partials.stored_stats(spark, f"{tmp_path}/s").collect()}
    assert held == {k: (4, 1.0 if k < 10 else k + 450.0) for k in range(300)}
    assert partials.stored_stats(spark, f"{tmp_path}/s", rows.where("slide in (3, 20)")).count() == 2


def test_tiles_are_listed_by_tasks(spark, tmp_path):
    """Tiles in the folder and below it, at any depth, without Spark's own listing; hidden and empty files and other images are none."""
    names = {"a/s1_patch_tile_1_level0_0-0-9-9.png", "a/b/s2_patch_tile_2_level0_0-0-9-9.png", "s3_patch_tile_3_level0_0-0-9-9.png"}
    for name in (*names, "a/overview.png", "_x/s4_patch_tile_4_level0_0-0-9-9.png", "a/.y/s5_patch_tile_5_level0_0-0-9-9.png", "a/s6_patch_tile_6_level0_0-0-9-9.txt"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(b"x")
    (tmp_path / "t/s7_patch_tile_7_level0_0-0-9-9.png").touch()
    tiles = readers.list_tiles(spark, f"{tmp_path}/t")
    assert "binaryFile" not in tiles._jdf.queryExecution().toString()
    assert {(r.path.split("/t/")[1], r.length, r.slide, r.tile_id) for r in tiles.collect()} == {(n, 1, n.split("/")[-1][:2], int(n.split("/")[-1][1])) for n in names}
    assert readers.list_tiles(spark, f"{tmp_path}/nowhere").count() == 0


def test_nuclei_of_many_slides_in_a_file(spark, tmp_path):
    """A slide in each line; several slides share a file, and none is lost."""
    lines = [f'{{"nuc": {{"{k}": {{"centroid": [1.5, {k}.0], "contour": [[1, 2], [3, 4]]}}}}}}' for k in range(30)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/n")
    got = readers.read_nuclei(spark, f"{tmp_path}/n", lines=True)
    assert sorted((r.cell_id, r.x, r.y, len(r.contour)) for r in got.collect()) == [(k, 1.5, float(k), 2) for k in range(30)]
    assert got.select("path").distinct().count() == 1


def test_names_without_bounds_are_searched_for_none(spark):
    """The mark is looked for before the groups are; names are cut without a pattern."""
    from histoloom.functions import ids

    paths = ["a/b_patch_tile_1_level0_2-3-4-5.png", "a/b_level0_2-3-4-5", "", "x/", None, "plain"]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, path string").select("k", ids.base_name(F.col("path")).alias("name"), ids.tile_bounds(F.col("path")).alias("t"), ids.level0_bounds(F.col("path")).alias("l"))
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = df.orderBy("k").collect()
    assert [r.name for r in rows] == ["b_patch_tile_1_level0_2-3-4-5.png", "b_level0_2-3-4-5", "", "", None, "plain"]
    assert tuple(rows[0].t) == (1, 2, 3, 4, 5) and tuple(rows[1].l) == (2, 3, 4, 5) and all(tuple(r.t) == (None,) * 5 for r in rows[1:])


@pytest.mark.parametrize("paired", [64, 2])  # 2: texts that share a passage are a crowd
def test_long_texts_at_the_threshold_are_all_linked(spark, monkeypatch, paired):
    """Texts of 40 shingles and more, a passage in common or not: pairs of similarity 0.8 are found, also where fingerprints are far apart by chance, and none under it."""
    monkeypatch.setattr(simhash, "PAIRED_SETS", paired)
    far_apart = [586, 684, 824, 3964, 5154, 6462, 6618, 8562, 9170, 11587, 11653]  # of the first 12,000 seeds, by fingerprints of 256 bits
    texts, linked = [], set()
    for seed in [*far_apart, *range(90)]:
        rng = np.random.default_rng(seed)
        n = int(rng.integers(49, 60))
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
        if seed < 90 and seed % 3 == 0:
            words[8:38] = [f"p{k}" for k in range(30)]
        short = seed < 90 and seed % 2
        changed = int(n - 4 - np.ceil((n - 4) * 1.6 / 1.8)) + short
        if not short:
            linked.add((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join([*words[: n - changed], *(f"v{seed}x{x}" if seed < 90 else f"v{x}" for x in range(changed))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    of = {r.doc_id: r["class"] for r in simhash.similar_texts(df).collect()}
    assert {(k, k + 1) for k in range(0, len(texts), 2) if of[k] == of[k + 1]} == linked
    assert len(set(of.values())) == len(texts) - len(linked)


def test_sketches_keep_no_similar_sets_apart():
    """Counts of parts differ by no more than the sets do, also where a part holds more than a byte counts."""
    rng = np.random.default_rng(9)
    for n in (1, 50, 1000, 60_000):
        one = rng.integers(-(1 << 63), (1 << 63) - 1, n)
        two = np.concatenate([one[: n - n // 5], rng.integers(-(1 << 63), (1 << 63) - 1, n // 9)])
        assert superminhash.least_apart(superminhash.sketch(one), superminhash.sketch(two)) <= len(np.setxor1d(one, two))
    many = np.arange(0, 60_000, dtype=np.int64)  # of one part: more than a byte counts, in parts of two sizes
    assert superminhash.least_apart(superminhash.sketch(many), superminhash.sketch(many[:7000])) == 0
    far = rng.integers(-(1 << 63), (1 << 63) - 1, 4000)
    assert superminhash.least_apart(superminhash.sketch(far), superminhash.sketch(rng.integers(-(1 << 63), (1 << 63) - 1, 4000))) > 0.25 * 8000


def test_texts_that_share_a_passage_meet_in_no_row_of_a_pair(spark, monkeypatch):
    """Forty texts around each passage: what is compared has a row of a text and bucket, not one of a pair, and the links stay those of all pairs."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    docs = []
    for k in range(8):
        passage = [word() for _ in range(34)]
        docs += [(100 * k + j, " ".join([word() for _ in range(3)] + passage + [word() for _ in range(3)])) for j in range(40)]
    docs += [(1000 + k, docs[40 * k][1] + " more") for k in range(8)]
    rows, told = [], simhash.likely
    monkeypatch.setattr(simhash, "likely", lambda first, *rest: rows.append(first.count()) or told(first, *rest))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r["class"] for r in simhash.similar_texts(frame).collect()}
    assert 0 < rows[0] <= 8 * 41 * 6  # pairs: 8 * 40 * 39 / 2 at least
    sets = {d: set(simhash.shingles(t).tolist()) for d, t in docs}
    linked = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert linked == {(100 * k, 1000 + k) for k in range(8)}
    assert {(a, b) for a, b in itertools.combinations(sorted(got), 2) if got[a] == got[b]} == linked


def test_likely_sets_are_those_of_all_pairs_whatever_the_batches(spark):
    """Groups that go on in the next batch lose no pair; a set alone in its group is none."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        core = rng.integers(-(1 << 63), (1 << 63) - 1, 90 * (1 + k % 9))
        for j in range(1 + k % 13):
            own = rng.integers(-(1 << 63), (1 << 63) - 1, int(len(core) * rng.choice([0.02, 0.2, 0.6])))
            found = np.unique(np.concatenate([core, own]))
            rows.append((k % 7, k, 100 * k + j, len(found), bytearray(superminhash.sketch(found))))
    near = lambda a, b: 5 * min(a[3], b[3]) >= 4 * max(a[3], b[3]) and 9 * superminhash.least_apart(a[4], b[4]) <= a[3] + b[3]
    expected = {s for a, b in itertools.combinations(rows, 2) if a[:2] == b[:2] and near(a, b) for s in (a[2], b[2])}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for at_once in (3, 50, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", at_once)
            got = superminhash.likely(spark.createDataFrame(rows, "x long, y long, sid long, n long, sketch binary").repartition(5), 80.0)
            assert {r.sid for r in got.collect()} == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert 50 < len(expected) < len(rows)
    assert superminhash.likely(spark.createDataFrame([], "x long, y long, sid long, n long, sketch binary"), 80.0).count() == 0


@pytest.mark.parametrize("at_once", [1 << 16, 40])  # 40: blocks and pairs go on in further rounds
def test_pooling_over_a_radius_is_that_over_its_edges(spark, at_once, monkeypatch):
    """Dense and sparse places, heaps, negative, null, NaN and infinite coordinates, cells without features: as by edges, without a join."""
    monkeypatch.setattr(spatial, "POINTS_AT_ONCE", at_once)
    monkeypatch.setattr(spatial, "PAIRS_AT_ONCE", 32 * at_once)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        x, y = (float(v) for v in (rng.normal(0, 4, 2) if k % 2 else rng.uniform(-60, 60, 2)).round(2))
        x, y = (3.0, -3.0) if k % 40 == 0 else (float("nan"), y) if k == 7 else (None, y) if k == 9 else (x, float("inf")) if k == 11 else (x, y)
        rows.append((f"s{k % 3}", k, x, y, None if k % 11 == 0 else [float(v) for v in rng.normal(size=3)]))
    points = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0, [1.0] * 3)], "slide string, cell_id long, x double, y double, features array<double>").repartition(3)
    pooled = spatial.radius_pool(points, 2.5)
    assert "Join" not in pooled._jdf.queryExecution().executedPlan().toString()
    got = {(r.slide, r.cell_id): r.features for r in pooled.collect()}
    expected = {(r.slide, r.cell_id): r.features for r in graphs.neighbour_mean(points, spatial.radius_graph(points.where("abs(x) < 1000 and abs(y) < 1000"), 2.5), "slide", "cell_id").collect()}
    assert got.keys() == expected.keys() and len(got) > 350
    assert all(np.allclose(got[k], expected[k], rtol=1e-12) for k in got)
