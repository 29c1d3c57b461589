"""Edge rules on small rows, properties, and brute force for what SQL does not cover."""

import glob
import math
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from histoloom.functions import geometry, ids, vectors
from histoloom.operators import expression, graphs, metrics, ordering, partials, quality, reduce, spatial
from histoloom.sources import readers, writers
from histoloom.streaming import incremental


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{n} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'bigint'}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], kinds).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("name", "slide"), [("a.b_tile36_features.parquet", "a.b"), ("x/c_features.parquet", "c"), ("s_patch_tile_5_level0_1-2-3-4.png", "s"), ("plain", "plain"), ("", "")])
def test_slide_id(spark, name, slide):
    assert one(spark, ids.slide_id(F.col("p")), p=name) == slide


def test_case_id(spark):
    assert one(spark, ids.case_id(F.col("s")), s="TCGA-AA-3872-01A-01-TS1.uuid") == "TCGA-AA-3872"
    assert one(spark, ids.case_id(F.col("s")), s="a-bcdefghijklmnop") == "a-bcdefghijk"


def test_tile_bounds(spark):
    found = one(spark, ids.tile_bounds(F.col("p")), p="s_patch_tile_542_level0_5540-10952-5796-11208.png")
    assert tuple(found) == (542, 5540, 10952, 5796, 11208)
    assert tuple(one(spark, ids.tile_bounds(F.col("p")), p="nothing.png")) == (None,) * 5


def test_human_number(spark):
    assert [one(spark, ids.human_number(F.col("n")), n=n) for n in (0, 999, 1000, 1234567, 2_500_000_000)] == ["0", "999", "1.00K", "1.23M", "2.50B"]


def test_spot_radius(spark):
    assert one(spark, geometry.spot_radius_um(F.col("d"), F.lit(0.5)), d=100.0) == 37.5
    assert one(spark, geometry.spot_radius_um(F.col("d"), F.lit(0.5)), d=float("nan")) == 25.0


def test_grid_key_and_floor(spark):
    assert [one(spark, geometry.grid_key(F.col("v"), F.lit(10.0)), v=v) for v in (10.0, 2009.9, 2010.0, 9.0)] == [0, 0, 1, -1]


def points(spark, rows):
    return spark.createDataFrame(rows, "slide string, cell_id long, x double, y double")


def test_half_open_tiles(spark):
    cells = points(spark, [("a", 1, 10.0, 5.0), ("a", 2, 0.0, 0.0), ("a", 3, 9.99, 9.99)])
    tiles = spark.createDataFrame([("a", 7, 0.0, 0.0, 10.0, 10.0), ("a", 8, 5.0, 5.0, 25.0, 15.0)], "slide string, tile_id int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.cell_id, r.tile_id) for r in spatial.assign_to_tiles(cells, tiles, 10.0, 10.0).collect()}
    assert got == {(1, 8), (2, 7), (3, 7), (3, 8)}


def test_radius_graph_rules(spark):
    rows = points(spark, [("a", 0, 0.0, 0.0), ("a", 1, 3.0, 0.0), ("a", 2, 3.0, 0.0), ("a", 3, 100.0, 0.0)])
    got = {(r.src, r.dst) for r in spatial.radius_graph(rows, 5.0).collect()}
    assert got == {(0, 1), (1, 0), (0, 2), (2, 0)}


def test_knn_edge_count(spark):
    rows = points(spark, [("a", k, float(k * k), 0.0) for k in range(4)])
    assert spatial.knn_graph(rows, 8).count() == 24
    assert spatial.knn_graph(rows, 8, dedupe=True).count() == 12


def test_knn_in_large_groups_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spatial, "WHOLE_GROUP", 50)
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(500, 40, (60, 2)), np.zeros((5, 2)), [[9000.0, -9000.0]]])
    rows = [("a", k, float(x), float(y)) for k, (x, y) in enumerate(xy)] + [("b", k, float(k), 0.0) for k in range(10)] + [("c", k, 1.0, 1.0) for k in range(60)]
    got = {}
    for r in spatial.k_nearest(points(spark, rows), points(spark, rows), 5).collect():
        got.setdefault((r.slide, r.src), []).append((r.rank, r.dst))
    for slide in "abc":
        own = [r for r in rows if r[0] == slide]
        for _, k, x, y in own:
            best = sorted(((x - a) ** 2 + (y - b) ** 2, j) for _, j, a, b in own if j != k)[:5]
            assert [d for _, d in sorted(got[slide, k])] == [j for _, j in best]


def test_nearest_points_with_odd_coordinates(spark, monkeypatch):
    """Null and NaN coordinates take no part, far queries and heaps of points at one place end and are right."""
    monkeypatch.setattr(spatial, "WHOLE_GROUP", 8)
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 50, (120, 2)).round(1)
    xy[40:80] = xy[40]
    xy[119] = 1e6  # stretches the extent
    rows = [("a", k, float(x), float(y)) for k, (x, y) in enumerate(xy)]
    odd = [("a", 900, None, 1.0), ("a", 901, float("nan"), 1.0), ("a", 902, 1.0, float("inf")), ("b", 903, None, None)]
    queries = [("a", 1000, -3e4, 20.0), ("a", 1001, 25.0, 25.0), ("a", 1002, float("nan"), 0.0), ("c", 1003, 0.0, 0.0), *rows[35:45]]
    got = {}
    for r in spatial.k_nearest(points(spark, queries), points(spark, rows + odd), 3).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    want = {}
    for _, src, x, y in queries:
        if src not in (1002, 1003):
            near = sorted(((px - x) ** 2 + (py - y) ** 2, k) for k, (px, py) in enumerate(xy) if k != src)
            want[src] = [k for _, k in near[:3]]
    assert got == want


def test_dense_tiles_and_far_queries_take_few_rounds(spark, monkeypatch):
    """Half of all points in a thousandth of the side, and queries far outside: leaves stay small, rounds follow the depth of the tree."""
    rng = np.random.default_rng(8)
    xy = np.concatenate([rng.uniform(0, 1000, (700, 2)), 500 + rng.uniform(0, 1, (700, 2))])
    rows = [("a", k, float(x), float(y)) for k, (x, y) in enumerate(xy)]
    far = [("a", 5000 + k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-1e5, 1e5, (40, 2)))]
    leaves = spatial._leaves(points(spark, rows), "slide").groupBy("bits", "ix", "iy").count().collect()
    assert max(r["count"] for r in leaves) <= spatial.LEAF_POINTS and sum(r["count"] for r in leaves) == len(rows)
    labels, kept = [], spatial.stage
    monkeypatch.setattr(spatial, "stage", lambda df, label: (labels.append(label), kept(df, label))[1])
    got = {}
    for r in spatial.k_nearest(points(spark, far + rows[:30] + rows[-30:]), points(spark, rows), 4).collect():
        got.setdefault(r.src, {})[r.rank] = r.dst
    assert labels.count("node-pairs") <= 2 + max(r.bits for r in leaves) // 2
    for _, src, x, y in far + rows[:30] + rows[-30:]:
        best = sorted(((px - x) ** 2 + (py - y) ** 2, j) for _, j, px, py in rows if j != src)[:4]
        assert [got[src][k] for k in range(1, 5)] == [j for _, j in best]


def test_heaps_of_queries_at_one_place_end_at_once(spark, monkeypatch):
    """A third of all queries at one place beside a neighbour: no rounds are spent on telling them apart, each gets its own row."""
    rng = np.random.default_rng(4)
    rows = [("a", k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 1000, (200, 2)))]
    heap = [("a", 1000 + k, 500.0, 500.0) for k in range(100)] + [("a", 2000, 500.25, 500.0)]
    labels, kept = [], spatial.stage
    monkeypatch.setattr(spatial, "stage", lambda df, label: (labels.append(label), kept(df, label))[1])
    got = {}
    for r in spatial.k_nearest(points(spark, heap), points(spark, rows), 2, exclude_self=False).collect():
        got.setdefault(r.src, {})[r.rank] = r.dst
    assert labels.count("overfull") < 14
    best = lambda x, y: [j for _, j in sorted(((px - x) ** 2 + (py - y) ** 2, j) for _, j, px, py in rows)[:2]]
    assert got == {k: dict(enumerate(best(x, y), 1)) for _, k, x, y in heap}


def test_files_of_a_store_are_told_by_listings_and_footers(spark, tmp_path):
    """Every problem, several files a slide, several problems at once, and slides without expectations."""
    rows = spark.range(12).select(F.col("id").alias("cell_id"), F.array(F.lit(1.0)).alias("features"))
    for slide, parts in (("sound", 1), ("two", 2), ("short", 1), ("both", 1)):
        rows.repartition(parts).write.parquet(f"{tmp_path}/{slide}")
    rows.drop("features").write.parquet(f"{tmp_path}/lacking")
    rows.limit(0).write.parquet(f"{tmp_path}/rowless")
    os.makedirs(tmp_path / "zero")
    (tmp_path / "zero" / "a.parquet").write_bytes(b"")
    (tmp_path / "both" / "b.parquet").write_bytes(b"PAR1 cut off in the middle")
    (tmp_path / "both" / "c.tmp.parquet").write_bytes(b"x")
    names = ("sound", "two", "short", "both", "lacking", "rowless", "zero", "nowhere")
    folders = spark.createDataFrame([(n, f"file://{tmp_path}/{n}") for n in names], "slide string, path string")
    files = readers.list_folders(folders).where("path like '%.parquet'")
    expected = spark.createDataFrame([(n, None if n == "two" else 13 if n == "short" else 12) for n in names], "slide string, expected long")
    got = sorted((r.slide, r.problem) for r in quality.file_violations(files, expected, few=12).collect())
    want = [("both", "temporary"), ("both", "unreadable"), ("lacking", "missing column"), ("nowhere", "missing"), ("rowless", "empty"), ("short", "row count"), ("zero", "empty file")]
    assert got == sorted(want)


def test_overview_tiles_take_a_row_a_level(spark):
    """A tile as wide as the slide stands in a few large buckets; tiles of odd sizes and places hold the same cells as by brute force."""
    rng = np.random.default_rng(9)
    cells = points(spark, [("a", k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-50, 5000, (200, 2)))])
    rows = [("a", k, float(x), float(y), float(x + w), float(y + h)) for k, (x, y, w, h) in enumerate(np.c_[rng.uniform(-60, 4000, (60, 2)), rng.choice([0.0, 3.0, 10.0, 11.0, 160.0, 2000.0], (60, 2))])]
    rows.append(("a", 60, -50.0, -50.0, 5000.0, 5000.0))
    tiles = spark.createDataFrame(rows, "slide string, tile_id int, x1 double, y1 double, x2 double, y2 double")
    got = spatial.assign_to_tiles(cells, tiles, 10.0, 10.0)
    want = {(c.cell_id, t[1]) for c in cells.collect() for t in rows if t[2] <= c.x < t[4] and t[3] <= c.y < t[5]}
    assert sorted((r.cell_id, r.tile_id) for r in got.collect()) == sorted(want)
    assert spatial.assign_to_tiles(cells, tiles.limit(0), 10.0, 10.0).count() == 0


def test_numbers_inside_groups(spark):
    """As a window would number them, without one by group; null groups, repeated orders and a caller's odd names."""
    rows = [(g, k % 7, k, "x") for k in range(400) for g in (("hot",) * 3 + ("b", None, "c"))[k % 6 : k % 6 + 1]]
    df = spark.createDataFrame(rows, "slide string, at int, id int, _row string").repartition(5)
    got = ordering.number_within(df, "slide", "at", "id", name="nth")
    assert got.columns == [*df.columns, "nth"] and "Window" not in got._jdf.queryExecution().optimizedPlan().toString().replace("Window [sum", "")
    of = {}
    for r in sorted(got.collect(), key=lambda r: (r.at, r.id)):
        assert r.nth == of.get(r.slide, 0)
        of[r.slide] = r.nth + 1
    assert ordering.number_within(df.limit(0), "slide", "at", name="nth").collect() == []


def test_running_sums_inside_groups(spark, monkeypatch):
    """As a window would add up, without one by group: blocks of seven rows, null values and groups, repeated orders."""
    monkeypatch.setattr(ordering, "BLOCK_ROWS", 7)
    rows = [((("hot",) * 3 + ("b", None, "c"))[k % 6], k % 50, k, None if k % 11 == 0 else k - 30) for k in range(200)]
    df = spark.createDataFrame(rows, "slide string, at int, id int, n long").repartition(4)
    got, of = ordering.running_sums(df, "slide", ["at", "id"], "n"), {}
    assert got.columns == [*df.columns, "before"]
    for r in sorted(got.collect(), key=lambda r: (r.at, r.id)):
        assert r.before == of.get(r.slide, 0)
        of[r.slide] = r.before + (r.n or 0)
    assert ordering.running_sums(df.limit(0), "slide", ["at"], "n").collect() == []


def test_pairs_in_blocks(spark, monkeypatch):
    """Blocks of three samples: all pairs once, and divergences and nearest others as by pairs; genes that one sample lacks do not count."""
    monkeypatch.setattr(metrics, "BLOCK_SAMPLES", 3)
    rng = np.random.default_rng(6)
    values = {(s, g): float(v) for s in range(10) for g, v in enumerate(rng.integers(-2, 9, 6)) if (s * g) % 5 != 3}
    df = spark.createDataFrame([(s, f"g{g}", v) for (s, g), v in values.items()], "sample_id long, gene string, value double")
    assert sorted(map(tuple, metrics.all_pairs(df).collect())) == [(a, b) for a in range(10) for b in range(a + 1, 10)]
    share = {k: max(v, 0) / (sum(max(x, 0) for (s, _), x in values.items() if s == k[0]) + 1e-12) for k, v in values.items()}

    def js(a, b):
        both = [(share[a, g], share[b, g]) for g in range(6) if (a, g) in share and (b, g) in share]
        term = lambda x, m: x * math.log((x + 1e-12) / (m + 1e-12)) if x > 0 else 0
        return sum(term(p, (p + q) / 2) + term(q, (p + q) / 2) for p, q in both) / 2

    got = metrics.pairwise_js(df).collect()
    assert len(got) == 45 and all(r.one < r.two and abs(r.js - js(r.one, r.two)) < 1e-12 for r in got)
    near = {(r.one, r["rank"]): r.two for r in metrics.pairwise_js(df, top=2).collect()}
    assert near == {(a, k + 1): b for a in range(10) for k, (_, b) in enumerate(sorted((js(min(a, b), max(a, b)), b) for b in range(10) if b != a)[:2])}


def test_leave_one_out_roles_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BROADCAST_FOLDS", 4)
    samples = spark.createDataFrame([(f"s{k:02d}", "mine") for k in range(11)], "sample_id string, _row string")
    roles = ordering.fold_roles(ordering.leave_one_out(samples, "sample_id")).collect()
    assert {(r.fold, r.sample_id, r.role) for r in roles} == {(f, f"s{k:02d}", "test" if f == k else "train") for f in range(11) for k in range(11)} and len(roles) == 121
    assert ordering.k_folds(samples, "sample_id", 3).columns == ["sample_id", "_row", "fold"]


def test_nearest_within_keeps_repeated_rows(spark):
    cells = spark.createDataFrame([("a", 1, 0.0, 0.0, {"k": 1}), ("a", 1, 0.0, 0.0, {"k": 1}), ("a", 2, 3.0, 0.0, None), ("a", 3, None, 0.0, None), (None, 4, 0.0, 0.0, None)], "slide string, cell_id long, x double, y double, more map<string,int>")
    spots = spark.createDataFrame([("a", 5, 0.0, 1.0), ("a", 6, None, 0.0), ("a", 7, 0.0, 1.0)], "slide string, spot_idx long, x double, y double")
    got = spatial.nearest_within(cells, spots, 2.0)
    assert got.columns == [*cells.columns, "spot_idx", "d2"]
    assert sorted((r.cell_id, r.spot_idx, r.d2) for r in got.collect() if r.cell_id == 1) == [(1, 5, 1.0)] * 2
    assert sorted((r.cell_id, r.spot_idx) for r in got.collect() if r.cell_id > 1) == [(2, None), (3, None), (4, None)]


def test_nearest_within_ties_and_nulls(spark):
    cells = points(spark, [("a", 1, 0.0, 0.0), ("a", 2, 50.0, 0.0), ("b", 3, 0.0, 0.0)])
    spots = spark.createDataFrame([("a", 9, 3.0, 0.0), ("a", 4, -3.0, 0.0)], "slide string, spot_idx int, x double, y double")
    got = {r.cell_id: (r.spot_idx, r.d2) for r in spatial.nearest_within(cells, spots, 5.0).collect()}
    assert got == {1: (4, 9.0), 2: (None, None), 3: (None, None)}


@pytest.mark.parametrize("n", [1, 2, 7, 13, 40])
def test_folds(spark, n):
    samples = spark.createDataFrame([(f"s{k:03}",) for k in range(n)], "sample_id string").repartition(3)
    folds = ordering.k_folds(samples, "sample_id").collect()
    sizes = [sum(r.fold == f for r in folds) for f in range(min(10, n))]
    assert sizes == [len(x) for x in np.array_split(np.arange(n), min(10, n))]
    assert [r.fold for r in sorted(folds)] == sorted(r.fold for r in folds)
    roles = ordering.fold_roles(ordering.leave_one_out(samples, "sample_id")).collect()
    assert len(roles) == (2 if n == 1 else n * n)
    split = ordering.split_rows(samples, "sample_id").collect()
    assert sum(r.split == "train" for r in split) == int(0.8 * n)


def test_fixed_folds_without_train_samples_fall_out(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    assert ordering.fixed_folds(samples, spark.createDataFrame([(0, "a"), (0, "b")], "fold int, sample_id string")).count() == 0


def test_zscore_round_trip_and_flat_genes(spark):
    rows = spark.createDataFrame([(s, g, float(s * k)) for s in range(6) for g, k in (("flat", 0), ("up", 3))], "sample_id long, gene string, value double")
    stats = expression.gene_stats(rows)
    assert {r.gene: r.std for r in stats.collect()}["flat"] == 1.0
    scores = expression.zscore(rows, stats).select("sample_id", "gene", F.col("value").alias("pred"), F.col("value").alias("target"))
    assert all(r.pred == 0 for r in scores.where("gene = 'flat'").collect())
    back = {(r.sample_id, r.gene): r.pred for r in expression.inverse_zscore(scores, stats).collect()}
    assert all(math.isclose(back[r.sample_id, r.gene], r.value, abs_tol=1e-9) for r in rows.collect())


def test_replicates(spark):
    rows = spark.createDataFrame([("c", 0, "g", 2.0), ("c", 1, "g", 4.0)], "barcode string, col_pos int, gene string, value double")
    assert expression.replicate_mean(rows, F.col("barcode")).first().value == 3.0
    assert expression.replicate_last(rows, F.col("barcode"), "col_pos").first().value == 4.0


def scores(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, gene string, pred double, target double")


def test_js_bounds(spark):
    found = metrics.js_divergence(scores(spark, [("a", "x", 1.0, 0.0), ("a", "y", 0.0, 1.0), ("b", "x", 2.0, 4.0), ("b", "y", 1.0, 2.0)]))
    got = {r.sample_id: r.js for r in found.collect()}
    assert math.isclose(got["a"], math.log(2), abs_tol=1e-6) and abs(got["b"]) < 1e-9


def test_constant_rows_have_no_correlation(spark):
    flat = scores(spark, [("a", "x", 1.0, 5.0), ("a", "y", 1.0, 6.0)])
    assert metrics.overall(flat).first().pearson is None
    assert metrics.per_group(flat, "sample_id").first().pearson is None


def test_p_value():
    # By the t distribution in closed form for 2 and 4 degrees of freedom.
    assert math.isclose(metrics.pearson_p(0.5, 4), 0.5, rel_tol=1e-9)
    t = 0.8 * math.sqrt(4 / (1 - 0.64))
    theta = math.atan(t / 2)
    assert math.isclose(metrics.pearson_p(-0.8, 6), 1 - math.sin(theta) * (1 + math.cos(theta) ** 2 / 2), rel_tol=1e-9)
    assert metrics.pearson_p(1.0, 10) == 0.0 and math.isclose(metrics.pearson_p(0.0, 9), 1.0, rel_tol=1e-12)


def test_mean_pairwise_pearson_equals_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(7, 12))
    x[3] = 2.0
    df = spark.createDataFrame([(s, g, float(x[s, g])) for s in range(7) for g in range(12)], "sample_id long, gene long, value double")
    c = np.corrcoef(np.delete(x, 3, 0))
    row = metrics.mean_pairwise_pearson(df).first()
    assert row.samples == 6 and math.isclose(row.mean_pearson, c[np.triu_indices(6, 1)].mean(), abs_tol=1e-9)


def test_early_stop(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.9999999), ("a", 3, 0.1)], "run string, epoch int, loss double")
    got = metrics.early_stop(rows, "run", "loss", patience=1, min_delta=1e-6).first()
    assert (got.best_epoch, got.stop_epoch) == (1, 2)
    late = metrics.early_stop(rows, "run", "loss", patience=1, min_delta=1e-6, warmup=3).first()
    assert (late.best_epoch, late.best, late.stop_epoch) == (3, 0.1, None)
    up = metrics.early_stop(rows, "run", "loss", patience=2, maximise=True).first()
    assert (up.best_epoch, up.best, up.stop_epoch) == (1, 1.0, 3)


def cloud(spark, sizes, d=5, seed=2):
    rng = np.random.default_rng(seed)
    data = {g: rng.normal(size=(n, d)) * np.arange(1, d + 1) + 12 for g, n in sizes.items()}
    rows = [(g, g * 1000 + k, x.tolist()) for g, m in data.items() for k, x in enumerate(m)]
    return data, spark.createDataFrame(rows, "slide long, cell_id long, features array<double>").repartition(3)


def test_pca_equals_numpy(spark):
    data, df = cloud(spark, {1: 40, 2: 3})
    model = reduce.fit_pca(df, 3)
    places = {r.cell_id: r.projected for r in reduce.project(df, model).collect()}
    for g, x in data.items():
        centred = x - x.mean(0)
        _, s, axes = np.linalg.svd(centred, full_matrices=False)
        rows = sorted((r.component, r.variance, r.axis) for r in model.where(F.col("slide") == g).collect())
        m = min(3, len(x))
        assert len(rows) == m
        for (_, variance, axis), expected, own in zip(rows[:2], s**2 / len(x), axes):
            assert math.isclose(variance, expected, rel_tol=1e-8)
            assert math.isclose(abs(np.dot(axis, own)), 1, rel_tol=1e-6)
        got = np.array([places[g * 1000 + k] for k in range(len(x))])
        assert np.allclose(got, centred @ np.array([a for _, _, a in rows]).T, atol=1e-8)
    shares = reduce.explained(reduce.fit_pca(df, 5)).where("slide = 1").orderBy("component").collect()
    assert math.isclose(shares[-1].cumulative, 1, rel_tol=1e-9)


def test_kmeans_settles(spark):
    data, df = cloud(spark, {1: 60, 2: 3, 3: 1})
    labels = {r.cell_id: r.label for r in reduce.kmeans(df, 4, rounds=40).collect()}
    assert labels[3000] == 0 and sorted(labels[2000 + k] for k in range(3)) == [0, 1, 2]
    own = np.array([labels[1000 + k] for k in range(60)])
    centres = np.array([data[1][own == j].mean(0) for j in range(4)])
    assert (((data[1][:, None] - centres[None]) ** 2).sum(2).argmin(1) == own).all()


def test_kmeans_loses_no_more_than_by_many_seedings(spark, monkeypatch):
    """Clumps of uneven size: no more loss than the best of ten plain k-means++ runs, whether a group fits a task or goes on over all its cells."""
    rng = np.random.default_rng(12)
    clumps = np.concatenate([rng.normal(c, 0.3, (n, 3)) for c, n in zip(rng.uniform(-9, 9, (7, 3)), (300, 200, 60, 30, 20, 10, 4))])
    df = spark.createDataFrame([(k, "a", x.tolist()) for k, x in enumerate(clumps)], "cell_id long, slide string, features array<double>")

    def loss(labels):
        return sum(((clumps[labels == j] - clumps[labels == j].mean(0)) ** 2).sum() for j in set(labels.tolist()))

    def plain(seed):
        random = np.random.default_rng(seed)
        c = clumps[[random.integers(len(clumps))]]
        while len(c) < 7:
            d = ((clumps[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, clumps[random.choice(len(clumps), p=d / d.sum())]])
        for _ in range(50):
            label = ((clumps[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([clumps[label == j].mean(0) if (label == j).any() else c[j] for j in range(7)])
        return loss(label)

    best = min(map(plain, range(10)))
    for sample in (reduce.SAMPLE_BYTES, 8 * 3 * 200):
        monkeypatch.setattr(reduce, "SAMPLE_BYTES", sample)
        rows = sorted(reduce.kmeans(df, 7).collect(), key=lambda r: r.cell_id)
        assert loss(np.array([r.label for r in rows])) <= best * (1 + 1e-9) if sample > 10**6 else loss(np.array([r.label for r in rows])) <= best * 1.05


def test_cells_by_offsets(spark):
    """Ranges of every length, side by side, with gaps and empty ones; no nested loop."""
    ends = [0, 1, 1, 4, 4, 20, 21, 149, 150]
    offsets = spark.createDataFrame([("a", k, s, e) for k, (s, e) in enumerate(zip(ends, ends[1:]))] + [("a", 8, 160, 170), ("b", 0, 0, 2), ("c", 0, 0, 0)], "slide string, spot long, start long, end long")
    cells = spark.createDataFrame([(g, k, float(k)) for g, n in (("a", 165), ("b", 5)) for k in range(n)], "slide string, row_idx long, x double")
    got = graphs.spot_arrays_by_offsets(cells, offsets, "slide", "spot", "row_idx", "x")
    assert {(r.slide, r.spot): r.x for r in got.collect()} == {(r.slide, r.spot): [float(k) for k in range(r.start, min(r.end, 165 if r.slide == "a" else 5))] for r in offsets.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_polygons(spark):
    vertices = spark.createDataFrame([(1, 2, 4.0, 3.0), (1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0)], "cell_id long, vertex_idx int, x double, y double")
    p = F.col("polygon")
    row = graphs.polygons(vertices).select(geometry.polygon_area(p).alias("a"), geometry.polygon_perimeter(p).alias("l"), geometry.polygon_centroid(p).alias("c")).first()
    assert (row.a, row.l) == (6.0, 12.0) and math.isclose(row.c.x, 8 / 3) and row.c.y == 1.0


def test_nan_to_num(spark):
    df = spark.createDataFrame([([float("nan"), float("inf"), float("-inf"), 2.0],)], "v array<double>")
    assert df.select(vectors.nan_to_num(F.col("v"))).first()[0] == [0.0, 1.0, -1.0, 2.0]


def test_violations(spark):
    cells = spark.createDataFrame([("a", [1.0, 2.0])] * 12 + [("b", [1.0]), ("b", [1.0, float("nan")])], "slide string, features array<double>")
    expected = spark.createDataFrame([("a", 12), ("b", 3), ("c", 1)], "slide string, expected long")
    got = {(r.slide, r.problem) for r in quality.feature_violations(cells, expected).collect()}
    assert got == {("b", "row count"), ("b", "width"), ("b", "not finite"), ("b", "few rows"), ("c", "empty")}


def test_joins_have_no_nested_loops(spark):
    rows = points(spark, [("a", k, float(k), 0.0) for k in range(50)])
    for df in (spatial.radius_graph(rows, 3.0), spatial.nearest_within(rows, rows.withColumnRenamed("cell_id", "spot_idx"), 3.0)):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_failed_and_damaged_slides_are_redone(spark, tmp_path):
    source, sink, schema = f"{tmp_path}/in", f"{tmp_path}/out", "cell_id bigint, slide bigint, x double"
    rows = spark.range(60).select(F.col("id").alias("cell_id"), (F.col("id") % 6).alias("slide"), F.rand(1).alias("x"))
    rows.write.parquet(source)
    assert {r.slide for r in incremental.slides_to_redo(spark, source, sink, schema).collect()} == set(range(6))
    incremental.ingest_slides(spark, source, sink, f"{tmp_path}/checkpoint", schema).awaitTermination()
    assert incremental.slides_to_redo(spark, source, sink, schema).count() == 0
    shutil.rmtree(f"{sink}/slide=2")
    for file in glob.glob(f"{sink}/slide=4/*/*.parquet"):
        with open(file, "r+b") as f:
            f.truncate(20)
    for crc in glob.glob(f"{sink}/slide=4/*/.*.crc"):
        os.remove(crc)
    assert {r.slide for r in incremental.slides_to_redo(spark, source, sink, schema).collect()} == {2, 4}
    assert incremental.redo_slides(spark, source, sink, schema) == 0
    assert spark.read.parquet(sink).count() == 60


def test_slides_split_over_batches_and_runs(spark, tmp_path):
    """A slide of several files is whole after each run; a batch that runs again changes nothing; damage is mended by the run that meets it."""
    source, sink, checkpoint, schema = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", "cell_id bigint, slide bigint, x double"
    rows = spark.range(60).select(F.col("id").alias("cell_id"), (F.col("id") % 3).alias("slide"), F.when(F.col("id") % 7 > 0, 0.5).alias("x"))
    held = lambda: sorted(r.cell_id for r in spark.read.parquet(sink).collect())
    rows.where("cell_id < 40").repartition(3).write.parquet(source)
    status = incremental.ingest(spark, source, sink, checkpoint, schema, files_at_once=1).collect()
    assert held() == list(range(40)) and {(r.slide, r.files, r.status) for r in status} == {(0, 3, "completed"), (1, 3, "completed"), (2, 3, "completed")}
    last = max((int(os.path.basename(f)), f) for f in glob.glob(f"{checkpoint}/commits/[0-9]*"))[1]
    for file in (last, f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        os.remove(file)  # as if the driver had died before the commit
    rows.where("cell_id >= 40").repartition(2).write.mode("append").parquet(source)
    shutil.rmtree(f"{sink}/slide=1")
    status = incremental.ingest(spark, source, sink, checkpoint, schema, files_at_once=1).collect()
    assert held() == list(range(60)) and {(r.slide, r.files, r.rows, r.status) for r in status} == {(k, 5, 20, "completed") for k in range(3)}
    shutil.rmtree(f"{sink}/slide=2")
    assert incremental.damaged_files(spark, sink, schema).select("slide").distinct().collect() == [(2,)]
    gone = incremental.ingest(spark, source, sink, checkpoint, schema, attempts=0, check_all=True)
    assert {(r.slide, r.status) for r in gone.collect()} == {(0, "completed"), (1, "completed"), (2, "failed")}
    incremental.ingest(spark, source, sink, checkpoint, schema, check_all=True)
    assert held() == list(range(60)) and incremental.damaged_files(spark, sink, schema).count() == 0


def test_row_numbers_beside_clashing_names(spark):
    names = ["_at", "_part", "_in", "_base", "_n", "_"]
    df = spark.createDataFrame([(k, *names) for k in range(9)], "k long, " + ", ".join(f"{c} string" for c in names)).repartition(3)
    numbered, n = ordering.number_rows(df, F.desc("k"))
    assert n == 9 and numbered.columns == [*df.columns, "row_idx"]
    assert sorted(tuple(r) for r in numbered.collect()) == [(k, *names, 8 - k) for k in range(9)]


def test_lines_of_several_files_follow_their_names(spark, tmp_path):
    for name, lines in (("b.txt", ["E4\tB", "E5\tC"]), ("a.txt", ["E1\tA", "E2\tB", "no tab", "E3\tC"] + [f"E{k}\tX" for k in range(10, 400)])):
        (tmp_path / name).write_text("\n".join(lines))
    assert {r.symbol: r.ens_id for r in readers.read_gene_map(spark, str(tmp_path)).collect()} == {"A": "E1", "B": "E4", "C": "E5", "X": "E399"}


def test_wide_matrices_are_read_as_text(spark, tmp_path):
    """Thousands of columns, quoted genes, empty and odd values, a header in every file; and an empty folder."""
    names = [f"TCGA-{k}" for k in range(3000)]
    head = "," + ",".join(f'"{n}"' if k % 2 else n for k, n in enumerate(names))
    rows = {"ENSG00000000003.15": range(3000), 'a "b", c': range(5, 3005), "ENSG5": ["", "NA", "1e3", *([""] * 2997)]}
    (tmp_path / "one.csv").write_text("\n".join([head, "ENSG00000000003.15," + ",".join(map(str, rows["ENSG00000000003.15"]))]))
    (tmp_path / "two.csv").write_text("\n".join([head, '"a ""b"", c",' + ",".join(map(str, rows['a "b", c'])), "ENSG5," + ",".join(rows["ENSG5"]), ""]))
    got = readers.read_expression_wide(spark, str(tmp_path), cut_ids=False)
    held = {(r.gene_id, r.sample_id): r.value for r in got.collect()}
    number = lambda v: {"": None, "NA": None}.get(v, v if v in ("", "NA") else float(v))
    assert held == {(g, n): number(v) for g, own in rows.items() for n, v in zip(names, own)}
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 2 * len(head)  # the header once, no column for each name
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.csv").write_text("")
    assert readers.read_expression_wide(spark, f"{tmp_path}/none").collect() == []


def test_graph_snapshots(spark, tmp_path):
    """A run that dies between tables leaves the snapshot before; tables not given are taken over; what nobody names can go."""
    folder, rows = f"{tmp_path}/graphs", spark.range(5).select(F.col("id").alias("cell_id"))
    with pytest.raises(FileNotFoundError):
        writers.read_graphs(spark, folder, "nodes")
    assert writers.write_graphs(folder, nodes=rows, edges=rows.limit(2)) == "0" * 12
    with pytest.raises(Exception, match="gone"):
        writers.write_graphs(folder, nodes=rows.limit(0), edges=rows.select(F.raise_error(F.lit("gone")).alias("cell_id")))
    assert writers.read_graphs(spark, folder, "nodes").count() == 5 and writers.snapshots(spark, folder) == ["0" * 12]
    last = writers.write_graphs(folder, nodes=rows.limit(1))
    assert (writers.read_graphs(spark, folder, "nodes").count(), writers.read_graphs(spark, folder, "edges").count()) == (1, 2)
    assert writers.read_graphs(spark, folder, "nodes", "0" * 12).count() == 5
    assert writers.drop_snapshots(spark, folder) == 1 and writers.snapshots(spark, folder) == [last]  # what the dead run wrote; edges of the first one stay
    assert (writers.read_graphs(spark, folder, "nodes").count(), writers.read_graphs(spark, folder, "edges").count()) == (1, 2)


def test_states_merge_to_the_full_pass(spark, tmp_path):
    rng = np.random.default_rng(3)
    values = {s: rng.normal(1e9, 1, 400) + s for s in range(6)}
    values[2][:7] = np.nan
    rows = [(s, "g" if k % 2 else "h", None if k == 50 else float(v)) for s, own in values.items() for k, v in enumerate(own)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "slide long, gene string, value double, n string")
    folder = f"{tmp_path}/states"
    partials.store_stats(partials.partial_stats(df.where("slide != 4"), "slide", "gene"), folder, "slide")
    partials.store_stats(partials.partial_stats(df.where("slide = 4"), "slide", "gene"), folder, "slide")  # a slide more: only it is read
    for wanted in (range(6), (0, 2, 4)):
        chosen = partials.stored_stats(spark, folder, spark.createDataFrame([(s,) for s in wanted], "slide long"))
        for r in partials.described(partials.merged_stats(chosen, "gene"), "gene", 0.1, 0.5).collect():
            own = np.array([v for s, g, v in rows if s in wanted and g == r.gene and v is not None and not math.isnan(v)])
            assert r.n == len(own) and r.least == own.min() and r.most == own.max()
            assert abs(r.mean - own.mean()) < 1e-5 and abs(r.std - own.std()) < 1e-5
            assert all(abs((own <= q).mean() - share) < 0.03 for q, share in zip(r.quantiles, (0.1, 0.5)))
    stats = {r.gene: (r.mean, r.std) for r in partials.gene_stats(partials.stored_stats(spark, folder)).collect()}
    assert all(abs(r.std - stats[r.gene][1]) < 1e-5 for r in expression.gene_stats(df.where("value is not null and not isnan(value)")).collect())
    dims = partials.merged_stats(partials.partial_dimension_stats(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 2.0])], "slide string, features array<double>")), "dim").collect()
    assert {(r.dim, r.n, r.mean, r.m2) for r in dims} == {(0, 2, 2.0, 2.0), (1, 2, 2.0, 0.0)}


def test_long_gene_lists_meet_samples_in_blocks(spark, monkeypatch):
    genes = spark.createDataFrame([(k, f"G{k}") for k in range(11)], "pos int, symbol string")
    expr = spark.createDataFrame([("s", "g3", 2.0), ("t", "G5", 1.0)], "sample_id string, gene string, value double")
    want = sorted(map(tuple, expression.align_genes(expr, genes, ignore_case=True).collect()))
    monkeypatch.setattr(expression, "BROADCAST_GENES", 3)
    assert sorted(map(tuple, expression.align_genes(expr, genes, ignore_case=True).collect())) == want and len(want) == 22
