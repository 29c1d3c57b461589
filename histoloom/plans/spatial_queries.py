"""Queries over spatial joins, graphs, groups and reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from histoloom.functions import geometry, vectors
from histoloom.operators import graphs, ordering, reduce, spatial
from histoloom.plans import views
from histoloom.plans.registry import query
from histoloom.session import table

RADIUS, REACH = 5000.0, 6000.0
EDGES_SQL = "edges AS (SELECT a.slide, a.cell_id AS src, b.cell_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM cells a JOIN cells b ON a.slide = b.slide WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) BETWEEN 1 AND 25000000)"
TILED_SQL = "tiled AS (SELECT c.cell_id, c.slide, t.tile_id, c.x, c.y, CAST(c.slide AS VARCHAR) || '-' || CAST(t.tile_id AS VARCHAR) AS tile FROM cells c JOIN tiles t ON c.slide = t.slide AND c.x >= t.x1 AND c.x < t.x2 AND c.y >= t.y1 AND c.y < t.y2)"
NEAR_SQL = "pairs AS (SELECT a.slide, a.cell_id AS src, b.cell_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM cells a JOIN cells b ON a.slide = b.slide AND a.cell_id <> b.cell_id), near AS (SELECT *, row_number() OVER (PARTITION BY slide, src ORDER BY d2, dst) AS rank FROM pairs)"
TILE_WIDTH = float(views.TILE)


def _tiled(spark, sf_dir):
    rows = spatial.assign_to_tiles(views.cells(spark, sf_dir), views.tiles(spark, sf_dir), TILE_WIDTH, TILE_WIDTH)
    return rows.withColumn("tile", F.concat_ws("-", F.col("slide").cast("string"), F.col("tile_id").cast("string")))


@query("a06_graph_metadata", f"WITH {views.CELLS_SQL}, {views.TILES_SQL}, {EDGES_SQL}, c AS (SELECT slide, count(*) AS cells FROM cells GROUP BY 1), t AS (SELECT slide, count(*) AS tiles FROM tiles GROUP BY 1), e AS (SELECT slide, count(*) AS edges, count(DISTINCT src) AS connected_cells FROM edges GROUP BY 1) SELECT slide, cells, coalesce(tiles, 0) AS tiles, coalesce(edges, 0) AS edges, coalesce(connected_cells, 0) AS connected_cells, coalesce(edges, 0) > 0 AS has_graph FROM c LEFT JOIN t USING (slide) LEFT JOIN e USING (slide)")
def graph_metadata(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    return graphs.graph_metadata(cells, views.tiles(spark, sf_dir), spatial.radius_graph(cells, RADIUS))


@query("j01_cells_to_tiles", f"WITH {views.CELLS_SQL}, {views.TILES_SQL}, {TILED_SQL} SELECT cell_id, tile_id FROM tiled")
def cells_to_tiles(spark, sf_dir):
    return _tiled(spark, sf_dir).select("cell_id", "tile_id")


@query("j02_nuclei_to_tiles", f"WITH {views.CELLS_SQL}, {views.TILES_SQL} SELECT cell_id FROM cells c WHERE EXISTS (SELECT 1 FROM tiles t WHERE t.slide = c.slide AND t.tile_id % 3 <> 0 AND t.x1 = CAST(floor(c.x / 12500.0) AS BIGINT) * 12500 AND t.y1 = CAST(floor(c.y / 12500.0) AS BIGINT) * 12500)")
def nuclei_to_tiles(spark, sf_dir):
    size = F.lit(views.TILE)
    nuclei = views.cells(spark, sf_dir).withColumn("t", geometry.lattice_tile(F.col("x"), F.col("y"), F.lit(0), F.lit(0), size, size)).select("cell_id", "slide", "t.*")
    return spatial.nuclei_to_tiles(nuclei, views.tiles(spark, sf_dir).where("tile_id % 3 != 0")).select("cell_id")


@query("j03_nearest_spot_within", f"WITH {views.CELLS_SQL}, {views.SPOTS_SQL}, p AS (SELECT c.cell_id, s.spot_idx, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2 FROM loose c JOIN spots s ON c.slide = s.slide), b AS (SELECT cell_id, arg_min(spot_idx, (d2, spot_idx)) AS spot_idx, min(d2)::DOUBLE AS d2 FROM p WHERE d2 <= 36000000 GROUP BY 1) SELECT cell_id, b.spot_idx, b.d2 FROM loose LEFT JOIN b USING (cell_id)")
def nearest_spot_within(spark, sf_dir):
    return spatial.nearest_within(views.loose_cells(spark, sf_dir), views.spots(spark, sf_dir), REACH).select("cell_id", "spot_idx", "d2")


@query("j04_positional_map", f"WITH {views.CELLS_SQL}, {views.SPOTS_SQL}, c AS (SELECT cell_id, slide, row_number() OVER (PARTITION BY slide ORDER BY cell_id) AS r FROM loose), s AS (SELECT spot_idx, slide, row_number() OVER (PARTITION BY slide ORDER BY spot_idx) AS r FROM spots) SELECT cell_id, coalesce(spot_idx, -1) AS spot_idx FROM c LEFT JOIN s USING (slide, r)")
def positional_map(spark, sf_dir):
    cells = graphs.node_index(views.loose_cells(spark, sf_dir), "slide", "cell_id").withColumnRenamed("node_idx", "row_idx")
    spots = graphs.node_index(views.spots(spark, sf_dir), "slide", "spot_idx").withColumnRenamed("node_idx", "row_idx")
    return spatial.positional_map(cells, spots).select("cell_id", F.coalesce("spot_idx", F.lit(-1).cast("long")).alias("spot_idx"))


@query("j05_radius_graph", f"WITH {views.CELLS_SQL}, {EDGES_SQL} SELECT slide, src, dst, d2::DOUBLE AS d2 FROM edges")
def radius_graph(spark, sf_dir):
    return spatial.radius_graph(views.cells(spark, sf_dir), RADIUS)


@query("j06_w02_knn_graph", f"WITH {views.CELLS_SQL}, {NEAR_SQL}, k AS (SELECT slide, src, dst, d2 FROM near WHERE rank <= 8) SELECT slide, src, dst, d2::DOUBLE AS d2 FROM k UNION ALL SELECT slide, dst, src, d2::DOUBLE FROM k")
def knn_graph(spark, sf_dir):
    return spatial.knn_graph(views.cells(spark, sf_dir), 8)


@query("j06_knn_graph_deduped", f"WITH {views.CELLS_SQL}, {NEAR_SQL}, k AS (SELECT slide, src, dst FROM near WHERE rank <= 8) SELECT slide, src, dst FROM k UNION SELECT slide, dst, src FROM k")
def knn_graph_deduped(spark, sf_dir):
    return spatial.knn_graph(views.cells(spark, sf_dir), 8, dedupe=True).select("slide", "src", "dst")


@query("j07_tile_knn_graph", f"WITH {views.CELLS_SQL}, {views.TILES_SQL}, c2 AS (SELECT slide, tile_id AS cell_id, (x1 + x2) / 2.0 AS x, (y1 + y2) / 2.0 AS y FROM tiles), pairs AS (SELECT a.slide, a.cell_id AS src, b.cell_id AS dst, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE AS d2 FROM c2 a JOIN c2 b ON a.slide = b.slide AND a.cell_id <> b.cell_id), k AS (SELECT *, row_number() OVER (PARTITION BY slide, src ORDER BY d2, dst) AS r FROM pairs) SELECT slide, src, dst, d2 FROM k WHERE r <= 6 UNION ALL SELECT slide, dst, src, d2 FROM k WHERE r <= 6")
def tile_knn_graph(spark, sf_dir):
    centres = views.tiles(spark, sf_dir).select("slide", "tile_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return spatial.knn_graph(centres, 6, node="tile_id")


@query("j08_radius_else_knn", f"WITH {views.CELLS_SQL}, {views.TILES_SQL}, {TILED_SQL}, pairs AS (SELECT a.tile, a.cell_id AS src, b.cell_id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM tiled a JOIN tiled b ON a.tile = b.tile AND a.cell_id <> b.cell_id), r AS (SELECT * FROM pairs WHERE d2 BETWEEN 1 AND 1000000), k AS (SELECT *, row_number() OVER (PARTITION BY tile, src ORDER BY d2, dst) AS n FROM pairs WHERE tile NOT IN (SELECT tile FROM r)) SELECT tile, src, dst FROM r UNION ALL SELECT tile, src, dst FROM k WHERE n <= 3 UNION ALL SELECT tile, dst, src FROM k WHERE n <= 3")
def radius_else_knn(spark, sf_dir):
    return spatial.radius_else_knn(_tiled(spark, sf_dir), 1000.0).select("tile", "src", "dst")


@query("j12_attach_cluster", f"WITH {views.CELLS_SQL} SELECT cell_id, coalesce(label, -1) AS cluster FROM cells LEFT JOIN embeddings ON vec_id = cell_id")
def attach_cluster(spark, sf_dir):
    clusters = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), "label")
    return graphs.attach_labels(views.cells(spark, sf_dir), clusters).select("cell_id", "cluster")


@query("j15_align_lengths", "WITH f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings), p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events WHERE event_id % 3 = 0) SELECT r AS row_idx, vec_id, event_id FROM f JOIN p USING (r)")
def align_lengths(spark, sf_dir):
    features, _ = ordering.number_rows(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")
    positions, _ = ordering.number_rows(table(spark, sf_dir, "events").select("event_id").where("event_id % 3 = 0"), "event_id")
    return features.join(positions, "row_idx").select("row_idx", "vec_id", "event_id")


@query("j21_a30_polygons", f"WITH {views.CELLS_SQL} SELECT cell_id, CASE WHEN cell_id % 4 = 0 THEN 4.0 ELSE 25.0 END::DOUBLE AS area FROM cells")
def cells_with_polygons(spark, sf_dir):
    cells = views.cells(spark, sf_dir)
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("vertex_idx"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(((0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)))]))
    vertices = cells.where("cell_id % 4 != 0").select("cell_id", "x", "y", corner.alias("c")).select("cell_id", "c.vertex_idx", (F.col("x") + F.col("c.a")).alias("x"), (F.col("y") + F.col("c.b")).alias("y"))
    joined = cells.join(graphs.polygons(vertices), "cell_id", "left")
    return joined.select("cell_id", geometry.polygon_area(F.coalesce("polygon", geometry.square(F.col("x"), F.col("y")))).alias("area"))


@query("a07_graph_size_stats", f"WITH {views.CELLS_SQL}, {views.TILES_SQL}, {TILED_SQL}, n AS (SELECT tile, count(*) AS nodes FROM tiled GROUP BY 1), e AS (SELECT a.tile, count(*) AS edges FROM tiled a JOIN tiled b ON a.tile = b.tile WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) BETWEEN 1 AND 4000000 GROUP BY 1) SELECT count(*) AS graphs, min(nodes) AS min_nodes, max(nodes) AS max_nodes, round(avg(nodes), 4) AS mean_nodes, sum(coalesce(edges, 0))::BIGINT AS total_edges FROM n LEFT JOIN e USING (tile)")
def graph_size_stats(spark, sf_dir):
    nodes = _tiled(spark, sf_dir)
    stats = graphs.size_stats(graphs.graph_sizes(nodes, spatial.radius_graph(nodes, 2000.0, "tile"), "tile"))
    return stats.withColumn("mean_nodes", F.round("mean_nodes", 4))


@query("a08_cells_per_spot", f"WITH {views.CELLS_SQL}, {views.SPOTS_SQL}, p AS (SELECT c.cell_id, s.spot_idx, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2 FROM loose c JOIN spots s ON c.slide = s.slide), b AS (SELECT cell_id, arg_min(spot_idx, (d2, spot_idx)) AS spot_idx FROM p WHERE d2 <= 36000000 GROUP BY 1), n AS (SELECT spot_idx, count(*) AS n FROM b GROUP BY 1) SELECT count(*) AS spots, min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean FROM n")
def cells_per_spot(spark, sf_dir):
    assigned = spatial.nearest_within(views.loose_cells(spark, sf_dir), views.spots(spark, sf_dir), REACH).where("spot_idx is not null")
    return assigned.groupBy("spot_idx").agg(F.count("*").alias("n")).agg(F.count("*").alias("spots"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"))


@query("a09_nearest_distance_stats", f"WITH {views.CELLS_SQL}, {views.SPOTS_SQL}, d AS (SELECT c.cell_id, sqrt(min((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y))) AS d FROM loose c JOIN spots s ON c.slide = s.slide GROUP BY 1) SELECT count(*) AS cells, round(min(d), 4) AS min_px, round(max(d), 4) AS max_px, round(avg(d), 4) AS mean_px, round(avg(d) * 0.5, 4) AS mean_um FROM d")
def nearest_distance_stats(spark, sf_dir):
    spots = views.spots(spark, sf_dir).withColumnRenamed("spot_idx", "cell_id")
    near = spatial.k_nearest(views.loose_cells(spark, sf_dir), spots, 1, exclude_self=False).select(F.sqrt("d2").alias("d"))
    return near.agg(F.count("*").alias("cells"), F.round(F.min("d"), 4).alias("min_px"), F.round(F.max("d"), 4).alias("max_px"), F.round(F.avg("d"), 4).alias("mean_px"), F.round(geometry.px_to_um(F.avg("d"), F.lit(None).cast("double")), 4).alias("mean_um"))


@query("a10_coordinate_range", f"WITH {views.CELLS_SQL} SELECT slide, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM cells GROUP BY 1")
def coordinate_range(spark, sf_dir):
    return spatial.coordinate_range(views.cells(spark, sf_dir))


@query("a20_compactness", f"WITH {views.FEATURES_SQL}, v AS (SELECT cell_id, slide, label, unnest(range(1, 65)) AS d, unnest(features)::DOUBLE AS v FROM features), m AS (SELECT slide, label, d, avg(v) AS m, count(*) AS n FROM v GROUP BY ALL), q AS (SELECT v.slide, v.label, cell_id, sqrt(sum((v.v - m.m) * (v.v - m.m))) AS dist FROM v JOIN m ON v.slide = m.slide AND v.label = m.label AND v.d = m.d WHERE n > 1 GROUP BY ALL), l AS (SELECT slide, label, avg(dist) AS dist FROM q GROUP BY ALL) SELECT slide, round(sum(dist), 4) AS compactness FROM l GROUP BY 1")
def compactness(spark, sf_dir):
    return graphs.compactness(views.features(spark, sf_dir), "slide").select("slide", F.round("compactness", 4).alias("compactness"))


@query("a27_a28_tile_lattice", f"WITH {views.CELLS_SQL}, {views.TILES_SQL} SELECT slide, arg_min(x2 - x1, tile_id) AS width, arg_min(y2 - y1, tile_id) AS height, min(x1) AS x0, min(y1) AS y0 FROM tiles GROUP BY 1")
def tile_lattice(spark, sf_dir):
    return spatial.tile_lattice(views.tiles(spark, sf_dir))


@query("a29_spot_arrays", f"WITH {views.CELLS_SQL}, {views.TILES_SQL}, {TILED_SQL} SELECT tile, string_agg(cell_id::VARCHAR, ',' ORDER BY cell_id) AS cell_id, string_agg(x::VARCHAR, ',' ORDER BY cell_id) AS x FROM tiled GROUP BY 1")
def spot_arrays(spark, sf_dir):
    rows = graphs.spot_arrays(_tiled(spark, sf_dir), ["tile"], "cell_id", "x")
    return rows.select("tile", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("cell_id", "x")])


@query("a29_spot_arrays_by_offsets", f"WITH {views.CELLS_SQL}, r AS (SELECT cell_id, slide, cell_id % 10 AS spot, x, row_number() OVER (PARTITION BY slide ORDER BY cell_id % 10, cell_id) - 1 AS nth FROM cells), s AS (SELECT DISTINCT slide, spot FROM r UNION SELECT DISTINCT slide, 10 FROM r) SELECT s.slide, s.spot, coalesce(string_agg(cell_id::VARCHAR, ',' ORDER BY nth), '') AS cell_id, coalesce(string_agg(x::VARCHAR, ',' ORDER BY nth), '') AS x FROM s LEFT JOIN r ON s.slide = r.slide AND s.spot = r.spot GROUP BY ALL")
def spot_arrays_by_offsets(spark, sf_dir):
    """Cells in spot order with their place, and where each spot begins and ends; an empty spot after the last one."""
    cells = views.cells(spark, sf_dir).withColumn("spot", F.col("cell_id") % 10)
    placed = ordering.number_within(cells, "slide", "spot", "cell_id", name="row_idx")
    offsets = graphs.spot_offsets(cells, "slide", "spot")
    empty = offsets.groupBy("slide").agg(F.lit(10).cast("long").alias("spot"), F.max("end").alias("start"), F.max("end").alias("end"))
    rows = graphs.spot_arrays_by_offsets(placed, offsets.unionByName(empty), "slide", "spot", "row_idx", "cell_id", "x")
    return rows.select("slide", "spot", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("cell_id", "x")])


@query("a33_neighbour_mean", f"WITH {views.CELLS_SQL}, {EDGES_SQL}, e AS (SELECT slide, src, dst FROM edges UNION ALL SELECT slide, cell_id, cell_id FROM cells), d AS (SELECT slide, dst AS node, count(*) AS d FROM e GROUP BY ALL) SELECT e.slide, e.dst AS cell_id, round(sum(c.x / sqrt(a.d * b.d::DOUBLE)), 4) AS fx, round(sum(c.y / sqrt(a.d * b.d::DOUBLE)), 4) AS fy FROM e JOIN d a ON a.slide = e.slide AND a.node = e.src JOIN d b ON b.slide = e.slide AND b.node = e.dst JOIN cells c ON c.cell_id = e.src GROUP BY ALL")
def neighbour_mean(spark, sf_dir):
    cells = views.cells(spark, sf_dir).withColumn("features", F.array(F.col("x").cast("double"), F.col("y").cast("double")))
    mean = spatial.radius_pool(cells, RADIUS)
    return mean.select("slide", "cell_id", F.round(F.get("features", F.lit(0)), 4).alias("fx"), F.round(F.get("features", F.lit(1)), 4).alias("fy"))


@query("w01_node_index", f"WITH {views.CELLS_SQL}, {views.TILES_SQL}, {TILED_SQL} SELECT cell_id, tile, (row_number() OVER (PARTITION BY tile ORDER BY cell_id) - 1)::INTEGER AS node_idx FROM tiled")
def node_index(spark, sf_dir):
    return graphs.node_index(_tiled(spark, sf_dir), "tile", "cell_id").select("cell_id", "tile", "node_idx")


@query("w03_first_seen_id", f"WITH {views.CELLS_SQL}, {views.TILES_SQL}, {TILED_SQL}, f AS (SELECT tile, row_number() OVER (ORDER BY min(cell_id)) - 1 AS tile_no FROM tiled GROUP BY tile) SELECT cell_id, tile, tile_no FROM tiled JOIN f USING (tile)")
def first_seen_id(spark, sf_dir):
    return ordering.first_seen(_tiled(spark, sf_dir), ["tile"], "cell_id", "tile_no").select("cell_id", "tile", "tile_no")


@query("w11_spot_offsets", f"WITH {views.CELLS_SQL}, n AS (SELECT slide, cell_id % 10 AS spot, count(*) AS n FROM cells GROUP BY ALL) SELECT slide, spot, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS end FROM n WINDOW w AS (PARTITION BY slide ORDER BY spot)".replace("AS end", 'AS "end"'))
def spot_offsets(spark, sf_dir):
    return graphs.spot_offsets(views.cells(spark, sf_dir).withColumn("spot", F.col("cell_id") % 10), "slide", "spot")


@query("a24_pca_projection")
def pca_projection(spark, sf_dir):
    """Eight centred components for every slide and the cells' places along them."""
    features = views.features(spark, sf_dir)
    model = reduce.fit_pca(features, 8)
    return reduce.project(features, model).select("cell_id", "slide", F.transform("projected", lambda v: F.round(v, 4)).alias("projected"))


@query("a25_w08_explained_variance")
def explained_variance(spark, sf_dir):
    """Share and running share of the variance by component."""
    return reduce.explained(reduce.fit_pca(views.features(spark, sf_dir), 50)).select("slide", "component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


MOMENTS_SQL = f"{views.FEATURES_SQL}, v AS (SELECT slide, unnest(range(1, 65)) AS d, unnest(features)::DOUBLE AS v FROM features), t AS (SELECT slide, sum(s) AS trace FROM (SELECT slide, d, var_pop(v) AS s FROM v GROUP BY ALL) GROUP BY 1), k AS (SELECT slide, count(*) AS cells FROM features GROUP BY 1)"


@query("a24_projected_spread", f"WITH {MOMENTS_SQL} SELECT slide, cells, round(trace, 4) AS spread, 0.0::DOUBLE AS mean FROM k JOIN t USING (slide)")
def projected_spread(spark, sf_dir):
    """What a projection on all components keeps: the mean squared length is the total variance, and the mean is nought."""
    features = views.features(spark, sf_dir)
    placed = reduce.project(features, reduce.fit_pca(features, 64))
    square = F.aggregate("projected", F.lit(0.0), lambda s, x: s + x * x)
    total = F.aggregate("projected", F.lit(0.0), lambda s, x: s + x)
    sums = placed.groupBy("slide").agg(F.count("*").alias("cells"), F.round(F.avg(square), 4).alias("spread"), F.round(F.avg(total), 4).alias("mean"))
    return sums.withColumn("mean", F.abs("mean"))


@query("a25_total_variance", f"WITH {MOMENTS_SQL} SELECT slide, least(cells, 64)::BIGINT AS components, round(trace, 6) AS variance, 1.0::DOUBLE AS ratio FROM k JOIN t USING (slide)")
def total_variance(spark, sf_dir):
    """All components of a slide together have the variance of its columns."""
    model = reduce.fit_pca(views.features(spark, sf_dir), 64)
    return model.groupBy("slide").agg(F.count("*").alias("components"), F.round(F.sum("variance"), 6).alias("variance"), F.round(F.sum("ratio"), 6).alias("ratio"))


@query("a26_settled_clusters", f"WITH {views.FEATURES_SQL}, k AS (SELECT slide, count(*) AS cells FROM features GROUP BY 1) SELECT slide, cells, least(cells, 7)::BIGINT AS clusters, 0::BIGINT AS strays FROM k")
def settled_clusters(spark, sf_dir):
    """Once settled, no cell is nearer to another cluster's mean than to its own's."""
    labelled = reduce.kmeans(views.features(spark, sf_dir).drop("label"), 7, rounds=None)
    means = labelled.groupBy("slide", "label").agg(reduce.vector_mean("features").alias("mean"))
    means = means.groupBy("slide").agg(F.collect_list(F.struct("label", "mean")).alias("means"))  # seven
    apart = F.transform("means", lambda m: F.struct(vectors.squared_distance(F.col("features").cast("array<double>"), m["mean"]).alias("d2"), m["label"].alias("label")))
    own = F.array_min(F.transform(F.filter(apart, lambda a: a["label"] == F.col("label")), lambda a: a["d2"]))
    least = F.array_min(F.transform(apart, lambda a: a["d2"]))
    rows = labelled.join(means, "slide").select("slide", "label", (own > least * (1 + 1e-9)).alias("stray"))
    return rows.groupBy("slide").agg(F.count("*").alias("cells"), F.count_distinct("label").alias("clusters"), F.count_if("stray").alias("strays"))


@query("a26_kmeans")
def kmeans(spark, sf_dir):
    """Seven clusters for every slide."""
    return reduce.kmeans(views.features(spark, sf_dir).drop("label"), 7).select("cell_id", "slide", "label")
