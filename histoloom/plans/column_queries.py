"""Queries over column functions (identifiers, vectors, geometry)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoloom.functions import geometry, ids, vectors
from histoloom.plans import views
from histoloom.plans.registry import query
from histoloom.session import table

NAMES_SQL = """names AS (SELECT event_id, user_id, CASE event_id % 5
 WHEN 0 THEN '/data/s' || user_id || '.b_tile36_features.parquet'
 WHEN 1 THEN 'dir/s-' || user_id || '-z-q_features.parquet'
 WHEN 2 THEN '/img/w' || user_id || '/s' || user_id || '_patch_tile_' || event_id || '_level0_' || event_id * 4 || '-' || event_id * 2 || '-' || event_id * 4 + 256 || '-' || event_id * 2 + 256 || '.png'
 WHEN 3 THEN 'a/s' || user_id || '_patch_tile_' || event_id || '_level0_1-2-3-' || event_id
 ELSE 'plain:' || user_id || '\\x' END AS name FROM events)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of five kinds, made from event and user ids."""
    e, u = F.col("event_id"), F.col("user_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    kinds = [
        text("/data/s", u, ".b_tile36_features.parquet"),
        text("dir/s-", u, "-z-q_features.parquet"),
        text("/img/w", u, "/s", u, "_patch_tile_", e, "_level0_", e * 4, "-", e * 2, "-", e * 4 + 256, "-", e * 2 + 256, ".png"),
        text("a/s", u, "_patch_tile_", e, "_level0_1-2-3-", e),
    ]
    name = text("plain:", u, "\\x")
    for k in (3, 2, 1, 0):
        name = F.when(e % 5 == k, kinds[k]).otherwise(name)
    return table(spark, sf_dir, "events").select("event_id", "user_id", name.alias("name"))


BASE = "regexp_extract(name, '([^/]*)$', 1)"
SLIDE = f"CASE WHEN {BASE} LIKE '%\\_tile36\\_features.parquet' ESCAPE '\\' THEN left({BASE}, length({BASE}) - 24) WHEN {BASE} LIKE '%\\_features.parquet' ESCAPE '\\' THEN left({BASE}, length({BASE}) - 17) WHEN contains({BASE}, '_patch_tile_') THEN split_part({BASE}, '_patch_tile_', 1) ELSE {BASE} END"


@query("p01_p02_slide_and_case", f"WITH {NAMES_SQL}, s AS (SELECT event_id, {SLIDE} AS slide FROM names) SELECT event_id, slide, CASE WHEN len(string_split(slide, '-')) >= 3 THEN array_to_string(string_split(slide, '-')[1:3], '-') ELSE left(slide, 12) END AS case_id FROM s")
def slide_and_case(spark, sf_dir):
    slide = ids.slide_id(F.col("name"))
    return names(spark, sf_dir).select("event_id", slide.alias("slide"), ids.case_id(slide).alias("case_id"))


def _groups(pattern: str, subject: str, columns: dict[str, int]) -> str:
    return ", ".join(f"try_cast(regexp_extract({subject}, '{pattern}', {k}) AS INTEGER) AS {c}" for c, k in columns.items())


@query(
    "p03_tile_bounds",
    f"WITH {NAMES_SQL} SELECT event_id, {_groups(ids.TILE_NAME, BASE, {'tile_id': 1, 'x1': 2, 'y1': 3, 'x2': 4, 'y2': 5})}, {_groups(ids.LEVEL0_BOUNDS, 'name', {'lx1': 1, 'ly2': 4})}, {_groups(ids.TILE_STEM, 'name', {'sx1': 1, 'sy2': 4})} FROM names",
)
def tile_bounds(spark, sf_dir):
    rows = names(spark, sf_dir).withColumns({"t": ids.tile_bounds(F.col("name")), "l": ids.level0_bounds(F.col("name")), "s": ids.stem_bounds(F.col("name"))})
    return rows.select("event_id", "t.*", F.col("l.x1").alias("lx1"), F.col("l.y2").alias("ly2"), F.col("s.x1").alias("sx1"), F.col("s.y2").alias("sy2"))


@query("p04_tile_geometry", f"WITH {views.CELLS_SQL}, {views.TILES_SQL} SELECT slide, tile_id, (x1 + x2) / 2.0 AS center_x, (y1 + y2) / 2.0 AS center_y, x2 - x1 AS width, y2 - y1 AS height FROM tiles")
def tile_geometry(spark, sf_dir):
    return views.tiles(spark, sf_dir).select("slide", "tile_id", *geometry.tile_geometry(*map(F.col, ("x1", "y1", "x2", "y2"))))


@query("p05_p06_absolute_and_relative", f"WITH {views.CELLS_SQL} SELECT cell_id, x - CAST(floor(x / 12500.0) AS BIGINT) * 12500 AS x, y - CAST(floor(y / 12500.0) AS BIGINT) * 12500 AS y, x AS ax, y AS ay FROM cells")
def absolute_and_relative(spark, sf_dir):
    rows = views.cells(spark, sf_dir).withColumns({c: F.floor(F.col(v) / 12500.0) * 12500 for c, v in (("x1", "x"), ("y1", "y"))})
    inside = rows.select("cell_id", "x1", "y1", *geometry.to_tile(*map(F.col, ("x", "y", "x1", "y1"))))
    back = [c.alias(f"a{n}") for c, n in zip(geometry.to_absolute(*map(F.col, ("x", "y", "x1", "y1"))), "xy")]
    return inside.select("cell_id", "x", "y", *back)


@query("p07_truncated_ids", f"WITH {views.BARCODES_SQL} SELECT col_pos, left(barcode, 12) AS case_code, left(gene || barcode, 15) AS gene FROM barcodes")
def truncated_ids(spark, sf_dir):
    return views.barcodes(spark, sf_dir).select("col_pos", ids.sample_prefix(F.col("barcode")).alias("case_code"), ids.gene_prefix(F.concat("gene", "barcode")).alias("gene"))


@query(
    "p08_path_parts",
    f"WITH {NAMES_SQL}, s AS (SELECT event_id, user_id, regexp_replace({BASE}, '\\.[^.]*$', '') AS stem, CASE WHEN len(string_split(name, '/')) >= 2 THEN string_split(name, '/')[-2] END AS parent FROM names) SELECT event_id, stem, parent, CASE WHEN contains(stem, '_patch_') THEN string_split(stem, '_patch_')[-1] ELSE 'unknown' END AS image, coalesce(parent, 'none') || '_' || stem || '_cell_' || user_id AS unique_id FROM s",
)
def path_parts(spark, sf_dir):
    name = F.col("name")
    parent = ids.parent(name)
    return names(spark, sf_dir).select("event_id", ids.stem(name).alias("stem"), parent.alias("parent"), ids.after_patch(name).alias("image"), ids.unique_cell_id(F.coalesce(parent, F.lit("none")), ids.stem(name), F.col("user_id")).alias("unique_id"))


@query("p09_safe_id", f"WITH {NAMES_SQL} SELECT event_id, replace(replace(replace(name, '/', '_'), '\\', '_'), ':', '_') AS safe FROM names")
def safe_id(spark, sf_dir):
    return names(spark, sf_dir).select("event_id", ids.safe_id(F.col("name")).alias("safe"))


@query("p10_assemble_features", "SELECT vec_id, unnest(range(64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings")
def assemble_features(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    order = sorted(range(64), key=str)  # columns as a listing by name would have them
    wide = rows.select("vec_id", *[F.get("embedding", F.lit(k)).alias(f"feature_{k}") for k in order])
    return vectors.assemble(wide).select("vec_id", F.posexplode("features").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def _padded(values: str) -> str:
    return f"list_concat([{values}]::FLOAT[], list_transform(range(123), lambda i: 0::FLOAT))[1:128]"


@query(
    "p11_fallback_vectors",
    f"WITH {views.CELLS_SQL}, v AS (SELECT cell_id, unnest(['tiles', 'spots', 'grid', 'grid_rows']) AS layout, unnest([[x, y, 100.0, 35.4, 0], [100.0, 35.4, 1.0, x, y], [100.0, 35.4, 1.0, x, y], [0, 0, 0, x, y]]) AS v FROM cells) SELECT cell_id, layout, 128 AS width, v[1]::FLOAT::DOUBLE AS v0, v[2]::FLOAT::DOUBLE AS v1, v[3]::FLOAT::DOUBLE AS v2, v[4]::FLOAT::DOUBLE AS v3, v[5]::FLOAT::DOUBLE AS v4, 0.0::DOUBLE AS v127 FROM v",
)
def fallback_vectors(spark, sf_dir):
    rows = views.cells(spark, sf_dir)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("layout"), vectors.fallback_vector(rows, name).alias("v")) for name in vectors.LAYOUTS]))
    places = [F.get("l.v", F.lit(k)).cast("double").alias(f"v{k}") for k in (0, 1, 2, 3, 4, 127)]
    return rows.select("cell_id", each.alias("l")).select("cell_id", "l.layout", F.size("l.v").alias("width"), *places)


@query("p12_pad_or_cut", "WITH v AS (SELECT vec_id, unnest(range(70))::INTEGER AS dim, unnest(list_concat(embedding, list_transform(range(6), lambda i: 0::FLOAT))) AS v FROM embeddings) SELECT vec_id, dim, v::DOUBLE AS padded, CASE WHEN dim < 10 THEN v::DOUBLE END AS cut FROM v")
def pad_or_cut(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("short", vectors.pad_or_cut(F.col("embedding"), 10))
    rows = rows.select("vec_id", "short", F.posexplode(vectors.pad_or_cut(F.col("embedding"), 70)).alias("dim", "v"))
    return rows.select("vec_id", "dim", F.col("v").cast("double").alias("padded"), F.get("short", F.col("dim")).cast("double").alias("cut"))


SQUARES_SQL = f"{views.CELLS_SQL}, sides AS (SELECT cell_id, x, y, (cell_id % 40 + 1)::DOUBLE AS w, (cell_id % 30 + 2)::DOUBLE AS h FROM cells)"


def _boxes(spark, sf_dir):
    rows = views.cells(spark, sf_dir).withColumns({"w": (F.col("cell_id") % 40 + 1).cast("double"), "h": (F.col("cell_id") % 30 + 2).cast("double")})
    x, y, w, h = map(F.col, "xywh")
    corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return rows.withColumn("polygon", F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h)))


@query("p13_polygon_features", f"WITH {SQUARES_SQL} SELECT cell_id, round(w * h, 4) AS area, round(2 * (w + h), 4) AS perimeter, round(x + w / 2, 4) AS cx, round(y + h / 2, 4) AS cy, round(4 * (w + h) * (w + h) / (4 * pi() * w * h), 6) AS shape FROM sides")
def polygon_features(spark, sf_dir):
    p = F.col("polygon")
    rows = _boxes(spark, sf_dir).withColumns({"a": geometry.polygon_area(p), "l": geometry.polygon_perimeter(p), "c": geometry.polygon_centroid(p)})
    return rows.select("cell_id", F.round("a", 4).alias("area"), F.round("l", 4).alias("perimeter"), F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"), F.round(geometry.shape_factor(F.col("l"), F.col("a")), 6).alias("shape"))


@query("p14_clip_contour", f"WITH {SQUARES_SQL}, c AS (SELECT cell_id, unnest([0, 1, 2, 3]) AS corner, x, y, w, h FROM sides) SELECT cell_id, corner, greatest(0, least(CAST(x + CASE WHEN corner IN (1, 2) THEN w ELSE 0 END AS INTEGER) - 20000, 255))::INTEGER AS x, greatest(0, least(CAST(y + CASE WHEN corner IN (2, 3) THEN h ELSE 0 END AS INTEGER) - 100, 19999))::INTEGER AS y FROM c")
def clip_contour(spark, sf_dir):
    clipped = geometry.clip_contour(F.col("polygon"), F.lit(20000), F.lit(100), F.lit(256), F.lit(20000))
    return _boxes(spark, sf_dir).select("cell_id", F.posexplode(clipped).alias("corner", "p")).select("cell_id", "corner", "p.x", "p.y")


@query("p15_p16_contour_sides", f"WITH {SQUARES_SQL} SELECT cell_id, round(2 * (w + h), 4) AS arc, round(w * h, 4) AS area FROM sides WHERE w + 1 >= 10 AND h + 1 >= 10")
def contour_sides(spark, sf_dir):
    p = F.col("polygon")
    rows = _boxes(spark, sf_dir).withColumn("box", geometry.box_sides(p)).where("box.width >= 10 and box.height >= 10")
    return rows.select("cell_id", F.round(geometry.polygon_perimeter(p), 4).alias("arc"), F.round(geometry.polygon_area(p), 4).alias("area"))


@query(
    "p17_crop_window",
    f"WITH {views.CELLS_SQL}, c AS (SELECT cell_id, CAST(round_even(x - 24 * 1.25, 0) AS INTEGER) AS l, CAST(round_even(y + 0.5 - 24 * 1.25, 0) AS INTEGER) AS t FROM cells) SELECT cell_id, greatest(0, l) AS x1, greatest(0, t) AS y1, least(50000, l + 60) AS x2, least(49000, t + 60) AS y2 FROM c",
)
def crop_window(spark, sf_dir):
    window = geometry.crop_window(F.col("x").cast("double"), F.col("y") + 0.5, 48, F.lit(1.25), F.lit(50000), F.lit(49000))
    return views.cells(spark, sf_dir).select("cell_id", window.alias("w")).select("cell_id", "w.*")


@query("p22_nan_to_num", "WITH e AS (SELECT vec_id, unnest(range(64))::INTEGER AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, dim, CASE WHEN v > 0.3 THEN 1.0 WHEN v < -0.3 THEN -1.0 WHEN abs(v) < 0.001 THEN 0.0 ELSE v END::DOUBLE AS v FROM e")
def nan_to_num(spark, sf_dir):
    d = lambda s: F.lit(float(s))
    broken = F.transform("embedding", lambda v: F.when(v.cast("double") > 0.3, d("inf")).when(v.cast("double") < -0.3, d("-inf")).when(F.abs(v.cast("double")) < 0.001, d("nan")).otherwise(v.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.nan_to_num(broken)).alias("dim", "v"))


@query("p23_p24_micrometres", "SELECT p_partkey, p_size * CASE WHEN p_size % 3 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS um, CASE WHEN p_size % 4 = 0 THEN 25.0::DOUBLE ELSE p_size / 2.0::DOUBLE * CASE WHEN p_size % 3 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END * 1.5::DOUBLE END AS radius_um FROM part")
def micrometres(spark, sf_dir):
    size = F.col("p_size").cast("double")
    pixel = F.when(F.col("p_size") % 3 != 0, 0.25)
    diameter = F.when(F.col("p_size") % 8 == 0, float("nan")).when(F.col("p_size") % 4 != 0, size)
    return table(spark, sf_dir, "part").select("p_partkey", geometry.px_to_um(size, pixel).alias("um"), geometry.spot_radius_um(diameter, pixel).alias("radius_um"))


@query("p25_w12_quantized", f"WITH {views.CELLS_SQL}, e AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x9, min(y) OVER w AS y0, max(y) OVER w AS y9 FROM cells WINDOW w AS (PARTITION BY slide)) SELECT cell_id, CAST(trunc((x - x0) / CASE WHEN x9 > x0 THEN x9 - x0 ELSE 1 END::DOUBLE * 127) AS INTEGER) AS qx, CAST(trunc((y - y0) / CASE WHEN y9 > y0 THEN y9 - y0 ELSE 1 END::DOUBLE * 127) AS INTEGER) AS qy FROM e")
def quantized(spark, sf_dir):
    rows = views.cells(spark, sf_dir)
    ends = rows.groupBy("slide").agg(*[f(c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, 0), (F.max, 9))])
    q = lambda c: geometry.quantized(F.col(c), F.col(f"{c}0"), F.col(f"{c}9")).alias(f"q{c}")
    return rows.join(ends, "slide").select("cell_id", q("x"), q("y"))


@query(
    "p26_sincos_encoding",
    "WITH p AS (SELECT event_id, (event_id % 100) / 10.0::DOUBLE AS x, (event_id % 70) / 7.0::DOUBLE AS y, unnest([0, 2, 4, 6]) AS i FROM events) SELECT event_id, i::INTEGER AS step, round(sin(x * exp(-i * ln(10000.0) / 8)), 6) AS sx, round(cos(x * exp(-i * ln(10000.0) / 8)), 6) AS cx, round(sin(y * exp(-i * ln(10000.0) / 8)), 6) AS sy, round(cos(y * exp(-i * ln(10000.0) / 8)), 6) AS cy FROM p",
)
def sincos_encoding(spark, sf_dir):
    code = vectors.sincos((F.col("event_id") % 100) / 10.0, (F.col("event_id") % 70) / 7.0, 16)
    rows = table(spark, sf_dir, "events").select("event_id", code.alias("c")).select("event_id", "c", F.explode(F.array(*map(F.lit, (0, 2, 4, 6)))).alias("step"))
    return rows.select("event_id", "step", *[F.round(F.get("c", F.col("step") * 2 + k), 6).alias(n) for k, n in enumerate(("sx", "cx", "sy", "cy"))])


@query("p27_grid_key", f"WITH {views.CELLS_SQL} SELECT cell_id, CAST(floor((x - min(x) OVER (PARTITION BY slide)) / 2000.0) AS BIGINT) AS gx, CAST(floor((y - min(y) OVER (PARTITION BY slide)) / 2000.0) AS BIGINT) AS gy FROM cells")
def grid_key(spark, sf_dir):
    rows = views.cells(spark, sf_dir)
    low = rows.groupBy("slide").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return rows.join(low, "slide").select("cell_id", geometry.grid_key(F.col("x"), F.col("x0")).alias("gx"), geometry.grid_key(F.col("y"), F.col("y0")).alias("gy"))


@query("p28_lattice_tile", f"WITH {views.CELLS_SQL} SELECT cell_id, CASE WHEN x >= 500 AND y >= 700 THEN CAST(floor((x - 500) / 512.0) AS BIGINT) * 512 + 500 END AS x1, CASE WHEN x >= 500 AND y >= 700 THEN CAST(floor((y - 700) / 256.0) AS BIGINT) * 256 + 700 + 256 END AS y2 FROM cells")
def lattice_tile(spark, sf_dir):
    tile = geometry.lattice_tile(F.col("x"), F.col("y"), F.lit(500), F.lit(700), F.lit(512), F.lit(256))
    return views.cells(spark, sf_dir).select("cell_id", tile["x1"].alias("x1"), tile["y2"].alias("y2"))


@query("p29_barcode_candidates", f"WITH {views.BARCODES_SQL}, s AS (SELECT col_pos, barcode, string_split(barcode, '-') AS p FROM barcodes) SELECT col_pos, unnest([0, 1, 2, 3])::INTEGER AS choice, unnest([barcode, array_to_string(p[1:4], '-') || '-01', array_to_string(p[1:4], '-'), array_to_string(p[1:3], '-')]) AS candidate FROM s")
def barcode_candidates(spark, sf_dir):
    return views.barcodes(spark, sf_dir).select("col_pos", F.posexplode(ids.barcode_candidates(F.col("barcode"))).alias("choice", "candidate"))


@query("p30_id_list", "SELECT p_partkey, array_to_string(CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type, p_name] ELSE [p_type, p_brand] END, '|') AS ids FROM part")
def id_list(spark, sf_dir):
    even = F.concat_ws(" , ", "p_brand", "p_type", "p_brand", F.lit(""), "p_name")
    odd = F.concat_ws(",", "p_type", F.lit(" "), "p_brand", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(ids.id_list(F.when(F.col("p_size") % 2 == 0, even).otherwise(odd)), "|").alias("ids"))


@query("p31_human_number", "WITH n AS (SELECT o_orderkey, o_orderkey * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 100000 ELSE 1000000 END AS n FROM orders), c AS (SELECT *, CASE WHEN n >= 1000000000 THEN (n + 5000000) // 10000000 WHEN n >= 1000000 THEN (n + 5000) // 10000 ELSE (n + 5) // 10 END AS c FROM n) SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR ELSE (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') || CASE WHEN n >= 1000000000 THEN 'B' WHEN n >= 1000000 THEN 'M' ELSE 'K' END END AS shown FROM c")
def human_number(spark, sf_dir):
    k = F.col("o_orderkey")
    n = k * F.when(k % 4 == 0, 1).when(k % 4 == 1, 1000).when(k % 4 == 2, 100000).otherwise(1000000)
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")).select("o_orderkey", ids.human_number(F.col("n")).alias("shown"))


@query("p33_mean_abs_difference", "SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) / 64, 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def mean_abs_difference(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.mean_abs_difference(F.col("embedding"), F.col("other")), 6).alias("d"))


@query("p34_square", f"WITH {views.CELLS_SQL} SELECT cell_id, CASE WHEN cell_id % 7 = 0 THEN 0.0 ELSE x - 1 END::DOUBLE AS left, CASE WHEN cell_id % 7 = 0 THEN 1.0 ELSE y + 1 END::DOUBLE AS top, CASE WHEN cell_id % 7 = 0 THEN 1.0 ELSE 4.0 END::DOUBLE AS area FROM cells")
def square(spark, sf_dir):
    x = F.when(F.col("cell_id") % 7 != 0, F.col("x"))
    p = geometry.square(x, F.col("y"))
    return views.cells(spark, sf_dir).select("cell_id", F.get(p, F.lit(0))["x"].alias("left"), F.get(p, F.lit(2))["y"].alias("top"), geometry.polygon_area(p).alias("area"))


@query("p35_default_position", "SELECT event_id, (event_id % 100)::DOUBLE AS x, floor(event_id / 100.0)::DOUBLE AS y FROM events")
def default_position(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *geometry.default_position(F.col("event_id")))


@query("p36_cell_number", "SELECT p_partkey, try_cast(CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS INTEGER) AS number, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS text FROM part")
def cell_number(spark, sf_dir):
    text = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", ids.cell_number(text).alias("number"), text.alias("text"))
