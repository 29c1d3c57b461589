"""The bulk chain on files: features, tile images and an expression matrix are read from disk, graphs are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoloom.operators import expression, graphs, spatial
from histoloom.plans import views
from histoloom.plans.registry import query
from histoloom.plans.source_queries import STORE_BUCKETS, touch
from histoloom.session import posix_path, shared_path, stage, table
from histoloom.sources import readers, writers


def build_bulk_graphs(spark: SparkSession, features: str, tiles: str, matrix: str, out: str, radius: float) -> None:
    """Write nodes, edges, graph_meta and targets of every slide that has cells and expression.

    features: a store of write_cell_features; tiles: a folder of tile images; matrix: a CSV of genes by slides.
    """
    cells = spark.read.parquet(features).drop(readers.BUCKET).withColumn("slide", F.col("slide").cast("string"))
    expr = readers.read_expression_wide(spark, matrix).where("value is not null").withColumnRenamed("sample_id", "case")
    targets = expr.groupBy("case", "gene_id").agg(F.sum("value").alias("value"))
    edges = stage(spatial.radius_graph(cells, radius), "edges")
    meta = graphs.graph_metadata(cells, readers.list_tiles(spark, tiles), edges)
    ready = expression.valid_slides(meta.withColumn("case", F.col("slide")), targets)
    ready = stage(ready, "graph-meta")
    known = ready.select("slide")
    nodes = graphs.node_index(cells.join(known, "slide", "left_semi"), "slide", "cell_id")
    writers.write_graphs(out, graph_meta=ready, targets=targets, nodes=nodes, edges=edges.join(known, "slide", "left_semi"))


@query("bulk_chain_on_files", f"WITH {views.CELLS_SQL}, {views.TILES_SQL}, e AS (SELECT a.slide, count(*) AS edges FROM cells a JOIN cells b ON a.slide = b.slide WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) BETWEEN 1 AND 25000000 GROUP BY 1), c AS (SELECT slide, count(*) AS cells FROM cells GROUP BY 1), t AS (SELECT slide, count(*) AS tiles FROM tiles GROUP BY 1), x AS (SELECT l_suppkey AS slide, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1) SELECT slide, cells, tiles, coalesce(edges, 0) AS edges, cells AS nodes, total FROM c JOIN t USING (slide) LEFT JOIN e USING (slide) JOIN x USING (slide)")
def bulk_chain_on_files(spark, sf_dir) -> DataFrame:
    """The given tables put on disk as files, the chain run on them, and what it wrote read back."""
    features, tiles, matrix, out = (shared_path(spark, f"bulk-{x}") for x in ("features", "tiles", "matrix", "graphs"))
    writers.write_cell_features(views.cells(spark, sf_dir), features, buckets=STORE_BUCKETS)
    bounds = F.concat_ws("-", *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")])
    name = F.concat(F.lit(f"{posix_path(tiles)}/"), F.pmod("slide", F.lit(STORE_BUCKETS)).cast("string"), F.lit("/"), F.col("slide").cast("string"), F.lit("_patch_tile_"), F.col("tile_id").cast("string"), F.lit("_level0_"), bounds, F.lit(".png"))
    touch(views.tiles(spark, sf_dir).select(name.alias("path")))
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("G"), F.col("l_linenumber").cast("string")).alias("gene"), "l_suppkey", "l_quantity")
    values = items.groupBy("gene", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    writers.write_expression_wide(values, matrix, "gene", "l_suppkey", "value")
    build_bulk_graphs(spark, features, tiles, matrix, out, 5000.0)
    count = lambda kind, *keys: writers.read_graphs(spark, out, kind).groupBy(*keys)
    nodes = count("nodes", "slide").agg(F.count("*").alias("nodes"))
    edges = count("edges", "slide").agg(F.count("*").alias("edge_rows"))
    totals = writers.read_graphs(spark, out, "targets").groupBy(F.col("case").alias("slide")).agg(F.round(F.sum("value"), 2).alias("total"))
    meta = writers.read_graphs(spark, out, "graph_meta").join(nodes, "slide").join(totals, "slide").join(edges, "slide", "left")
    return meta.where(F.coalesce("edge_rows", F.lit(0)) == F.col("edges")).select(F.col("slide").cast("bigint").alias("slide"), "cells", "tiles", "edges", "nodes", "total")
