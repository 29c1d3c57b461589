"""Tables of graphs: node numbers, sizes, metadata, pooling over neighbours and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histoloom.functions import vectors
from histoloom.operators.ordering import number_within, running_sums
from histoloom.operators.reduce import vector_mean, vector_sum
from histoloom.session import stage


def node_index(nodes: DataFrame, graph: str, row: str) -> DataFrame:
    """nodes with node_idx: their number inside the graph, in row order; a large graph's nodes are numbered by many tasks."""
    return number_within(nodes, graph, row, name="node_idx")


def graph_sizes(nodes: DataFrame, edges: DataFrame, graph: str) -> DataFrame:
    """(graph, nodes, edges) of every graph with nodes."""
    n = nodes.groupBy(graph).agg(F.count("*").alias("nodes"))
    e = edges.groupBy(graph).agg(F.count("*").alias("edges"))
    return n.join(e, graph, "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))


def size_stats(sizes: DataFrame) -> DataFrame:
    """One row: number of graphs, least, most and mean nodes, all edges."""
    return sizes.agg(F.count("*").alias("graphs"), F.min("nodes").alias("min_nodes"), F.max("nodes").alias("max_nodes"), F.avg("nodes").alias("mean_nodes"), F.sum("edges").alias("total_edges"))


def graph_metadata(cells: DataFrame, tiles: DataFrame, edges: DataFrame, group: str = "slide") -> DataFrame:
    """(slide, cells, tiles, edges, connected_cells, has_graph)."""
    c = cells.groupBy(group).agg(F.count("*").alias("cells"))
    t = tiles.groupBy(group).agg(F.count("*").alias("tiles"))
    e = edges.groupBy(group).agg(F.count("*").alias("edges"), F.count_distinct("src").alias("connected_cells"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return c.join(t, group, "left").join(e, group, "left").select(group, "cells", zero("tiles"), zero("edges"), zero("connected_cells"), (zero("edges") > 0).alias("has_graph"))


def split_summary(slides: DataFrame) -> DataFrame:
    """(split, slides, with_graph, without_graph, patients, mean_cells, mean_tiles)."""
    return slides.groupBy("split").agg(
        F.count("*").alias("slides"), F.count_if("has_graph").alias("with_graph"), F.count_if(~F.col("has_graph")).alias("without_graph"), F.count_distinct("case").alias("patients"), F.avg("cells").alias("mean_cells"), F.avg("tiles").alias("mean_tiles")
    )


def spot_offsets(cells: DataFrame, group: str, spot: str) -> DataFrame:
    """(group, spot, start, end): where each spot's cells stand in a list ordered by spot."""
    counts = cells.groupBy(group, spot).agg(F.count("*").alias("n"))
    return running_sums(counts, group, [spot], "n", name="start").select(group, spot, "start", (F.col("start") + F.col("n")).alias("end"))


def spot_arrays(cells: DataFrame, spot: list[str], row: str, *columns: str) -> DataFrame:
    """One row for each spot with its cells' columns as arrays in row order."""
    ordered = F.array_sort(F.collect_list(F.struct(row, *columns)))
    rows = cells.groupBy(*spot).agg(ordered.alias("_o"))
    column = lambda c: F.transform("_o", lambda s: s[c]).alias(c)
    return rows.select(*spot, *map(column, (row, *columns)))


def in_ranges(rows: DataFrame, ranges: DataFrame, group: str, row: str, start: str = "start", end: str = "end") -> DataFrame:
    """rows with the columns of every range (start <= row < end) of their group that holds their number.

    Ranges stand at the level of their own length: blocks of numbers double from level to level, and a range lies at the
    first one whose block is no shorter than it, so it covers two blocks at most. Rows look at each level that has ranges.
    """
    sized = ranges.where(F.col(end) > F.col(start))
    sized = sized.withColumn("_level", F.ceil(F.log2((F.col(end) - F.col(start)).cast("double"))).cast("int"))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())  # 64 at most
    block = lambda c: F.call_function("shiftright", F.col(c).cast("long"), F.col("_level"))
    last = F.call_function("shiftright", F.col(end).cast("long") - 1, F.col("_level"))
    sized = sized.withColumn("_block", F.explode(F.sequence(block(start), last)))
    looking = rows.withColumn("_level", F.explode(F.array(*map(F.lit, levels))) if levels else F.lit(0)).withColumn("_block", block(row))
    inside = (F.col(row) >= F.col(start)) & (F.col(row) < F.col(end))
    return looking.join(sized, [group, "_level", "_block"]).where(inside).drop("_level", "_block")


def spot_arrays_by_offsets(cells: DataFrame, offsets: DataFrame, group: str, spot: str, row: str, *columns: str) -> DataFrame:
    """(group, spot, row, columns) of every spot in offsets (group, spot, start, end): its cells' columns as arrays in row order, empty ones for a spot without cells.

    Only the offsets say which cells are a spot's; cells beyond them are nobody's.
    """
    held = in_ranges(cells.select(group, row, *columns), offsets.select(group, spot, "start", "end"), group, row)
    arrays = spot_arrays(held, [group, spot], row, *columns)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(arrays.schema[c].dataType)).alias(c)
    return offsets.select(group, spot).join(arrays, [group, spot], "left").select(group, spot, *map(empty, (row, *columns)))


def polygons(vertices: DataFrame) -> DataFrame:
    """(cell_id, polygon) from vertex rows, in vertex order."""
    ordered = F.array_sort(F.collect_list(F.struct("vertex_idx", "x", "y")))
    return vertices.groupBy("cell_id").agg(F.transform(ordered, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("polygon"))


def neighbour_mean(nodes: DataFrame, edges: DataFrame, graph: str, node: str, vector: str = "features") -> DataFrame:
    """(graph, node, features): sum of the neighbours' vectors and the node's own, each weighted by 1 / sqrt of both degrees (self loops count).

    Vectors are weighted by their own degree before they are sent and the sums by the receiver's afterwards, so edges meet
    one table once and carry nothing but their ends.
    """
    edges = stage(edges.select(graph, "src", "dst"), "pooled-edges")
    loops = nodes.select(graph, F.col(node).alias("dst"))
    degree = stage(edges.select(graph, "dst").unionByName(loops).groupBy(graph, "dst").agg((1 / F.sqrt(F.count("*").cast("double"))).alias("_w")), "degrees")
    own = nodes.where(F.col(vector).isNotNull()).select(graph, F.col(node).alias("src"), vector).join(degree.withColumnRenamed("dst", "src"), [graph, "src"])
    sent = edges.join(own, [graph, "src"]).select(graph, "dst", vector, "_w").unionByName(own.select(graph, F.col("src").alias("dst"), vector, "_w"))
    sums = sent.groupBy(graph, "dst").agg(vector_sum(vector, "_w").alias("_sum")).join(degree, [graph, "dst"])
    return sums.select(graph, F.col("dst").alias(node), F.transform("_sum", lambda x: x * F.col("_w")).alias(vector))


def softmax_pool(scores: DataFrame, graph: str, gene: str, score: str = "score", value: str = "value") -> DataFrame:
    """(graph, gene, pooled): values weighted by the softmax of their scores inside (graph, gene)."""
    top = F.max(score).over(Window.partitionBy(graph, gene))
    rows = scores.withColumn("_w", F.exp(F.col(score) - top))
    return rows.groupBy(graph, gene).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("pooled"))


def compactness(cells: DataFrame, graph: str, label: str = "label", vector: str = "features", skip_below_zero: bool = True) -> DataFrame:
    """(graph, compactness): over labels with several cells, the sum of mean distances to the label's centroid."""
    named = cells.where(F.col(label) >= 0) if skip_below_zero else cells.where(F.col(label) != -1)
    named = named.where(F.col(vector).isNotNull())
    centroids = named.groupBy(graph, label).agg(vector_mean(vector).alias("_c"), F.count(vector).alias("_n")).where("_n > 1").drop("_n")
    distance = F.sqrt(vectors.squared_distance(F.col(vector), F.col("_c")))
    by_label = named.join(centroids, [graph, label]).groupBy(graph, label).agg(F.avg(distance).alias("d"))
    return by_label.groupBy(graph).agg(F.sum("d").alias("compactness"))


def attach_labels(nodes: DataFrame, labels: DataFrame, node: str = "cell_id", label: str = "label", name: str = "cluster", missing: int = -1) -> DataFrame:
    """nodes with the label of each as `name`; those without one get `missing`. labels: a row for each node at most."""
    return nodes.join(labels.select(node, F.col(label).alias(name)), node, "left").withColumn(name, F.coalesce(name, F.lit(missing)))
