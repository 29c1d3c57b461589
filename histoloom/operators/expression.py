"""Expression matrices as long tables: replicates, alignment, statistics and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histoloom.functions import ids
from histoloom.session import stage

#: Spread below which a gene counts as constant.
FLAT = 1e-6
#: Genes up to which a given list is broadcast.
BROADCAST_GENES = 200_000


def replicate_mean(expr: DataFrame, case: Column) -> DataFrame:
    """(case, gene, value): mean over all samples of a case."""
    return expr.groupBy(case.alias("case"), "gene").agg(F.avg("value").alias("value"))


def replicate_last(expr: DataFrame, case: Column, position: str) -> DataFrame:
    """(case, gene, value): the sample that stands last wins."""
    return expr.groupBy(case.alias("case"), "gene").agg(F.max_by("value", position).alias("value"))


def multi_sample_cases(samples: DataFrame, case: Column) -> DataFrame:
    """(case, n) of cases with more than one sample."""
    return samples.groupBy(case.alias("case")).agg(F.count("*").alias("n")).where("n > 1")


def gene_stats(expr: DataFrame) -> DataFrame:
    """(gene, mean, std): population statistics; a flat gene's std is 1."""
    std = F.stddev_pop("value")
    return expr.groupBy("gene").agg(F.avg("value").alias("mean"), F.when(std < FLAT, 1.0).otherwise(std).alias("std"))


def _with_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    return rows.join(stats.select("gene", "mean", "std"), "gene")  # a row for each gene: the planner broadcasts it if it is small


def zscore(expr: DataFrame, stats: DataFrame) -> DataFrame:
    """Values in standard deviations from their gene's mean; genes without statistics fall out."""
    return _with_stats(expr, stats).withColumn("value", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")


def inverse_zscore(scores: DataFrame, stats: DataFrame, columns: tuple[str, ...] = ("pred", "target")) -> DataFrame:
    """Scores back on the scale of the statistics."""
    return _with_stats(scores, stats).withColumns({c: F.col(c) * F.col("std") + F.col("mean") for c in columns}).drop("mean", "std")


def log1p_aligned(expr: DataFrame) -> DataFrame:
    """Logarithm of one plus the value; after alignment, so absent genes stay 0."""
    return expr.withColumn("value", F.log1p("value"))


def per_million(scores: DataFrame, value: str = "pred", sample: str = "sample_id", mode: str = "train") -> DataFrame:
    """Values as parts per million of their sample. mode 'train': the sum gets 1e-8 more, results lie in 0..1e6; 'test': the sum is 1e-8 at least, no limits."""
    total = F.sum(value).over(Window.partitionBy(sample))
    if mode == "train":
        scaled = F.greatest(F.lit(0.0), F.least(F.lit(1e6), F.col(value) / (total + 1e-8) * 1e6))
    else:
        scaled = F.col(value) / F.greatest(total, F.lit(1e-8)) * 1e6
    return scores.withColumn(value, scaled)


def slide_expression(slides: DataFrame, expr: DataFrame, zero_missing: bool = False) -> DataFrame:
    """Slides with the expression of their case (gene, value); a slide without any stays with nulls, or zero values."""
    value = F.coalesce("value", F.lit(0.0)) if zero_missing else F.col("value")
    return slides.join(expr, "case", "left").withColumn("value", value)


def valid_slides(slides: DataFrame, expr: DataFrame) -> DataFrame:
    """Slides whose case has expression."""
    return slides.join(expr.select("case").distinct(), "case", "left_semi")


def match_barcodes(columns: DataFrame, patients: DataFrame) -> DataFrame:
    """(patient_id, barcode, col_pos): a column's first candidate id that is a patient; the last column of a patient wins."""
    tried = columns.select("barcode", "col_pos", F.posexplode(ids.barcode_candidates(F.col("barcode"))).alias("choice", "patient_id"))
    hits = tried.join(patients.select("patient_id").distinct(), "patient_id")
    first = hits.groupBy("barcode", "col_pos").agg(F.min_by("patient_id", "choice").alias("patient_id"))
    return first.groupBy("patient_id").agg(F.max_by("barcode", "col_pos").alias("barcode"), F.max("col_pos").alias("col_pos"))


def map_genes(genes: DataFrame, gene_map: DataFrame) -> DataFrame:
    """(pos, symbol, ens_id) of the listed symbols that the map knows."""
    return genes.join(gene_map.select("symbol", "ens_id"), "symbol").select("pos", "symbol", "ens_id")


def align_genes(expr: DataFrame, genes: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(sample_id, pos, gene, value, available): every listed gene for every sample in list order, absent ones 0.

    With ignore_case the first gene (by name) that matches counts. The product of samples and genes is the result itself.
    """
    key = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    listed = genes.select("pos", F.col("symbol").alias("gene"), key(F.col("symbol")).alias("_key"))
    known = expr.select(F.col("gene").alias("_name"), key(F.col("gene")).alias("_key")).distinct().groupBy("_key").agg(F.min("_name").alias("_name"))
    listed = listed.join(known, "_key", "left").withColumn("available", F.col("_name").isNotNull())
    listed = stage(listed, "gene-list")
    samples = expr.select("sample_id").distinct()
    if (n := listed.count()) <= BROADCAST_GENES:
        grid = samples.crossJoin(F.broadcast(listed))
    else:  # in blocks of the list, which every sample meets one by one
        blocks = -(-n // BROADCAST_GENES)
        lists = listed.withColumn("_block", F.pmod(F.xxhash64("pos", "gene"), F.lit(blocks))).groupBy("_block").agg(F.collect_list(F.struct(*listed.columns)).alias("_genes"))
        grid = samples.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(lists, "_block").select("sample_id", F.inline("_genes"))
    values = expr.select("sample_id", F.col("gene").alias("_name"), "value")
    return grid.join(values, ["sample_id", "_name"], "left").select("sample_id", "pos", "gene", F.coalesce("value", F.lit(0.0)).alias("value"), "available")


def gene_vectors(aligned: DataFrame) -> DataFrame:
    """(sample_id, vector) in list order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return aligned.groupBy("sample_id").agg(F.transform(ordered, lambda g: g["value"]).alias("vector"))


def first_genes(expr: DataFrame, n: int) -> DataFrame:
    """The positional gene filter: the first n rows of the matrix."""
    return expr.where(F.col("gene_pos") < n)


def spot_inputs(spots: DataFrame, graphs: DataFrame, features: DataFrame) -> DataFrame:
    """spots with tier: 'graph', 'features' (no edges) or 'zero' node, and the number of cells."""
    g = graphs.select("spot_idx", F.lit(True).alias("has_graph")).distinct()
    f = features.groupBy("spot_idx").agg(F.count("*").alias("num_cells"))
    rows = spots.join(g, "spot_idx", "left").join(f, "spot_idx", "left")
    rows = rows.withColumns({"has_graph": F.coalesce("has_graph", F.lit(False)), "has_features": F.col("num_cells").isNotNull(), "num_cells": F.coalesce("num_cells", F.lit(0).cast("long"))})
    return rows.withColumn("tier", F.when(F.col("has_graph"), "graph").when(F.col("has_features"), "features").otherwise("zero"))


def align_barcodes(cells: DataFrame, matrix: DataFrame) -> DataFrame:
    """cells with matrix_row: by barcode if the matrix has every cell's, else by position for all of them."""
    missing = cells.join(matrix.select(F.col("barcode").alias("cell_id")), "cell_id", "left_anti").take(1)
    if missing:
        return cells.join(matrix.select(F.col("row_idx"), F.col("row_idx").alias("matrix_row")), "row_idx")
    return cells.join(matrix.select(F.col("barcode").alias("cell_id"), F.col("row_idx").alias("matrix_row")), "cell_id")


def csr_to_long(matrix: DataFrame, *keys: str) -> DataFrame:
    """(keys, row, column, value) of matrices in CSR arrays (data, indices, indptr); the number of rows follows from indptr."""
    ends = F.transform(F.col("indptr"), lambda p, k: F.struct(p.alias("start"), F.get("indptr", k + 1).alias("end")))
    rows = matrix.select(*keys, "data", "indices", F.posexplode(ends).alias("row", "span")).where(F.col("span.end") > F.col("span.start"))
    at = rows.select(*keys, "row", "data", "indices", F.explode(F.sequence(F.col("span.start"), F.col("span.end") - 1)).alias("at"))
    return at.select(*keys, "row", F.get("indices", F.col("at").cast("int")).alias("column"), F.get("data", F.col("at").cast("int")).alias("value"))


def sum_to_group(cells: DataFrame, group: str = "slide", gene: str = "gene", value: str = "pred") -> DataFrame:
    """(group, gene, value): predictions of cells summed up to their slide (or tile, or spot)."""
    return cells.groupBy(group, gene).agg(F.sum(value).alias(value))
