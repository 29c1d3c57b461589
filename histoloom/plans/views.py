"""The given tables in the roles of cells, tiles, spots, features, expression and scores; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoloom.session import table

TILE = 12_500

CELLS_SQL = "cells AS (SELECT event_id AS cell_id, user_id AS slide, CAST(round(value * 100) AS BIGINT) AS x, (event_id * 7919) % 50000 AS y FROM events)"
TILES_SQL = f"tiles AS (SELECT DISTINCT slide, (CAST(floor(x / {TILE}.0) AS BIGINT)) * 1000 + CAST(floor(y / {TILE}.0) AS BIGINT) AS tile_id, CAST(floor(x / {TILE}.0) AS BIGINT) * {TILE} AS x1, CAST(floor(y / {TILE}.0) AS BIGINT) * {TILE} AS y1, CAST(floor(x / {TILE}.0) AS BIGINT) * {TILE} + {TILE} AS x2, CAST(floor(y / {TILE}.0) AS BIGINT) * {TILE} + {TILE} AS y2 FROM cells)"
SPOTS_SQL = "spots AS (SELECT slide, cell_id AS spot_idx, x, y FROM cells WHERE cell_id % 10 = 0), loose AS (SELECT * FROM cells WHERE cell_id % 10 <> 0)"
EXPR_SQL = "expr AS (SELECT l_suppkey AS sample_id, p_brand AS gene, sum(l_extendedprice) AS value, sum(l_extendedprice * (1 - l_discount)) AS pred, sum(l_extendedprice) AS target FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
FEATURES_SQL = "features AS (SELECT vec_id AS cell_id, vec_id % 5 AS slide, embedding AS features, label FROM embeddings)"
BARCODES_SQL = "barcodes AS (SELECT c_custkey AS col_pos, 'TCGA-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey % 500 AS VARCHAR), 4, '0') || '-0' || CAST(c_custkey % 3 AS VARCHAR) || 'A-11' AS barcode, c_acctbal AS value, c_mktsegment AS gene FROM customer)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, slide and whole-numbered x and y, so that squared distances are exact."""
    x = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("cell_id"), F.col("user_id").alias("slide"), x.alias("x"), (F.col("event_id") * 7919 % 50000).alias("y"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice tiles that hold cells."""
    bx, by = (F.floor(F.col(c) / float(TILE)) for c in ("x", "y"))
    rows = cells(spark, sf_dir).select("slide", bx.alias("bx"), by.alias("by")).distinct()
    return rows.select("slide", (F.col("bx") * 1000 + F.col("by")).alias("tile_id"), (F.col("bx") * TILE).alias("x1"), (F.col("by") * TILE).alias("y1"), (F.col("bx") * TILE + TILE).alias("x2"), (F.col("by") * TILE + TILE).alias("y2"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth cell as a spot."""
    return cells(spark, sf_dir).where("cell_id % 10 = 0").select("slide", F.col("cell_id").alias("spot_idx"), "x", "y")


def loose_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other cells."""
    return cells(spark, sf_dir).where("cell_id % 10 != 0")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, gene, value; pred and target beside it for scoring."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    price, cut = F.col("l_extendedprice"), F.col("l_discount")
    return rows.groupBy(F.col("l_suppkey").alias("sample_id"), F.col("p_brand").alias("gene")).agg(F.sum(price).alias("value"), F.sum(price * (1 - cut)).alias("pred"), F.sum(price).alias("target"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, slide, features and label of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), (F.col("vec_id") % 5).alias("slide"), F.col("embedding").alias("features"), "label")


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """col_pos, barcode, gene and value: sample barcodes with replicates of a case."""
    part = lambda c, n: F.lpad(c.cast("string"), n, "0")
    code = F.concat(F.lit("TCGA-"), part(F.col("c_nationkey"), 2), F.lit("-"), part(F.col("c_custkey") % 500, 4), F.lit("-0"), (F.col("c_custkey") % 3).cast("string"), F.lit("A-11"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("col_pos"), code.alias("barcode"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("gene"))
