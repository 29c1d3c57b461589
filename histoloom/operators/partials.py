"""Statistics as stored partial states by slide, merged for any set of slides.

A state holds number, mean, sum of squared deviations, least and most value and a quantile sketch. States of disjoint rows add up
to the state of all of them, so taking a slide up reads that slide only, and any selection of slides (a fold, a split, all but
one) needs no look at cells or expression again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoloom.operators.expression import FLAT
from histoloom.sources.readers import BUCKET, exists
from histoloom.sources.writers import write_cell_features

#: Size parameter of the quantile sketches: ranks are right to about 1 % of the rows.
SKETCH = 256


def partial_stats(rows: DataFrame, part: str, key: str, value: str = "value") -> DataFrame:
    """(part, key, n, mean, m2, least, most, sketch) over the finite values; part: the slide or sample that the state is of."""
    v = F.col(value).cast("double")
    finite = rows.select(part, key, v.alias("_v")).where(F.abs("_v") < float("inf"))  # neither null nor NaN
    spread = F.var_pop("_v") * F.count("_v")
    return finite.groupBy(part, key).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), spread.alias("m2"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("sketch"))


def partial_dimension_stats(cells: DataFrame, part: str = "slide", vector: str = "features") -> DataFrame:
    """partial_stats of each component of a vector column; the key is `dim`."""
    return partial_stats(cells.select(part, F.posexplode(vector).alias("dim", "v")), part, "dim", "v")


def merged_stats(states: DataFrame, key: str) -> DataFrame:
    """(key, n, mean, m2, least, most, sketch) of all the states together. Deviations are taken from the common mean, so nothing cancels."""
    whole = states.groupBy(key).agg(F.sum("n").alias("_n"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
    apart = F.col("mean") - F.col("_mean")
    return states.join(whole, key).groupBy(key).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * apart * apart).alias("m2"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"),
    )


def described(merged: DataFrame, key: str, *shares: float) -> DataFrame:
    """(key, n, mean, std, least, most, quantiles) of merged states; quantiles at the given shares of the rows, from the sketch."""
    std = F.sqrt(F.col("m2") / F.col("n"))
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares]).cast("array<double>")
    return merged.select(key, "n", "mean", std.alias("std"), "least", "most", quantiles.alias("quantiles"))


def gene_stats(states: DataFrame) -> DataFrame:
    """(gene, mean, std) as expression.gene_stats has them, of all the states together; a flat gene's std is 1."""
    rows = described(merged_stats(states, "gene"), "gene")
    return rows.select("gene", "mean", F.when(F.col("std") < FLAT, 1.0).otherwise(F.col("std")).alias("std"))


def store_stats(states: DataFrame, folder: str, part: str, buckets: int | None = None) -> None:
    """States into a store, a partition folder for each part (or so many folders of parts, for many small ones); only the parts at hand are replaced."""
    write_cell_features(states, folder, part, buckets)


def stored_stats(spark: SparkSession, folder: str, parts: DataFrame | None = None, part: str = "slide") -> DataFrame:
    """The stored states, or those of some parts only (partitions of others are not read, where each part has its own)."""
    if not exists(spark, folder):
        raise FileNotFoundError(folder)
    states = spark.read.parquet(folder).drop(BUCKET)
    return states if parts is None else states.join(parts.select(part).distinct(), part, "left_semi")
