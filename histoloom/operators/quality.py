"""Checks over tables of features, samples and runs."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from histoloom.operators.ordering import seeded

#: Percentiles of the columns' spread that the diagnostics report; the spread that counts as none.
PERCENTILES = (0, 1, 5, 25, 50, 75, 95, 99, 100)
FLAT = 1e-8


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that a table lacks; known before any row is read."""
    return [c for c in required if c not in df.columns]


def feature_violations(cells: DataFrame, expected: DataFrame, vector: str = "features", few: int = 10) -> DataFrame:
    """(slide, problem) for every slide with a broken table: no rows, another count than expected, unequal widths, null, NaN or infinite values; 'few rows' only warns."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    found = cells.groupBy("slide").agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most"), F.count_if(F.col(vector).isNull() | bad).alias("bad"))
    rows = expected.select("slide", "expected").join(found, "slide", "left")
    n = F.coalesce("n", F.lit(0))
    problems = F.array_compact(F.array(F.when(n == 0, "empty"), F.when((n > 0) & (n != F.col("expected")), "row count"), F.when(F.col("least") != F.col("most"), "width"), F.when(F.col("bad") > 0, "not finite"), F.when((n > 0) & (n < few), "few rows")))
    return rows.select("slide", F.explode(problems).alias("problem"))


#: What parquet's footer makes the least size of a file: two marks of 4 bytes and a length.
LEAST_BYTES = 12


def parquet_footers(files: DataFrame) -> DataFrame:
    """files (path, length, ...) with `rows` and `columns` of their parquet footer, null where it cannot be read. Tasks read the footers, never data."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], []
            for path in batch.column("path").to_pylist():
                try:
                    system, place = fs.FileSystem.from_uri(path)
                    with system.open_input_file(place) as file:
                        footer = pq.read_metadata(file)
                    rows.append(footer.num_rows)
                    columns.append(footer.schema.to_arrow_schema().names)
                except (OSError, pa.ArrowException):
                    rows.append(None)
                    columns.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64()), pa.array(columns, pa.list_(pa.string()))], [*batch.schema.names, "rows", "columns"])

    schema = T.StructType([*files.schema.fields, T.StructField("rows", T.LongType()), T.StructField("columns", T.ArrayType(T.StringType()))])
    return files.mapInArrow(opened, schema)


def file_violations(files: DataFrame, expected: DataFrame, required: tuple[str, ...] = ("features",), few: int = 10) -> DataFrame:
    """(slide, problem) by the files of a feature store alone. files: (slide, path, length); expected: (slide, expected rows or null).

    'missing': no file; 'temporary': a file that a writer has left unfinished; 'empty file': no bytes; 'unreadable': no footer (cut
    off, or no parquet); 'missing column'; 'empty': footers without rows; 'row count': another number than expected; 'few rows'
    only warns. Only listings and footers are read; feature_violations looks at the rows of slides that pass.
    """
    unfinished = F.col("path").rlike(r"/_temporary/|\.tmp(\.[^/]*)?$")
    read = parquet_footers(files.where(~unfinished & (F.col("length") >= LEAST_BYTES)).select("slide", "path", "length"))
    rest = files.where(unfinished | (F.col("length") < LEAST_BYTES)).select("slide", "path", "length", F.lit(None).cast("long").alias("rows"), F.lit(None).cast("array<string>").alias("columns"))
    every = read.unionByName(rest).withColumn("unfinished", unfinished)
    lacks = functools.reduce(lambda a, b: a | b, [~F.array_contains("columns", c) for c in required], F.lit(False))
    found = every.groupBy("slide").agg(
        F.count_if("unfinished").alias("temporary"), F.count_if(~F.col("unfinished")).alias("files"), F.count_if(~F.col("unfinished") & (F.col("length") == 0)).alias("no_bytes"),
        F.count_if(~F.col("unfinished") & (F.col("length") > 0) & F.col("rows").isNull()).alias("unreadable"), F.count_if(lacks).alias("lacking"), F.sum("rows").alias("rows"),
    )
    rows = expected.select("slide", "expected").join(found, "slide", "left")
    n, sound = F.coalesce("rows", F.lit(0)), (F.col("files") > 0) & (F.col("no_bytes") == 0) & (F.col("unreadable") == 0)
    problem = lambda name, condition: F.when(condition, name)
    problems = F.array_compact(F.array(
        problem("missing", F.coalesce("files", F.lit(0)) == 0), problem("temporary", F.col("temporary") > 0), problem("empty file", F.col("no_bytes") > 0), problem("unreadable", F.col("unreadable") > 0),
        problem("missing column", F.col("lacking") > 0), problem("empty", sound & (n == 0)), problem("row count", sound & (n > 0) & (n != F.col("expected"))), problem("few rows", sound & (n > 0) & (n < few)),
    ))
    return rows.select("slide", F.explode(problems).alias("problem"))


def dimension_stats(cells: DataFrame, vector: str = "features") -> DataFrame:
    """(dim, nan, inf, mean, std, min, max) of each component over the finite values."""
    rows = cells.select(F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    return rows.groupBy("dim").agg(F.count_if(F.isnan("v")).alias("nan"), F.count_if(F.abs("v") == float("inf")).alias("inf"), F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"), F.min(finite).alias("min"), F.max(finite).alias("max"), F.count(finite).alias("n"))


def spread_summary(stats: DataFrame) -> DataFrame:
    """One row: components, those without spread, percentiles of the spread, variance over all values."""
    mean = F.sum(F.col("mean") * F.col("n")) / F.sum("n")
    total = F.sum(F.col("n") * (F.col("std") * F.col("std") + F.col("mean") * F.col("mean"))) / F.sum("n") - mean * mean
    return stats.agg(F.count("*").alias("dims"), F.count_if(F.col("std") < FLAT).alias("flat_dims"), F.percentile("std", [p / 100 for p in PERCENTILES]).alias("std_percentiles"), total.alias("total_variance"))


def unique_ratio(cells: DataFrame, key: str, vector: str = "features", n: int = 2000, seed: int = 42, digits: int = 6) -> DataFrame:
    """One row: distinct share of n rows, taken in seeded order, rounded."""
    some = cells.orderBy(seeded(key, seed), key).limit(n)
    rounded = F.transform(vector, lambda v: F.round(v.cast("double"), digits))
    return some.agg(F.try_divide(F.count_distinct(rounded), F.count("*")).alias("unique_ratio"), F.count("*").alias("rows"))


def count_agreement(expected: DataFrame, actual: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, expected, actual, agree) of both sides' counts; a side without rows counts 0."""
    e, a = expected.groupBy(key).agg(F.count("*").alias("expected")), actual.groupBy(key).agg(F.count("*").alias("actual"))
    both = e.join(a, key, "full_outer").na.fill(0, ["expected", "actual"])
    return both.withColumn("agree", F.col("expected") == F.col("actual"))


def ingest_report(status: DataFrame) -> DataFrame:
    """One row: samples that completed and failed, success rate, cells, mean cells of a completed sample (whole)."""
    ok = F.col("status") == "completed"
    cells = F.coalesce(F.sum(F.when(ok, F.col("cells"))), F.lit(0).cast("long"))
    good = F.count_if(ok)
    return status.agg(F.count("*").alias("samples"), good.alias("completed"), F.count_if(~ok).alias("failed"), F.try_divide(good * 100.0, F.count("*")).alias("success_rate"), cells.alias("cells"), F.floor(F.try_divide(cells.cast("double"), good)).alias("mean_cells"))


def latest_status(log: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, status) as of the last entry, so a success clears an earlier failure."""
    return log.groupBy(key).agg(F.max_by("status", "ts").alias("status"))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Wanted rows that are not done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def with_siblings(tiles: DataFrame, *others: DataFrame, key: str = "stem") -> DataFrame:
    """Tiles for which every other listing has the stem too."""
    for other in others:
        tiles = tiles.join(other.select(key).distinct(), key, "left_semi")
    return tiles


def vector_widths(cells: DataFrame, vector: str = "features") -> DataFrame:
    """(width, cells): how many vectors there are of each length; one row where a store is sound."""
    return cells.groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("cells"))
